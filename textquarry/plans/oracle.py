"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from . import synthetic

DECISIONS = f"decisions as ({synthetic.DECISIONS})"
INDEX = f"index_pages as ({synthetic.INDEX_PAGES})"
MONTH = f"month_pages as ({synthetic.MONTH_PAGES})"
SITE = "https://site.example"

EMB = """emb as (select vec_id as id, 'case ' || label as case_no, 'S' || (vec_id % 3) as section, (vec_id % 4)::int as chunk_index, 'text ' || vec_id as text, embedding::double[] as e, label from embeddings),
q as (select embedding::double[] as q from embeddings where vec_id = 0),
dist as (select *, round(raw, 6) as distance, round(1 - raw / 2, 6) as similarity from (select emb.*, greatest(list_cosine_distance(e, q), 0.0) as raw from emb, q))"""
TOP = EMB + """,
top10 as (select * from dist order by raw, id limit 10)"""

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

HEADING = r"""case when regexp_full_match(s, '(?i)D\sE\sC\sI\sS\sI\sO\sN') then 'DECISION' when regexp_full_match(s, '(?i)SYLLABUS') then 'SYLLABUS'
 when regexp_full_match(s, '(?i)(THE\s+FACTS|STATEMENT\s+OF\s+FACTS|FACTS)') then 'FACTS' when regexp_full_match(s, '(?i)(ISSUES?|ASSIGNED\s+ERRORS)') then 'ISSUES'
 when regexp_full_match(s, '(?i)(RULING|DISCUSSION|THE\s+COURT[’''`]S?\s+RULING)') then 'RULING' when regexp_full_match(s, '(?i)(WHEREFORE|SO\s+ORDERED)') then 'WHEREFORE' end"""
LINES = DECISIONS + rf""",
arr as (select doc_id, string_split(text, chr(10)) as ls from decisions),
ln as (select doc_id, i - 1 as pos, ls[i] as line, trim(rtrim({STRIP.format('ls[i]')}, ':')) as s from arr, unnest(range(1, len(ls) + 1)) as u(i)),
hd as (select doc_id, pos, line, {HEADING} as heading from ln)"""
SECTIONS = LINES + rf""",
od as (select *, sum((heading is not null)::int) over (partition by doc_id order by pos) as ord from hd),
sc as (select doc_id, ord, coalesce(max(heading), 'PREAMBLE') as name, string_agg(case when heading is null then line else heading || ':' || chr(10) end, chr(10) order by pos) as body from od group by doc_id, ord),
st as (select doc_id, ord, name, {STRIP.format('body')} as text from sc),
sections as (select doc_id, row_number() over (partition by doc_id order by ord) - 1 as pos,
  case when name = 'PREAMBLE' and count(*) over (partition by doc_id) = 1 then 'FULL_TEXT' else name end as name, text from st where text <> '')"""

SPLIT = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))"


def chunks_of(table: str, keys: str, text: str) -> str:
    """CTEs that end in `merged`: (keys, chunk_index, chunk)."""
    return rf""",
sn as (select {keys}, {SPLIT.format(text)} as ss from {table}),
wc as (select *, list_transform(ss, lambda x: len(regexp_extract_all(x, '\S+'))) as ws from sn),
fold as (select {keys}, ss, ws, 0 as i, 0 as a, 0::bigint as n, null::int as ea, null::int as eb from wc
  union all
  select {keys}, ss, ws, i + 1,
    case when i >= len(ws) or n + ws[i + 1] <= 350 then a else greatest(i - 2, 0) end,
    case when i >= len(ws) then 0 when n + ws[i + 1] <= 350 then n + ws[i + 1] else list_sum(ws[greatest(i - 2, 0) + 1 : i + 1])::bigint end,
    case when i > 0 and (i >= len(ws) or n + ws[i + 1] > 350) then a end, case when i > 0 and (i >= len(ws) or n + ws[i + 1] > 350) then i end
  from fold where i <= len(ws) and len(ws) > 0),
raw as (select {keys}, i, array_to_string(ss[ea + 1 : eb], ' ') as chunk from fold where eb is not null),
num as (select *, row_number() over (partition by {keys} order by i) as k, len(regexp_extract_all(chunk, '\S+')) < 15 as tiny from raw),
grp as (select *, sum((not tiny or k = 1)::int) over (partition by {keys} order by k) as g from num),
merged as (select {keys}, g - 1 as chunk_index, string_agg(chunk, ' ' order by k) as chunk from grp group by {keys}, g)"""


CASE_NO = r"nullif(regexp_extract(text, 'G\.\s*R\.\s*No[s]?\.\s*([A-Za-z0-9\-]+)'), '')"
DIVISION = r"upper(nullif(regexp_extract(text, '(?i)\b(FIRST|SECOND|THIRD)\s+DIVISION\b|\bEN\s+BANC\b'), ''))"
TITLE = rf"""list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1:20], lambda x: not regexp_matches(x, '(?i)Republic of the Philippines|Supreme Court'))[1]"""

RAG = "with recursive " + SECTIONS + r""",
keyed as (select doc_id, pos as section_pos, name as section, text from sections)""" + chunks_of("keyed", "doc_id, section_pos, section", "text") + rf""",
meta as (select doc_id, {CASE_NO} as case_no, {DIVISION} as division, {TITLE} as title from decisions),
rag as (select meta.*, section_pos, section, chunk_index, chunk as text from merged join meta using (doc_id)),
old as (select distinct case_no from meta where case_no is not null and right(case_no, 1) in ('0', '3', '6', '9')),
new as (select case_no, arg_max(division, (doc_id, section_pos, chunk_index)) filter (where division is not null) as division, arg_max(title, (doc_id, section_pos, chunk_index)) filter (where title is not null) as title
  from rag where case_no is not null group by case_no),
cases as (select coalesce(new.case_no, old.case_no) as case_no, coalesce(new.division, case when old.case_no is not null then 'OLD DIVISION' end) as division, new.title from new full join old on new.case_no = old.case_no),
firsts as (select * from (select *, row_number() over (partition by case_no, section, chunk_index order by doc_id, section_pos) as rn from rag where case_no is not null) where rn = 1),
stored as (select case_no, 'FACTS' as section, 0::bigint as chunk_index, 'old' as text from old union all
  select f.case_no, f.section, f.chunk_index::bigint, f.text from firsts f where not exists (select 1 from old where old.case_no = f.case_no and f.section = 'FACTS' and f.chunk_index = 0))"""

BUCKETS = """words as (select id, ('0x' || substr(md5(w), 1, 4))::bigint % 16 as bucket from (select id, unnest(regexp_extract_all(t, '\\S+')) as w from src)),
counts as (select id, bucket, count(*) as n from words group by id, bucket),
vec as (select id, bucket::int as bucket, round((n / sqrt(sum(n * n) over (partition by id)))::float::double, 5) as weight from counts)"""

PART = "part as (select vec_id as id, 'text ' || vec_id as text, case when vec_id % 7 <> 0 then embedding end as embedding, case when vec_id % 7 <> 0 then 1 end as token_count from embeddings)"

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


TITLE_TAG = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def plain(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return STRIP.format(x)


DROP = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "nav", "header", "footer", "aside"))
HTML_TEXT = rf"""with m as (select page_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) as h from pages),
c as (select page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', chr(1), 'g'), '(?is){DROP}', chr(1), 'g'), '<[^>]*>', chr(1), 'g') as h from m)
select page_id, md5(regexp_replace(array_to_string(list_filter(list_transform(string_split(h, chr(1)), lambda x: {plain('x')}), lambda x: x <> ''), chr(10)), '\n{{2,}}', chr(10) || chr(10), 'g')) as text_md5 from c"""

ANCHORS = r"""unnest(range(1, len(regexp_extract_all(html, '<(?:h3|strong|a)\b[^>]*>[^<]*<')) + 1)) as pos, unnest(regexp_extract_all(html, '<(?:h3|strong|a)\b[^>]*>[^<]*<')) as x"""
MONTH_LINKS = rf"""{INDEX}, a as (select page_id, {ANCHORS} from index_pages),
b as (select page_id, pos, regexp_extract(x, '<(\w+)', 1) as tag, regexp_extract(x, '>([^<]*)<', 1) as label, '{SITE}' || regexp_extract(x, 'href="([^"]*)"', 1) as url from a),
c as (select *, last_value(case when tag <> 'a' and regexp_full_match(label, '(19|20)\d\d') then label end ignore nulls) over (partition by page_id order by pos rows unbounded preceding) as year from b),
e as (select page_id, pos, url, coalesce(nullif(regexp_extract(url, '/((?:19|20)\d\d)/', 1), ''), year, 'unknown') || '-' || label as month_key from c where tag = 'a' and label in ('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec')),
month_links as (select page_id, month_key, arg_max(url, pos) as url from e group by page_id, month_key)"""
DECISION_LINKS = rf"""{MONTH}, da as (select page_id, {ANCHORS} from month_pages),
db as (select page_id, regexp_extract(x, '>([^<]*)<', 1) as label, regexp_extract(x, 'href="([^"]*)"', 1) as href from da),
decision_links as (select distinct page_id, '{SITE}' || href as url from db where not contains(lower(href), 'printer') and regexp_matches(label, '(?i)\b(?:[A-Z]\.[A-Z]\.\s*No\.\s*\d+|[A-Z]{{1,5}}(?:-\d+)+)\b'))"""


def sql() -> dict[str, str]:
    return {
        "cosine_topk": f"with {TOP} select id, case_no, section, chunk_index, text, distance, similarity from top10",
        "cosine_distance": f"with {EMB} select id, distance from dist",
        "similarity": f"with {EMB} select id, similarity from dist",
        "search_response": f"with {TOP} select id, case_no, section, chunk_index, text as preview, distance, similarity from top10 order by raw, id limit 5",
        "result_table": f"with {TOP} select case_no, section, chunk_index, similarity, distance, text as preview from top10",
        "result_labels": f"with {TOP} select id, row_number() over (order by distance, id)::int as rank, printf('%.3f', similarity) as similarity_label, printf('%.4f', distance) as distance_label from top10",
        "ivf_lists": f"with {EMB}, {_LISTS} select id, list_id from own",
        "ivf_topk": f"with {EMB}, {_LISTS}, probes as (select list_id from cents, q order by round(greatest(list_cosine_distance(q, c), 0.0), 9), list_id limit 8) select id, list_id, distance, similarity from dist join own using (id) where list_id in (select list_id from probes) order by raw, id limit 10",
        "index_topk": f"with {EMB} select query_id, id, rank::int as rank, round(raw, 6) as distance from (select a.id as query_id, b.id, greatest(list_cosine_distance(b.e, a.e), 0.0) as raw, row_number() over (partition by a.id order by greatest(list_cosine_distance(b.e, a.e), 0.0), b.id) as rank from emb a, emb b where a.id % 20 = 0) where rank <= 10",
        "scan_chunks": f"with {EMB} select id, case_no, section, chunk_index, text from emb",
        "division_cut": rf"with {DECISIONS} select doc_id, md5(case when regexp_matches(text, '\n[A-Z ]+DIVISION\n') then ltrim(regexp_extract(text, '(?s)\n([A-Z ]+DIVISION\n.*)$', 1)) else text end) as text_md5 from decisions",
        "meta_case_no": f"with {DECISIONS} select doc_id, {CASE_NO} as case_no from decisions",
        "meta_division": f"with {DECISIONS} select doc_id, {DIVISION} as division from decisions",
        "meta_title": f"with {DECISIONS} select doc_id, {TITLE} as title from decisions",
        "word_count": r"select doc_id, len(regexp_extract_all(text, '\S+'))::bigint as n_words from documents",
        "heading_classify": f"with {LINES} select doc_id, pos::int as pos, heading from hd where heading is not null",
        "sections": f"with {SECTIONS} select doc_id, pos::int as pos, name, md5(text) as text_md5 from sections",
        "sentences": f"select doc_id, (i - 1)::int as pos, md5(ss[i]) as sentence_md5 from (select doc_id, {SPLIT.format('text')} as ss from documents), unnest(range(1, len(ss) + 1)) as u(i)",
        "sentences_legal": rf"with {DECISIONS}, kept as (select doc_id, regexp_replace(regexp_replace(text, '(^|[^A-Za-z])(G\.R|A\.M|A\.C|No|Nos|vs|v|Jr|Sr|Mr|Mrs|Ms|Dr|Atty|Hon|Art|Sec|Inc|Co|Corp|etc|e\.g|i\.e|[A-Z](?:\.[A-Z])*)\.(\s)', '\1\2' || chr(2) || '\3', 'g'), '(^|[^A-Za-z])(G\.R|A\.M|A\.C|No|Nos|vs|v|Jr|Sr|Mr|Mrs|Ms|Dr|Atty|Hon|Art|Sec|Inc|Co|Corp|etc|e\.g|i\.e|[A-Z](?:\.[A-Z])*)\.(\s)', '\1\2' || chr(2) || '\3', 'g') as t from decisions), ss as (select doc_id, {SPLIT.format('t')} as ss from kept) select doc_id, (i - 1)::int as pos, md5(replace(ss[i], chr(2), '.')) as sentence_md5 from ss, unnest(range(1, len(ss) + 1)) as u(i)",
        "chunks": f"with recursive dd as (select doc_id, text from documents){chunks_of('dd', 'doc_id', 'text')} select doc_id, chunk_index::int as chunk_index, md5(chunk) as chunk_md5 from merged",
        "chunks_arrow": f"with recursive dd as (select doc_id, text from documents){chunks_of('dd', 'doc_id', 'text')} select doc_id, chunk_index::int as chunk_index, md5(chunk) as chunk_md5 from merged",
        "rag_chunks": f"{RAG} select doc_id, case_no, division, title, section_pos::int as section_pos, section, chunk_index::int as chunk_index, md5(text) as text_md5 from rag",
        "decisions_upsert": f"{RAG} select case_no, division, title from cases",
        "chunks_upsert": f"{RAG} select case_no, section, chunk_index::int as chunk_index, md5(text) as text_md5 from stored",
        "chunk_decision_fk": f"{RAG} select case_no as decision_case_no, count(*) as n_chunks from stored join cases using (case_no) group by case_no",
        "fk_check": f"{RAG} select count(*) as n_orphans from stored where case_no not in (select case_no from cases)",
        "rejects": f"{RAG} select distinct doc_id from rag where case_no is null",
        "store_decisions": f"{RAG}, kept as (select * from rag where case_no is not null and not (doc_id % 2 = 0 and case_no like '%7')) select case_no, arg_max(division, (doc_id % 2, doc_id, section_pos, chunk_index)) filter (where division is not null) as division, arg_max(title, (doc_id % 2, doc_id, section_pos, chunk_index)) filter (where title is not null) as title from kept group by case_no",
        "store_chunks": f"{RAG}, kept as (select *, row_number() over (partition by case_no, section, chunk_index order by doc_id % 2, doc_id, section_pos) as rn from rag where case_no is not null and not (doc_id % 2 = 0 and case_no like '%7')) select case_no, section, chunk_index::int as chunk_index, md5(text) as text_md5 from kept where rn = 1",
        "stream_records": "select case when page_id % 9 <> 0 then 't' || page_id end as title, case when page_id % 9 <> 0 then url end as url, case when page_id % 9 <> 0 then md5(html) end as text_md5, case when page_id % 9 = 0 then '{page ' || page_id end as unusable from pages",
        "crawl_commits": "select url, case when page_id % 10 <> 0 then md5(html) end as text, case when page_id % 10 = 0 then '503' end as error from pages",
        "pending_embeddings": f"with {PART} select id, text from part where embedding is null",
        "pending_count": f"with {PART} select count(*) as n_pending from part where embedding is null",
        "embed_passage": f"with src as (select doc_id as id, 'passage: ' || text as t from documents), {BUCKETS} select id as doc_id, bucket, weight from vec",
        "embed_query": f"with src as (select doc_id as id, 'query: ' || text as t from documents), {BUCKETS} select id as doc_id, bucket, weight from vec",
        "token_count": r"select doc_id as id, len(regexp_extract_all(text, '\S+'))::int as token_count from documents",
        "embed_pending": f"with {PART}, src as (select id, 'passage: ' || text as t from part where embedding is null), {BUCKETS} select id, 2::int as token_count, bucket, weight from vec",
        "embed_update": f"with {PART}, src as (select id, 'passage: ' || text as t from part where embedding is null), {BUCKETS} select p.id, coalesce(case when embedding is null then 2 end, token_count)::int as token_count, case when embedding is null then 16 else len(embedding) end::int as dimension, coalesce(case when embedding is null then coalesce(weight, 0.0) end, round(embedding[1]::double, 5)) as first_weight from part p left join vec on vec.id = p.id and bucket = 0",
        "html_text": HTML_TEXT,
        "html_text_native": HTML_TEXT,
        "html_title": rf"select page_id, {plain(TITLE_TAG)} as title from pages",
        "month_links": f"with {MONTH_LINKS} select page_id, month_key, url from month_links",
        "decision_links": f"with {DECISION_LINKS} select page_id, url from decision_links",
        "crawl_fanout": f"with {MONTH_LINKS}, {DECISION_LINKS} select string_split(month_key, '-')[1] as year, string_split(month_key, '-')[2] as month, d.url from month_links m join decision_links d using (page_id)",
        "url_join": f"select page_id, href, case when regexp_matches(href, '^[a-z][a-z0-9+.-]*:') then href when starts_with(href, '//') then 'https:' || href when starts_with(href, '/') then '{SITE}' || href else '{SITE}/' || href end as url from (select page_id, unnest([url, '/p/' || page_id, 'q' || page_id, '//cdn.example/' || page_id]) as href from pages)",
        "url_key": "select page_id, sha1(url) as url_key from pages",
        "skip_done": "select page_id from pages where url not in (select url from pages where page_id % 3 = 0)",
        "cache_lookup": "select page_id, sha1(url) in (select sha1(url) from pages where page_id % 4 = 0) as cached from pages",
        "resume_after": "select page_id from pages where page_id > (select min(page_id) from pages where url = (select url from pages where page_id = 10))",
        "ordered_distinct": "select page_id % 10 as grp, page_id % 35 as value, min(page_id) as first_pos from pages group by 1, 2",
        "cap_per_month": "select month, page_id from (select page_id % 12 as month, page_id, row_number() over (partition by page_id % 12 order by page_id) as rn from pages) where rn <= 5",
        "jsonl_scan": "select page_id, '1996' as year, '' as month, 't' as title, url, 'x' as text from pages where page_id % 9 <> 0",
    }


_LISTS = """cents as (select label as list_id, list(v order by i) as c from (select label, i, avg(e[i]) as v from emb, unnest(range(1, len(e) + 1)) as u(i) group by label, i) group by label),
own as (select id, arg_min(list_id, (round(greatest(list_cosine_distance(e, c), 0.0), 9), list_id)) as list_id from emb, cents group by id)"""
