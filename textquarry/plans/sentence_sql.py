"""DuckDB SQL for the trained sentence splitter: its statistics, and the sentences that they give."""

from __future__ import annotations

from .oracle import DECISIONS

TOKENS = DECISIONS + r""",
ws as (select doc_id, regexp_extract_all(text, '\S+') as ws from decisions),
wd as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from ws),
co as (select *, regexp_extract(w, '(?s)\A["''(\[{<]*(.*?)["'')\]}>,;:]*\z', 1) as core from wd),
ba as (select *, lower(regexp_replace(core, '[.!?]+\z', '')) as bare, substr(core, 1, 1) as f from co),
tk as materialized (select doc_id, i, w, case when regexp_matches(bare, '\A[-+]?[0-9][0-9.,-]*\z') then '##' else bare end as type,
  case when f <> lower(f) then 'u' when f <> upper(f) then 'l' else '' end as kase,
  core like '%.' and core not like '%..' as dot, regexp_matches(core, '[!?]\z') as stop, core like '%..' as dots from ba),
ty as (select type, sum(dot::int)::bigint as stops, sum((not dot)::int)::bigint as others from tk group by type),
tot as (select sum(stops)::double as np, sum(stops + others)::double as n from ty),
ab as (select type, stops, others, -2 * (stops * (ln(np / n) - ln(0.99)) + others * (ln(1 - np / n) - ln(0.01)))
    * exp(-(len(type) - inn)) * (inn + 1) * pow((len(type) - inn)::double, -others) as score
  from (select *, len(type) - len(replace(type, '.', '')) as inn from ty), tot where stops > 0 and type <> '##' and regexp_matches(type, '\p{L}')),
known as (select type from ab where score >= 0.3)"""

CONTEXTS = TOKENS + r""",
pv as (select *, lag(type) over o as bt, lag(dot) over o as bdot, lag(stop) over o as bstop, lag(dots) over o as bdots, lag(i) over o is null as first from tk window o as (partition by doc_id order by i)),
cx as materialized (select *, coalesce(bdots or (bdot and (bt in (from known) or bt = '##' or len(bt) = 1)), false) as doubtful,
  coalesce((bdot and not (bt in (from known) or bt = '##' or len(bt) = 1)) or bstop, true) as starts from pv),
tn as (select type, count(*)::double as n, sum((starts and not first)::int)::double as "at" from cx group by type),
tt as (select sum(n) as n_all, sum("at") as n_at from tn)"""


def chance(n: str, a: str, b: str, ab: str) -> str:
    part = lambda hits, of, p: f"(case when {hits} > 0 then {hits} * ln({p}) else 0 end + case when {of} > {hits} then ({of} - {hits}) * ln(1 - {p}) else 0 end)"
    rest, others = f"({b} - {ab})", f"({n} - {a})"
    ratio = f"2 * ({part(ab, a, f'({ab} / {a})')} + {part(rest, others, f'({rest} / {others})')} - {part(ab, a, f'({b} / {n})')} - {part(rest, others, f'({b} / {n})')})"
    return f"case when {ab} * {n} > {a} * {b} and {n} > {a} then {ratio} else 0 end"


LEARNED = CONTEXTS + f""",
st as (select type, n::bigint as n, "at"::bigint as "at", {chance('n_all', 'n_at', 'n', '"at"')} as score from tn, tt where "at" > 0 and type <> '##' and regexp_matches(type, '\\p{{L}}')),
pr as (select bt, type, count(*)::double as n from cx where doubtful and bdot and bt <> '' and regexp_matches(type, '[\\p{{L}}\\p{{N}}]|##') group by bt, type having count(*) > 1),
cl as (select bt as before, pr.type, pr.n::bigint as n, {chance('n_all', 'a.n', 'b.n', 'pr.n')} as score from pr join tn a on a.type = bt join tn b on b.type = pr.type, tt),
ks as (select type, bool_or(kase = 'l') as lower, bool_or(kase = 'u') as upper, bool_or(kase = 'l' and starts) as lower_at_start, bool_or(kase = 'u' and not starts and not doubtful) as upper_within
  from cx group by type having bool_or(doubtful))"""

SENTENCES = LEARNED + r""",
nx as (select c.*, k.type is not null as listed, bt = '##' as number, s.type is not null as starter, coalesce(l.type is not null and not bdots, false) as together,
    case when kase = 'u' and ks.lower and not ks.upper_within then true when kase = 'l' and (coalesce(ks.upper, false) or not coalesce(ks.lower_at_start, false)) then false end as likely,
    coalesce(ks.lower, false) as seen_lower, lag(w) over (partition by doc_id order by i) as bw
  from cx c left join known k on k.type = c.bt left join (select type from st where score >= 30) s on s.type = c.type
  left join (select before, type from cl where score >= 7.88) l on l.before = c.bt and l.type = c.type left join ks on ks.type = c.type),
ct as (select doc_id, i, w, case when bw is null or not regexp_matches(bw, '[.!?]["'')\]}>]*\z') then false when bstop then true
    when not doubtful then true when together then false
    when listed or bdots then coalesce(likely, false) or (kase = 'u' and starter)
    when likely is not null then likely else not (kase = 'u' and not seen_lower and not number) and kase <> 'l' end as cut from nx),
sn as (select doc_id, i, w, sum(cut::int) over (partition by doc_id order by i) as pos from ct)
select doc_id, pos::int as pos, count(*) as n_words, md5(string_agg(w, ' ' order by i)) as words_md5 from sn group by doc_id, pos"""


def sql() -> dict[str, str]:
    return {
        "sentence_abbreviations": f"with {TOKENS} select type, stops, others, round(score, 4) + 0.0 as score from ab",
        "sentence_starters": f'with {LEARNED} select type, n, "at", round(score, 4) + 0.0 as score from st',
        "sentence_collocations": f"with {LEARNED} select before, type, n, round(score, 4) + 0.0 as score from cl",
        "sentences_trained": f"with {SENTENCES}",
    }
