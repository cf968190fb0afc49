"""Each operator against a plain version, and on rows that are null, empty, very long, equal, missing or oddly named."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textquarry.llm import decontam, graph, mixing, neardup, pii, pitmanyor, quality, secrets, toxicity, unitdedup, warc
from textquarry.llm.common import Scratch, shared_dir, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows and ids, and columns that operators use inside."""
    rng = random.Random(3)
    long = words(rng, 40_000)
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, long, "b"), (4, long, "b"), (5, "x" * 50_000, None), (None, "some text of a row without an id", "a"), (6, "dup one two three four five six", "a"), (7, "dup one two three four five six", "c"), (6, "other text with the same id", "a"), (8, "zwei 😀 wörter", "b")]
    df = docs_of(spark, rows)
    return df.withColumns({c: F.lit("clash") for c in ("score", "quality", "secrets", "decontamination", "tq_size", "word", "n", "node", "rank", "key")})


def ids(df, column="doc_id"):
    return collections.Counter(r[column] for r in df.collect())


def test_empty_tables(spark):
    none = docs_of(spark, []).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality(none).count() == secrets.secrets(none).count() == neardup.near_duplicates(none).count() == 0
    assert decontam.decontamination(none, items).count() == pii.personal_data(none).count() == mixing.mixed(none).count() == 0
    assert unitdedup.deduplicated(none).count() == pitmanyor.scored(written(none, "none")).count() == 0
    machine = toxicity.learned(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.toxicity(none, machine).count() == 0
    assert warc.read_back(spark, warc.write(none, corpus_folder(spark), "doc_id", "lang", "text")).count() == 0


def corpus_folder(spark):
    from textquarry.llm.common import scratch

    return scratch(spark, "t")


# ---- 1 quality ----


def test_quality_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.quality for r in quality.quality(docs).collect()}
    b = {r.doc_id: r.quality for r in quality.quality(docs, rules=quality.RULES[::-1], sample=0).collect()}
    assert a == b and len({x.kept for x in a.values()}) == 2


def test_quality_cascade_puts_rejection_per_cost_first():
    slow = quality.Rule("slow", lambda d: (sum(range(200_000)), d.n_words > 60)[1])
    never = quality.Rule("never", lambda d: False)
    quick = quality.Rule("quick", lambda d: d.n_words > 60)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(50, 80)]
    assert [r.name for r in quality.ordered(texts, (never, slow, quick))][0] == "quick"


def test_quality_repeats_and_odd_rows(spark, odd):
    rng = random.Random(1)
    for _ in range(50):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(30))]
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        want = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        assert quality.repeated_words(w) == len(want)
    got = quality.quality(odd).collect()
    assert len(got) == 11 and all(r.quality == "clash" and r.quality_.base_failed and not r.quality_.kept for r in got if r.text is None or not r.text.strip())


# ---- 2 secrets ----


def base_by_rule(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secret_base_spans():
    rng = random.Random(2)
    pieces = ["token", "PassWord", "api_key", "secret", "=", ":", " ", '"', "AKIA", "0a1f" * 7, "ABCDEFGH12345678", "x", "é", "abcdefg", "ſecret:abcdefgh", "\n", "aKey"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert secrets.base_spans(text) == base_by_rule(text), text


def test_guess_cost_is_the_cheapest_segmentation():
    cost = secrets.guess_cost
    assert cost("password1") < cost("P@ssw0rd1") < cost("x9$kQ2mZ7!")
    assert cost("qwertyuiop") < 4 and cost("aaaaaaaaaa") < 4.5 and cost("2019-01-02") < 5 and cost("abcdefgh") < 4 and cost("xyzxyzxyzxyz") < 6
    assert cost("zq7#Lw") == pytest.approx(sum(math.log10(secrets._alphabet(c)) for c in "zq7#Lw"))
    assert cost("dragonmonkey") == pytest.approx(math.log10(secrets.RANK["dragon"] + 1) + math.log10(secrets.RANK["monkey"] + 1) + math.log10(2))



def cheapest(value, rank):
    """Over all segmentations into segments of every kind, each described for itself."""
    low, log = value.lower(), math.log10

    def kinds(i, j):
        part, own = low[i:j], []
        size = j - i
        if size == 1:
            own.append((log(secrets._alphabet(value[i])), 0.0))
        upper = log(2) if value[i:j] != part else 0.0
        if size >= 3 and part in rank:
            own.append((log(rank[part] + 1) + upper, 1.0))
        elif size >= 3 and part.translate(secrets.LEET) in rank:
            own.append((log(rank[part.translate(secrets.LEET)] + 1) + upper + log(4), 1.0))
        if secrets.DATE.fullmatch(value[i:j]):
            own.append((log(365 * 120) if size > 4 else log(150), 1.0))
        if size >= 3 and all(p in secrets.NEXT for p in zip(part, part[1:])):
            own.append((log(47 * 4 * size), 1.0))
        if size >= 3 and {ord(b) - ord(a) for a, b in zip(part, part[1:])} in ({1}, {-1}):
            own.append((log(72 * size), 1.0))
        for unit in range(1, 9):
            if size % unit == 0 and size >= max(3, 2 * unit) and part == part[:unit] * (size // unit):
                own.append((sum(log(secrets._alphabet(c)) for c in value[j - unit : j]) + log(size // unit + 1), 1.0))
        return [c + (log(2) if more and i else 0.0) for c, more in own]

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + c for i in range(j) for c in kinds(i, j)))
    return best[-1]


def test_guess_cost_is_the_minimum_over_all_segments():
    rng = random.Random(18)
    pieces = ["pass", "p@ss", "Word", "love", "sss", "aaaa", "2019", "19-02-2001", "2001", "qwer", "gfds", "abc", "cba", "xyxy", "Zq", "7", "k", "!", "é", "121212"]
    assert secrets.guess_cost("passssss") <= 2.9
    for _ in range(1500):
        v = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        assert secrets.guess_cost(v) == pytest.approx(cheapest(v, secrets.RANK)), v
    assert secrets.guess_cost("ab" * 3000) == pytest.approx(2 * math.log10(26) + math.log10(3001)) and secrets.guess_cost("") == 0 and secrets.guess_cost("İ" * 10) > 0


def test_secrets_planted_among_prose(spark):
    """Every random value is found, and no ordinary phrase, in a corpus that uses the phrases' words."""
    rng = random.Random(20)
    prose = "well known john smith documentation setup case insensitive important changed daily required".split()
    rows = [(i, " ".join(rng.choice(prose) for _ in range(30)), "a") for i in range(30)]
    plain = ["the passphrase is well-known", "login: john.smith", "credentials: documentation/setup", "token is case-insensitive", "password is required", "the passcode: changed.daily"]
    rows += [(100 + i, t, "a") for i, t in enumerate(plain)]
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789#!$"
    values = ["".join(rng.choice(k) for _ in range(rng.randrange(12, 24))) for k in [letters, mixed] * 20]
    rows += [(200 + i, f"the {rng.choice(['passphrase is', 'pwd:', 'login =', 'credentials:'])} {v} ok", "a") for i, v in enumerate(values)]
    got = {r.doc_id: r.secrets.spans for r in secrets.secrets(docs_of(spark, rows)).collect()}
    assert [t for i, t in enumerate(plain) if got[100 + i]] == []
    assert [v for i, v in enumerate(values) if not got[200 + i]] == []


def test_secrets_in_context_and_odd_rows(spark, odd):
    rows = [(1, 'pwd: "k#9Lz!q2Xw7" ok', "a"), (2, "the password is dragon", "a"), (3, "pwd: qwertyuiop1 and secret = abc", "a"), (4, "token = 'abcdef' 😀 login: Zx81#kQm2p", "a")]
    got = {r.doc_id: r.secrets for r in secrets.secrets(docs_of(spark, rows), redact=True).collect()}
    assert got[1].spans == "guess:6:17" and got[1].redacted == 'pwd: "[SECRET]" ok' and got[2].spans == got[3].spans == ""
    assert got[4].spans == "assign:0:15,guess:26:36" and got[4].n_assign == 1 and got[4].base_sha256 == hashlib.sha256(b"assign:0:15").hexdigest()
    assert ids(secrets.secrets(odd, redact=True)) == ids(odd) and secrets.secrets(odd).columns == [*odd.columns, "secrets_"]


def test_secrets_of_letters_or_digits_alone(spark):
    rows = [(1, "pwd: XqZvKjWmPtRb", "a"), (2, "the passphrase is kvqhzxwpljtn", "a"), (3, "login: 839201746552", "a"), (4, "the password is important", "a")]
    rows += [(10 + i, "what is important is said here", "a") for i in range(6)] + [(20 + i, "the passphrase is kvqhzxwpljtn", "a") for i in range(6)]
    got = {r.doc_id: r.secrets.spans for r in secrets.secrets(docs_of(spark, rows)).collect()}
    assert got[1] == "guess:5:17" and got[2] == got[20] == "guess:18:30" and got[3] == "guess:7:19" and got[4] == ""


# ---- 3 toxicity ----


def test_machine_learns_a_pair():
    """Neither term says anything alone; both together do."""
    rng = random.Random(4)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["folk"] * b + [f"n{rng.randrange(50)}" for _ in range(5)]))
        labels.append(float(a and b))
    terms = [toxicity.terms(t) for t in texts]
    m = toxicity.trained(terms, toxicity.np.array(labels), toxicity.terms("insult folk"))
    column = {b: i for i, b in enumerate(m.buckets.tolist())}

    def score(t):
        return m.score(toxicity.np.array(sorted(column[b] for b in toxicity.terms(t).tolist() if b in column), int))

    assert score("insult folk") > 0.7 > 0.4 > max(score("insult"), score("folk"), score("n1 n2"), score(""))


def test_terms_that_tell_something_only_together(spark):
    """Each of two words alone or none: as often toxic as not by itself; the pair decides. Learned from texts, through the choice of terms."""
    rng = random.Random(24)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(["insulting"] * a + ["folkname"] * b + [f"n{rng.randrange(400)}" for _ in range(5)]), "a"))
        labels.append((i, 0, int(a == b)))
    machine = toxicity.learned(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    column = {b: i for i, b in enumerate(machine.buckets.tolist())}
    score = lambda t: machine.score(toxicity.np.array(sorted(column[b] for b in toxicity.terms(t).tolist() if b in column), int))
    assert min(score("insulting folkname n1"), score("n1 n2")) > 0.7 > 0.3 > max(score("insulting n1"), score("folkname n3"))


def test_toxicity_score_is_the_sum_over_pairs():
    np = toxicity.np
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(9, dtype=np.int32), 0.3, rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS)))
    for n in range(6):
        own = rng.choice(9, n, replace=False)
        y = 0.3 + sum(m.weights[i] for i in own) + sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(own, 2))
        assert m.score(np.array(sorted(own), int)) == pytest.approx(1 / (1 + math.exp(-y)))


def test_toxicity_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op3_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit >= 0.6 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)
    machine = toxicity.learned(odd, spark.createDataFrame([(1, 1, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    scored = toxicity.toxicity(odd, machine)
    assert ids(scored) == ids(odd) and all(0 <= r.score_ <= 1 and r.score == "clash" for r in scored.collect())


# ---- 4 near duplicates ----


def shingle_set(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[i:] for i in range(5)))) if w else set()


def components_by_rule(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    """A large loose group, chains, short texts and copies."""
    rng = random.Random(6)
    texts = []
    seed = words(rng, 120).split()
    for _ in range(150):
        w = list(seed)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(30)}"
        texts.append(" ".join(w))
    chain = words(rng, 60).split()
    for _ in range(30):
        chain[rng.randrange(len(chain))] = f"c{rng.randrange(9999)}"
        texts.append(" ".join(chain))
    texts += [words(rng, rng.randrange(1, 9), 12) for _ in range(80)] + [texts[0].upper(), texts[3], "", "A b", "a  B", "a b c"]
    texts += [" ".join([words(rng, 30), *seed[:60]]) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == components_by_rule(rows)


def test_near_duplicates_in_small_fragments_and_by_entries(spark, monkeypatch):
    """The result doesn't depend on how blocks are cut, and nothing but tables that the result reads is left."""
    rng = random.Random(16)
    texts = []
    for _ in range(4):
        seed = words(rng, 60).split()
        for _ in range(25):
            w = list(seed)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(30)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    docs, want = docs_of(spark, [(i, t, "a") for i, t in rows]), components_by_rule(rows)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    for large in (1, 40):
        monkeypatch.setattr(neardup, "FRAGMENT", 7)
        monkeypatch.setattr(neardup, "LARGE", large)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()} == want
    folder = shared_dir(spark).removeprefix("file://")
    left = [x for x in os.listdir(folder) if x.split("-")[0] in ("sets", "entries", "members", "open", "joined", "near", "hub", "block")]
    assert left == []


def test_block_counts_are_exact():
    rng = random.Random(17)
    for _ in range(30):
        sets = [neardup.np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), "uint64") for _ in range(9)]
        got = neardup.alike(sets, neardup.np.arange(4), neardup.np.arange(4, 9))
        assert got.tolist() == [[100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b)) for b in sets[4:]] for a in sets[:4]]


def test_near_duplicates_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd)
    assert ids(got) == ids(odd)
    rows = {(r.doc_id, r.component_id, r.kept) for r in got.collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (6, 6, True), (7, 6, False), (4, 4, True)} <= rows


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(500, x) for x in range(501, 600)] + [(7, 7)]
    with Scratch(spark) as temp:
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), temp).collect()}
        assert graph.components(spark.createDataFrame([], "a long, b long"), temp).count() == 0
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_signature_distance_guarantee():
    """Signatures within the guaranteed distance share an entry."""
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.randrange(1 << 12) for _ in range(40)]
        b = list(a)
        for i in rng.sample(range(40), neardup.ERRORS * neardup.CHUNKS + neardup.CHUNKS - 1):
            b[i] ^= 1 + rng.randrange(4095)
        chunks = [(a[i : i + 5], b[i : i + 5]) for i in range(0, 40, 5)]
        assert any(sum(x != y for x, y in zip(p, q)) <= 1 for p, q in chunks)


# ---- 5 lines and sentences ----


@pytest.mark.parametrize("hot", [3, 10_000])
def test_units_against_plain_grouping(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(unitdedup, "HOT", hot)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["rank"]: r for r in unitdedup.by_document(docs).collect()}
    seen = set()
    for r in docs.orderBy("doc_id").collect():
        removed = []
        for digest, a, b in unitdedup.units(r.text):
            removed += [(a, b)] if digest in seen else []
            seen.add(digest)
        assert [(x["start"], x["end"]) for x in got[r.doc_id].removed or []] == removed and got[r.doc_id].n_units == len(unitdedup.units(r.text))
    assert ids(unitdedup.deduplicated(odd)) == ids(odd)


def units_by_rule(text, least):
    """(words, start, end) of all units: runs that reach `least` words, and don't without their last piece or without their first."""
    pieces, at = [], 0
    for line in text.split("\n"):
        cuts, i = [], 0
        while i < len(line):
            j = i
            while j < len(line) and line[j] in ".!?…":
                j += 1
            if j > i:
                while j < len(line) and line[j] in "\"')]»”":
                    j += 1
                cuts += [j] if line[j : j + 1] and line[j] in " \t\x0b\x0c\r" else []
            i = max(j, i + 1)
        for a, b in zip([0, *cuts], [*cuts, len(line)]):
            found = list(re.finditer(r"[^ \t\x0b\x0c\r]+", line[a:b]))
            if found:
                pieces.append((at + a + found[0].start(), at + a + found[-1].end(), [m[0].lower() for m in found]))
        at += len(line) + 1
    out, first = [], {}
    words = lambda i, j: [w for p in pieces[i : j + 1] for w in p[2]]
    for i in range(len(pieces)):
        for j in range(i, len(pieces)):
            if len(words(i, j)) >= least and (len(words(i, j - 1)) < least or len(words(i + 1, j)) < least):
                k, end = first.setdefault(tuple(words(i, j)), (i, j))
                a = k if k < i <= end else i
                out.append((" ".join(words(a, j)), pieces[a][0], pieces[j][1]))
    return sorted(out, key=lambda u: u[1:])


@pytest.mark.parametrize("least", [1, 3, 8])
def test_units_are_cut_as_the_rule_says(least):
    rng = random.Random(30 + least)
    parts = ["a", "B", "la la", "word", ". ", "! ", '." ', ".) ", "...", "…\t", "?", "\n", "\n\n", " ", "\r\n", "é😀", "x.y", "one two three four five", ".)! "]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = units_by_rule(text, least)
        got = unitdedup.units(text, least)
        assert [u[1:] for u in got] == [u[1:] for u in want], repr(text)
        same = {}  # equal words have equal digests, and others have others
        for (digest, *_), (words, *_) in zip(got, want):
            assert same.setdefault(words, digest) == digest
        assert len(set(same.values())) == len(same)


def test_units_of_a_short_footer(spark):
    """With a unit of one word a line that ends every document stays in the first alone."""
    rows = [(i, f"Document {i} says this.\nSubscribe to our newsletter today", "a") for i in range(5)]
    got = {r.doc_id: r.text for r in unitdedup.deduplicated(docs_of(spark, rows), min_words=1).collect()}
    assert got == {0: rows[0][1]} | {i: f"Document {i} says this." for i in range(1, 5)}


def test_units_keep_offsets_and_the_first(spark):
    passage = "One passage of many words that stands in several documents. It has a second sentence of eight or more words."
    rows = [(2, f"Own line here.\n{passage}\nEnd of two", "a"), (1, passage, "a"), (3, f"A lead sentence of this one document and nobody else. {passage}", "a"), (4, None, "a")]
    got = {r.doc_id: r for r in unitdedup.deduplicated(docs_of(spark, rows)).collect()}
    assert got[1].text == passage and got[1].tq_removed is None and got[4].text is None
    assert got[2].text == "Own line here.\nEnd of two" and got[3].text == "A lead sentence of this one document and nobody else."
    text = dict((i, t) for i, t, _ in rows)[3]
    assert " ".join(text[x["start"] : x["end"]] for x in got[3].tq_removed) == passage


def test_units_of_short_lines_and_other_lead_ins(spark):
    verse = "\n".join(f"line {i} of verse" for i in range(15))
    talk = " ".join(f"Say {i} of five words." for i in range(12))
    rows = [(1, verse, "a"), (2, f"Own heading\n{verse}\nOwn end", "a"), (3, talk, "a"), (4, f"Three words lead. {talk} And a tail.", "a"), (5, "\n".join(["la la la la"] * 11), "a")]
    got = {r.doc_id: r.text for r in unitdedup.deduplicated(docs_of(spark, rows)).collect()}
    assert got == {1: verse, 2: "Own heading\nOwn end", 3: talk, 4: "Three words lead. And a tail.", 5: "la la la la\nla la la la"}
    docs = docs_of(spark, rows)
    covered = unitdedup.by_document(docs).select("rank", unitdedup.stretches("removed").alias("s")).collect()
    assert {r["rank"]: [(x.start, x.end) for x in r.s] for r in covered}[2] == [(12, 12 + len(verse))]


# ---- 6 decontamination ----


def found_by_rule(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w = cut(text)
    hit, own = set(), set()
    for item, t in items:
        v = cut(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            g = v[i : i + 10]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    own.add(str(item))
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


def test_decontamination_in_one_and_more_blocks(spark, odd, monkeypatch):
    rng = random.Random(9)
    items = [(i, words(rng, n, 40)) for i, n in enumerate((1, 3, 9, 10, 11, 30, 25, 0))] + [(90, None), (10, words(rng, 12, 40))]
    texts = [words(rng, 30, 40) for _ in range(20)] + [f"{words(rng, 5)}, {t.upper() if t else ''}! {words(rng, 4)}" for _, t in items] + ["", None]
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: found_by_rule(t, items) for i, t in enumerate(texts)}
    for block in (decontam.BLOCK_WINDOWS, 10):
        monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
        assert {r.doc_id: tuple(r.decontamination) for r in decontam.decontamination(docs, benchmark).collect()} == want
        both = decontam.decontamination(odd, benchmark)
        assert ids(both) == ids(odd) and both.columns == [*odd.columns, "decontamination_"] and {r.decontamination for r in both.collect()} == {"clash"}


def test_decontamination_of_many_items_with_a_common_first_word():
    """A look-up costs the same however many prefixes begin with one word."""
    import time

    rng = random.Random(19)
    windows = {(b"the", *(b"u%d" % rng.randrange(10**9) for _ in range(9))): {str(i)} for i in range(20_000)}
    counts = collections.Counter({s: 5 for w in windows for s in decontam.shingles_of(w)[1:]})  # the pair that begins with "the" is the rarest
    index = decontam.Index(windows, counts)
    text = [b"the", b"x"] * 5000 + list(next(iter(windows))) + [b"the"] * 100
    began = time.perf_counter()
    hit, items = index.hits(text)
    assert time.perf_counter() - began < 0.5 and hit.count(1) == 10 and items == {"0"}


# ---- 7 personal data ----

PII = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in (int(c) * (1 + i % 2),)) % 10 == 0


def pii_by_rule(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    keep = (lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15)
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted((m.start(), k, m.end()) for k in range(4) for m in PII[k].finditer(text or "") if keep[k](m)))


def test_pii_base_spans(spark, odd):
    rng = random.Random(10)
    pieces = ["a@b.com", "_x", "@", "d.org", ".", "1.2.3.4", "255", "999", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (437) 555-0689", "+", "-", " ", "é😀", "x%y", "00000001", "12345678901234567", "5500000000000004", "\n", "("]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(1500)]
    texts += ["a@b" + ".c" * 3000, "+" + "1 " * 4000, "1.2.3." * 2000]
    got = {r.doc_id: r.s for r in pii.personal_data(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).select("doc_id", pii.spans_text(F.col("base")).alias("s")).collect()}
    assert all(got[i] == pii_by_rule(t) for i, t in enumerate(texts)), [(t, got[i], pii_by_rule(t)) for i, t in enumerate(texts) if got[i] != pii_by_rule(t)][:2]
    assert ids(pii.personal_data(odd)) == ids(odd)
    hard = docs_of(spark, [(1, "a" * 300_000, "a"), (2, "1" * 300_000, "a"), (3, "a@" * 100_000, "a")])
    assert pii.personal_data(hard).count() == 3


@pytest.mark.parametrize("blank", [" ", ";"])
def test_pii_of_texts_with_very_many_spans(spark, blank):
    """Time in proportion to the text; words that stand far off count as those that stand near."""
    seconds = []
    for n in (2_000, 60_000):
        text = blank.join(f"mail u{i}@example.com XK-{i:07d}" if blank == " " else f"u{i}@example.com" for i in range(n)) + " card" + " " * 5000 + "4111 1111 1111 1111"
        began = time.perf_counter()
        got = pii.personal_data(docs_of(spark, [(1, text, "a")])).first()
        seconds.append(time.perf_counter() - began)
        assert len(got.base) == n + 1 and all(text[s.start : s.end] == s.value for s in got.base)
        own = pii.instances(docs_of(spark, [(1, text, "a")]), "doc_id", "text").select(F.element_at("seeds", -1).alias("s")).first().s
        assert own.value == "4111 1111 1111 1111" and "b card" in own.patterns
    assert seconds[1] < 10 * seconds[0] + 10, seconds


def test_pii_contexts_find_new_identifiers(spark):
    rows = [(i, f"hello memberid: user{i}@example.com and the end", "a") for i in range(6)] + [(100 + i, f"filler memberid: XK-{i}4471-77 then the word", "a") for i in range(4)]
    rows += [(200, "the AB-123456 is other", "a")] + [(300 + i, f"for u{i}@example.com only for us and for all", "a") for i in range(9)] + [(400, "for AB-99887766 it is not enough", "a")]
    got = {r.doc_id: r.s for r in pii.personal_data(docs_of(spark, rows)).select("doc_id", pii.spans_text(F.col("spans")).alias("s")).collect()}
    assert all(got[100 + i] == "context:17:28" for i in range(4)) and got[200] == got[400] == "" and got[0] == "email:16:33"


def test_pii_contexts_with_copies_and_more_new_identifiers_than_known(spark):
    rows = [(i, f"hello memberid: user{i}@example.com and the end", "a") for i in range(6)] + [(10 + i, "hello memberid: user0@example.com and the end", "a") for i in range(30)]
    rows += [(50 + i, "filler memberid: XK-4471-77 then the word", "a") for i in range(20)]
    rows += [(100 + i, f"my account a{i}@example.com here", "a") for i in range(10)] + [(120 + i, f"an account QQ-{i}88123 here", "a") for i in range(10)]
    rows += [(200 + i, f"reach b{i}@example.com or reach us all and reach them", "a") for i in range(8)] + [(220, "reach ZZ-5566778 now", "a")]
    rows += [(300 + i, f"host 10.0.0.{i}@example.com there", "a") for i in range(5)] + [(310 + i, f"host of all {i} of them", "a") for i in range(4)] + [(320, "host YY-5566778 now", "a")]
    got = {r.doc_id: r.s for r in pii.personal_data(docs_of(spark, rows)).select("doc_id", pii.spans_text(F.col("spans")).alias("s")).collect()}
    assert all(got[50 + i] == "context:17:27" for i in range(20)) and all(got[120 + i] == "context:11:20" for i in range(10)) and got[220] == got[320] == ""


def contexts_by_rule(texts):
    """Occurrences (text, place among words) of believed instances, for texts whose words stand one blank apart."""
    split = [t.split(" ") for t in texts]
    seed = lambda w: PII[0].fullmatch(w) is not None
    like = lambda w: len(w) >= 6 and sum(c.isdigit() for c in w) >= 3 and not seed(w)
    graph, total = collections.Counter(), collections.Counter()
    for words in split:
        for i, w in enumerate(words):
            b, t, a = (words[k] if 0 <= k < len(words) else None for k in (i - 1, i - 2, i + 1))
            c = words[i + 2] if i + 2 < len(words) else None
            total.update([("b", w), ("t", b, w), ("a", w), ("s", w, c)])
            if seed(w) or like(w):
                graph.update((p, w) for p in (("b", b), ("t", t, b), ("a", a), ("s", b, a)) if None not in p)
    score = {w: 1.0 for words in split for w in words if seed(w)}
    while True:
        good, open_, support = collections.Counter(), collections.Counter(), collections.Counter()
        for (p, w), n in graph.items():
            good[p] += n * score.get(w, 0)
            support[p] += w in score
            open_[p] += 0 if w in score else n
        sure = {p: min(good[p] / (total[p] - open_[p]), 0.999) for p in support if support[p] >= 4 and total[p] > open_[p] and good[p] >= 0.6 * (total[p] - open_[p])}
        new = dict(score)
        for w in {w for _, w in graph}:
            s = 1 - math.prod(1 - sure[p] for p, v in graph if v == w and p in sure)
            if s >= 0.6:
                new[w] = max(new.get(w, 0), s)
        if len(new) == len(score):
            return {(k, i) for k, words in enumerate(split) for i, w in enumerate(words) if like(w) and w in new}
        score = new


def test_pii_graph_against_a_plain_version(spark):
    rng = random.Random(22)
    texts = []
    for _ in range(400):
        out = []
        for _ in range(rng.randrange(1, 5)):
            own = rng.choice([f"u{rng.randrange(40)}@example.com", f"XK-{rng.randrange(60)}4471", f"zz{rng.randrange(9)}9981"])
            out += [rng.choice(["plain", "words", "here", "uid"]) for _ in range(rng.randrange(3))]
            out += rng.choice([["memberid:", own], ["my", "uid", own], [own, "signed"], ["from", own, "to"], ["plain", own], [own, own + "7"]])
        texts.append(" ".join(out))
    want = contexts_by_rule(texts)
    got = set()
    for r in pii.personal_data(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect():
        got |= {(r.doc_id, texts[r.doc_id][: s.start].count(" ")) for s in r.spans if s.kind == 4}
    assert got == want and 10 < len(want) < sum(t.count("4471") + t.count("9981") for t in texts)


def test_pii_finds_planted_identifiers(spark):
    """Unseen identifiers in the contexts of known ones, of which a part is in two-word, right-hand or chained contexts, and others in none."""
    rng = random.Random(23)
    fill = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(8))
    frames = ["{} contact handle {} {}", "{} {} enrolled {}", "{} badge {} {}"]
    known = [f.format(fill(), *([f"p{i}@example.com", fill()])) for i in range(12) for f in frames]
    planted = [(f.format(fill(), f"ID-{rng.randrange(10**6, 10**7)}", fill()), True) for _ in range(20) for f in frames]
    others = [(f"{fill()} {w} ZZ-{rng.randrange(10**6, 10**7)} {fill()}", False) for w in ("order", "page", "was") for _ in range(15)]
    rows = [(i, t, "a") for i, t in enumerate(known)] + [(1000 + i, t, "a") for i, (t, _) in enumerate(planted + others)]
    got = {r.doc_id: [s for s in r.spans if s.kind == 4] for r in pii.personal_data(docs_of(spark, rows)).collect()}
    hit = [bool(got[1000 + i]) for i in range(len(planted + others))]
    assert all(h == w for h, (_, w) in zip(hit, planted + others))


# ---- 8 mixing ----


def test_targets_and_sampling(spark, odd):
    rng = random.Random(11)
    rows = [(i, words(rng, 1 + min(int(rng.paretovariate(1.1) * 5), 3000)), rng.choice(["a"] * 20 + ["b"] * 6 + ["c", "d", None])) for i in range(4000)]
    got = mixing.mixture(docs_of(spark, rows), mixing.size_of("text")).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r.tq_copies <= 3 and r.tq_size == len(r.text.split())
        size[r.source] += r.tq_size
        taken[r.source] += r.tq_copies * r.tq_size
        target[r.source] = r.tq_target
    weight = dict(zip(sorted((s for s in size if s), key=str) + [None], itertools.cycle((1, 2, 3))))
    want, open_, rest = {}, dict(weight), float(sum(size.values()))
    while open_:
        each = rest / sum(open_.values())
        full = [s for s in open_ if each * open_[s] > 3 * size[s]]
        if not full:
            want |= {s: each * w for s, w in open_.items()}
            break
        for s in full:
            want[s] = 3.0 * size[s]
            rest -= want[s]
            del open_[s]
    assert target == pytest.approx(want) and sum(target.values()) == pytest.approx(sum(size.values()))
    largest = {s: max(r.tq_size for r in got if r.source == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= 3 * largest[s] for s in size)
    bound = mixing.CELL_ROWS
    mixing.CELL_ROWS = 10  # more cells: another order, the same promise
    try:
        other = collections.Counter()
        for r in mixing.mixture(docs_of(spark, rows), mixing.size_of("text")).collect():
            other[r.source] += r.tq_copies * r.tq_size
    finally:
        mixing.CELL_ROWS = bound
    assert other != taken and all(abs(other[s] - target[s]) <= 3 * largest[s] for s in size)
    again = mixing.mixture(docs_of(spark, rows[::-1]).repartition(7), mixing.size_of("text"))
    assert {(r.doc_id, r.tq_copies) for r in again.collect()} == {(r.doc_id, r.tq_copies) for r in got}
    some = mixing.mixed(odd)
    assert some.columns == [*odd.columns, "tq_size_", "tq_copy"] and some.count() >= 1 and {r.tq_size for r in some.collect()} == {"clash"}


# ---- 9 language model ----


def test_model_is_a_distribution_and_beats_the_base(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in pitmanyor.scored(docs).collect()}
    low = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = collections.Counter()
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(low(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in docs.collect():
        w, g = low(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in pitmanyor.scored(docs).collect()}
    assert ids(pitmanyor.scored(written(odd.select("doc_id", "text"), "odd"))) == ids(odd)
    alone = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]  # nothing to train on
    some = pitmanyor.scored(written(docs_of(spark, [(i, "a b", "a") for i in alone]), "alone")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in some} == {(3, 0, 0, 0.0)} and len(some) == len(alone)


def test_predictive_probabilities_sum_to_one():
    np = pitmanyor.np
    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(1, 1 << 62, 50, dtype=np.uint64))
    contexts = rng.integers(0, pitmanyor.CONTEXTS, 32).astype(np.uint64)
    keys = np.unique(np.concatenate([(rng.integers(0, len(tokens), 300).astype(np.uint64) << pitmanyor.CONTEXT_BITS) | rng.choice(contexts, 300), (np.arange(len(tokens), dtype=np.uint64) << pitmanyor.CONTEXT_BITS) | contexts[0]]))
    s = pitmanyor.Shard(tokens, keys, rng.integers(1, 200, len(keys)), 0)
    per = lambda x=None: np.bincount(s.context, weights=x, minlength=pitmanyor.CONTEXTS)
    m = {"d0": 0.4, "d1": 0.6, "types": len(s.first), "customers": per(s.counts), "totals": [(per(np.ones(len(keys))), float(len(s.first)))]}
    for k in range(3):
        for t, up, tables in s.sampled(m, k + 1):
            pass
        assert (t >= 1).all() and (t <= s.counts).all() and (tables <= up).all()
        m["totals"].append((per(t), float(tables.sum())))
        p = pitmanyor.parent_probability(m, k, up, tables)
        nothing = pitmanyor.parent_probability(m, k, np.zeros(1), np.zeros(1))[0]
        assert p.sum() + nothing == pytest.approx(1)
        for u in np.unique(s.context):
            own = s.context == u
            back = (1 + m["d1"] * m["totals"][-1][0][u]) / (1 + m["customers"][u])
            assert ((s.counts - m["d1"] * t)[own].sum()) / (1 + m["customers"][u]) + back == pytest.approx(1)


def gibbs(sequences, sweeps, d0, d1, rng):
    """Plain Gibbs over single customers: the averaged predictive probability of each pair seen, restaurants as lists of table sizes."""
    pairs = [(u, w) for s in sequences for u, w in zip([None, *s], [*s, None])]
    types = {w for _, w in pairs}
    tables = collections.defaultdict(list)  # (u, w) -> sizes
    up = collections.defaultdict(list)  # w -> sizes of the parent's tables

    def parent(w):
        c, t = sum(map(sum, up.values())), sum(map(len, up.values()))
        return (sum(up[w]) - d0 * len(up[w]) + (1 + d0 * t) / (len(types) + 1)) / (1 + c)

    def own(u, w):
        c, t = sum(sum(x) for (v, _), x in tables.items() if v == u), sum(len(x) for (v, _), x in tables.items() if v == u)
        return (sum(tables[u, w]) - d1 * len(tables[u, w]) + (1 + d1 * t) * parent(w)) / (1 + c)

    def pick(sizes, discount, fresh):
        weights = [n - discount for n in sizes] + [fresh]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    def seat(u, w):
        t = sum(len(x) for (v, _), x in tables.items() if v == u)
        if pick(tables[u, w], d1, (1 + d1 * t) * parent(w)):
            pick(up[w], d0, (1 + d0 * sum(map(len, up.values()))) / (len(types) + 1))

    for u, w in pairs:
        seat(u, w)
    out = collections.Counter()
    for k in range(sweeps):
        for u, w in pairs:
            if leave(tables[u, w]):
                leave(up[w])
            seat(u, w)
        if k >= sweeps // 4:
            out.update({(u, w): own(u, w) / (sweeps - sweeps // 4) for u, w in set(pairs)})
    return out


def test_scores_follow_plain_gibbs_sampling(spark):
    """On a toy corpus the scores are near those of customers moved one at a time."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice("aaabbcd") for _ in range(rng.randrange(3, 12))) for _ in range(25)]
    train = [i for i in range(25) if zlib.crc32(str(i).encode()) % 5 != 1]
    docs = written(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), "toy")
    got = {r.doc_id: r.score for r in pitmanyor.scored(docs).collect()}
    rows = [(texts[i].split()) for i in train]
    counts = collections.Counter(p for s in rows for p in zip([None, *s], [*s, None]))
    kinds = collections.Counter(w for _, w in counts)
    share = lambda c: min(0.95, max(0.05, c[1] / (c[1] + 2 * c[2]))) if c[1] + c[2] else 0.5
    p = gibbs(rows, 120, share(collections.Counter(kinds.values())), share(collections.Counter(counts.values())), rng)
    for i in train:
        s = texts[i].split()
        want = sum(math.log10(p[x]) for x in zip([None, *s], [*s, None]))
        assert got[i] == pytest.approx(want, rel=0.1)


def test_seating_follows_the_restaurant_process():
    np = pitmanyor.np
    rng = np.random.default_rng(2)
    got = pitmanyor.seated(np.full(4000, 30), np.full(4000, 1.5), 0.5, rng).mean()
    plain = []
    for _ in range(4000):
        t = 1
        for n in range(1, 30):
            t += rng.random() < 1.5 / (1.5 + n - 0.5 * t)
        plain.append(t)
    assert got == pytest.approx(np.mean(plain), abs=0.15)


# ---- 10 WARC ----


@pytest.mark.parametrize("split", [1 << 12, 1 << 24])
def test_warc_round_trip(spark, split):
    rng = random.Random(12)
    inner = warc.member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n", 0).decode("latin-1")
    pages = [(i, f"http://h/{i}\r\nX", rng.choice(["", "same", "é" * 500, words(rng, 300), inner * 40, None])) for i in range(200)] + [(5000, None, "x" * 2_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archives = warc.write(df, corpus_folder(spark), "page_id", "url", "html")
    got = {int(r.record_id.removeprefix(warc.ID)): r for r in warc.read_back(spark, archives, split=split).collect()}
    assert len(got) == len(pages)
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    for i, _, h in pages:
        data, r = (h or "").encode(), got[i]
        first = max(groups[h or ""])
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", f"{warc.ID}{first}"))
        assert r.payload == (data if i == first else None)


def test_warc_ranges_own_each_record_once(spark, tmp_path):
    data, offsets = b"", []
    rng = random.Random(13)
    for i in range(60):
        offsets.append(len(data))
        data += warc.member(warc.record(str(i), "", rng.randbytes(rng.randrange(3000)), "2000-01-01T00:00:00Z", None), len(data))
    (tmp_path / "a.warc.gz").write_bytes(data)
    for cut in (100, 1777, 10**9):
        found = []
        with open(tmp_path / "a.warc.gz", "rb") as f:
            for a in range(0, len(data), cut):
                found += [at for at, _, _ in warc.Members(f, a, min(a + cut, len(data)), len(data), True)]
        assert found == offsets
    import gzip

    plain = b"".join(gzip.compress(warc.record(str(i), "", b"x" * i, "2000-01-01T00:00:00Z", None)) for i in range(20))
    (tmp_path / "b.warc.gz").write_bytes(plain)
    assert warc.read_back(spark, [(str(tmp_path / "b.warc.gz"), len(plain))], split=300, stamped=False).count() == 20


def test_warc_least_and_odd_rows(spark, odd):
    small = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = warc.read_back(spark, warc.write(small, corpus_folder(spark), "page_id", "url", "html", least=3)).collect()
    assert {int(r.record_id[len(warc.ID) :]): r.record_type for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.read_back(spark, warc.write(odd, corpus_folder(spark), "doc_id", "lang", "text")).count() == 11


# ---- pipeline ----


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = written(corpus_pipeline.drop_toxic(spark, docs, SF), "p")
    machine = toxicity.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(kept) == ids(toxicity.toxicity(docs, machine).where("score < 0.7")) and kept.columns == docs.columns
    once = written(corpus_pipeline.drop_near_duplicates(spark, kept, SF), "p")
    rule = components_by_rule([(r.doc_id, r.text) for r in kept.collect()])
    assert ids(once) == {i: 1 for i, (_, c) in rule.items() if i == c} and once.columns == docs.columns
    clean = written(corpus_pipeline.drop_contaminated(spark, once, SF), "p")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(clean) == {r.doc_id: 1 for r in once.collect() if not found_by_rule(r.text, items)[4]}
    safe = written(corpus_pipeline.redact_secrets(spark, clean, SF), "p")
    assert ids(safe) == ids(clean) and not any(base_by_rule(r.text or "") for r in safe.collect()) and safe.columns == docs.columns
    assert {r.doc_id: r.tq_copies for r in mixing.mixture(safe, mixing.size_of("text")).where("tq_copies > 0").collect()} == dict(ids(corpus_pipeline.mix_sources(spark, safe, SF)))
    assert ids(corpus_pipeline.run(spark, SF)) == ids(corpus_pipeline.mix_sources(spark, safe, SF))


def test_pipeline_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns and got.count() >= 8, name
    rows = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, odd, SF).select("doc_id").collect()]
    assert sorted(rows, key=str) == sorted([(1,), (2,), (3,), (4,), (5,), (None,), (6,), (6,), (8,)], key=str)
