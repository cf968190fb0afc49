"""Ranked search, token files and centroid clustering against plain versions, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import lexical, rangecoder, sortmeans, tokenids
from textquarry.llm.common import scratch

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows and ids, ties, and columns that operators use inside."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (5, "x" * 50_000), (None, "red fox and blue hen"), (6, "Red FOX-and blue hen"), (7, "red fox and blue hen"), (6, "other fox"), (8, "zwei 😀 wörter Öl"), (9, "--- ,,, ...")]
    rows += [(100 + i, " ".join(rng.choice(["red", "fox", "hen", "and", "blue", "w1", "w2", "Öl", "zwei"]) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("score", "rank", "item", "held", "n", "terms", "ids", "digest", "number", "start")})


# Ranked search


def search_by_rule(rows, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(d, collections.Counter(cut(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in cut(text) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k])]
    return out


ITEMS = [(1, "red fox"), (2, "RED red red hen, hen"), (3, None), (4, ""), (5, "nowhere!"), (None, "blue Öl w1"), (1, "red fox"), (6, "and and w2 zwei 😀 w77 w78"), (7, "...")]


@pytest.mark.parametrize("block", [1 << 20, 16])
@pytest.mark.parametrize("k", [10, 3])
def test_search_against_all_scores(spark, odd, block, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = lexical.search(odd, items, k, block=block)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0)
    want = search_by_rule([(r.doc_id, r.text) for r in odd.collect()], ITEMS, k)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"


def test_search_of_nothing(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(odd.limit(0), items).count() == lexical.search(odd, items.limit(0)).count() == 0
    assert lexical.search(odd.where("text is null"), items).count() == 0


def test_best_keeps_ties_by_place():
    rng = np.random.default_rng(2)
    for _ in range(300):
        scores = rng.integers(0, 5, rng.integers(0, 30))
        want = sorted((i for i in range(len(scores)) if scores[i] >= 1), key=lambda i: (-scores[i], i))[:7]
        assert lexical.best(scores, 7, 1).tolist() == want


# Token files


def lumpy(rng, n):
    return np.array([rng.choice([3, 7, 7, 7, rng.randrange(50_000)]) for _ in range(n)], np.int64)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 1000, 4099])
@pytest.mark.parametrize("block", [16, 4096])
def test_coder_round_trip(n, block):
    rng = random.Random(n)
    for ids in (lumpy(rng, n), np.zeros(n, np.int64), np.arange(n) * 7, np.arange(n)[::-1] + (1 << 31)):
        made = rangecoder.encode(ids, block)
        assert (rangecoder.decode(*made) == ids).all()


def test_coder_blocks_stand_alone_and_are_checked():
    ids = lumpy(random.Random(1), 500)
    shares, lengths, used, crc, words = rangecoder.encode(ids, 64)
    ends = np.cumsum(used)
    for i in range(len(lengths)):
        own = words[ends[i] - used[i] : ends[i]]
        part = (lengths[i : i + 1], used[i : i + 1], crc[i : i + 1])
        assert (rangecoder.decode(shares, *part, own) == ids[i * 64 : i * 64 + 64]).all()
        broken = own.copy()
        broken[len(own) // 2] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode(shares, *part, broken)


def test_coder_learns_contexts():
    """Ids that follow from the two before cost little, though each alone is as likely as any other."""
    ids = np.tile(np.random.default_rng(3).permutation(256), 64).astype(np.int64)
    assert 16 * len(rangecoder.encode(ids)[4]) < 2.5 * len(ids)
    random_ids = np.random.default_rng(4).integers(0, 256, 1 << 14)
    assert 16 * len(rangecoder.encode(random_ids)[4]) < 8.5 * len(random_ids)


def test_coder_with_all_ids():
    ids = np.concatenate([np.arange(50_257), np.zeros(100_000, np.int64)])
    assert (rangecoder.decode(*rangecoder.encode(ids)) == ids).all()
    with pytest.raises(ValueError):
        rangecoder.encode(np.arange(70_000))


PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", [9, 10])
def test_pieces_have_the_ids_of_the_text(seed):
    rng = random.Random(seed)
    atoms = [" ", "  ", "\n", " \n ", "\t", " ", " ", "　", "\x1c", "\x85", "a", "don't", "'s", "I'll", "12", "½", "é", "é", "😀", "<|endoftext|>", "--", "#!", "word", "Wörter", "​", "中文", ".", "x", "²", "ǅ", "ß", "́", "_", "\n\n", "\x00"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(0, 25))) for _ in range(6000)]
    whole = tokenids.tokenizer(PATH)
    for t, got in zip(texts, tokenids.encode(texts, PATH, "<u2", most=5000)):
        assert np.frombuffer(got, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
        assert "".join(tokenids.pieces_of(t)) == t


def files_by_rule(rows):
    whole = tokenids.tokenizer(PATH)
    return [(d, whole.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]


@pytest.mark.parametrize("group,file", [(tokenids.GROUP, tokenids.FILE), (64, 3000)])
def test_token_files_round_trip(spark, odd, group, file):
    folder = scratch(spark, "tokens")
    files = tokenids.write(odd, folder, PATH, group=group, file=file)
    got = tokenids.read_back(spark, files, ids=True).collect()
    want = files_by_rule([(r.doc_id, r.text) for r in odd.collect()])
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in got if r.doc_id is not None) == sorted((d, tuple(i)) for d, i in want if d is not None)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [d for d, _ in sorted(want, key=key)]
    if group == 64:
        assert len(files) > 3
    narrow = tokenids.read_back(spark, files)
    assert narrow.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, narrow.collect()), key=str) == sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str)


def test_token_query_against_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    want, start = [], 0
    for d, ids in files_by_rule([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenids.op12_tokenids(spark, sf).collect())) == want


def test_token_files_of_nothing_and_cut_short(spark, odd, tmp_path):
    assert tokenids.read_back(spark, tokenids.write(odd.limit(0), scratch(spark, "tokens"), PATH)).count() == 0
    path = tmp_path / "x"
    data = tokenids.packed(__import__("pyarrow").array([1, 2]), [2, 3], False, np.array([5, 2, 5, 6, 2]))
    for bad in (data[:-1], data[:30], b"x" + data[1:], data[:40] + b"?" + data[41:]):
        path.write_bytes(bad)
        with open(path, "rb") as f, pytest.raises(ValueError):
            list(tokenids.unpacked(f))


# Centroid clustering


def clusters_by_rule(rows, k, rounds, dim, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(x)) for x in v]))
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for t in range(rounds + 1):
        where = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if t < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, where) if at == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    per = collections.Counter()
    for d, j in where:
        per[j] += d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, where)), key=str)


@pytest.mark.parametrize("k,seed", [(16, 1), (5, 2), (3, 3), (40, 4)])
def test_clusters_against_full_scans(spark, k, seed):
    rng = random.Random(seed)
    # Few different values make ties and equal centroids; a third of all rows is one vector.
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(4)]) for i in range(120)] + [(500 + i, [0.3, 0.3, -0.25, 2.0]) for i in range(60)]
    rows += [(700, None), (701, []), (702, [1.0, 2.0]), (703, [1.0, None, 2.0, 3.0]), (704, [1.0, float("nan"), 2.0, 3.0]), (705, [float("inf"), 1.0, 2.0, 3.0]), (None, [1.0, 1.0, 1.0, 1.0]), (706, [1.0] * 5), (3, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("v", "cluster", "distance", "h")}).repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got, centroids = sortmeans.clustered(df, k=k, dim=4)
    assert sorted(map(tuple, got.collect()), key=str) == clusters_by_rule(rows, k, 3, 4, 64)
    assert len(centroids) == k


def test_clusters_of_few_rows_or_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert sortmeans.clustered(df, dim=2)[0].count() == 2
    empty, centroids = sortmeans.clustered(df)  # none has 64 components
    assert empty.count() == 0 == len(centroids) and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_lists_end_scans_early():
    rng = np.random.default_rng(1)
    centers = rng.integers(-1000, 1000, (32, 8)) * 8
    v = (centers[rng.integers(0, 32, 3000)] + rng.integers(-50, 50, (3000, 8))).astype(np.int64)
    tables = sortmeans.neighbours(centers)
    first, _, _ = sortmeans.nearest(v, np.zeros(len(v), np.int64), centers, *tables)
    again, distance, computed = sortmeans.nearest(v, first, centers, *tables)
    full = ((v[:, None] - centers[None]) ** 2).sum(2)
    assert (first == full.argmin(1)).all() and (again == first).all() and (distance == full.min(1)).all()
    assert computed < full.size / 8


def test_components_without_room_for_distances(spark):
    df = spark.createDataFrame([(1, [1e30] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        sortmeans.clustered(df)
