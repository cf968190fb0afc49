"""The trained sentence splitter: what it learns, how it cuts, and how it does against the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import chunker, splitter

#: Sentences marked by hand; every row is one text, every string one sentence.
MARKED = [
    ["The accused was brought to Brgy. Hall at 9 p.m. on the same day.", "Sgt. Reyes took him there.", "He said nothing."],
    ["Engr. Santos and Atty. Cruz signed the deed.", "The witness saw both of them!", "Was it Engr. Santos who paid?", "Nobody knew."],
    ["Under Sec. 5 of the Act, the fine is P10,000.00 at most.", "See Resp. Exh. 4 for the receipt.", "The court agrees with Resp. Lim."],
    ["They left at 10 a.m. and came back at 4 p.m. with Sgt. Dizon.", "The rain had stopped.", "No one was hurt."],
    ["Exh. 12 was lost.", "Atty. Lim kept a copy of Exh. 13 in Brgy. Uno.", "The parties met again at 6 p.m. on Friday."],
    ["J. P. Rizal St. is long.", "It begins at Brgy. Dos and ends there.", "The street was closed."],
]
NOUNS = "hall river mayor clerk court rain street witness deed copy receipt party home word mayor car house lawyer friday money road door table paper wall field".split()
VERBS = "saw left met paid closed signed kept wrote followed watched".split()
TITLES, TIMES, THINGS = ("Sgt.", "Engr.", "Atty.", "Resp.", "Brgy."), ("a.m.", "p.m."), ("Exh.", "Sec.")
NAMES = ("Reyes", "Cruz", "Lim", "Santos", "Dizon", "Uno", "Dos", "Hall")


def prose(rng):
    """A paragraph of sentences in which titles, hours and exhibits are written short."""
    out = []
    for _ in range(rng.randrange(4, 9)):
        subject = rng.choice([f"the {rng.choice(NOUNS)}", "he", "it", "they", "nobody", "no one", f"{rng.choice(TITLES)} {rng.choice(NAMES)}", f"see {rng.choice(THINGS)} {rng.randrange(1, 30)} and the {rng.choice(NOUNS)}"])
        rest = rng.choice([f"the {rng.choice(NOUNS)}", f"a {rng.choice(NOUNS)} near the {rng.choice(NOUNS)}", f"{rng.choice(TITLES)} {rng.choice(NAMES)} at {rng.randrange(1, 12)} {rng.choice(TIMES)} on {rng.choice(NOUNS)}", f"{rng.choice(NOUNS)} with {rng.choice(TITLES)} {rng.choice(NAMES)}"])
        told = f"{subject} {rng.choice(VERBS)} {rest}"
        out.append(told[0].upper() + told[1:] + rng.choice(".....!?"))
    return " ".join(out)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(7)
    texts = [prose(rng) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), (" \n ",)], "text string").repartition(3)
    return splitter.trained(df)


def cuts(sents):
    """Places of the ends, as numbers of characters that aren't white space."""
    out, at = set(), 0
    for s in sents:
        at += len("".join(s.split()))
        out.add(at)
    return out


def test_learned_lists(model):
    assert {"brgy", "sgt", "p.m", "a.m", "exh", "sec", "atty"} <= model.abbreviations
    assert not {"river", "home", "court", "it", "the"} & model.abbreviations


def test_fewer_false_cuts_than_the_rules(spark, model):
    texts = [" ".join(s) for s in MARKED]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    wrong = {}
    for name, cut in (("trained", model.splitter(spark)), ("legal", chunker.sentences_legal), ("plain", chunker.sentences)):
        got = {r.i: r.s for r in df.select("i", cut(F.col("text")).alias("s")).collect()}
        wrong[name] = (sum(len(cuts(got[i]) - cuts(s)) for i, s in enumerate(MARKED)), sum(len(cuts(s) - cuts(got[i])) for i, s in enumerate(MARKED)))
    assert wrong["trained"][0] < wrong["legal"][0] < wrong["plain"][0], wrong
    assert sum(wrong["trained"]) < sum(wrong["legal"]), wrong


def test_decisions_one_by_one():
    m = splitter.Model({"sgt", "p.m", "etc"}, {"the"}, {("##", "street"), ("sgt", "the")}, {"then": (True, True, False, False), "reyes": (False, True, False, True), "he": (True, True, True, False), "river": (True, False, False, False)})
    for word, following, want in [
        ("home.", "the", True), ("Sgt.", "Reyes", False), ("p.m.", "The", True), ("p.m.", "Then", True), ("p.m.", "river", False), ("Sgt.", "The", False), ("really?", "no", True), ("(home.)", "And", True),
        ("5.", "Street", False), ("5.", "river", False), ("5.", "He", True), ("J.", "Reyes", False), ("J.", "He", True), ("wait...", "river", False), ("wait...", "He", True), ('"stop!"', "he", True),
    ]:
        assert m.ends(word, following) is want, (word, following)


def test_sentences_hold_the_text(spark, model):
    texts = ["", "  \n", "one", " A boat.\n\nC  dog!  ", "x" * 50_000, "Go. " * 20_000, None, "é. Ñu. 😀 ok."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in df.select("i", model.splitter(spark)("text").alias("s")).collect()}
    assert got[6] is None and got[0] == got[1] == [] and got[3] == ["A boat.", "C  dog!"]
    for i, t in enumerate(texts):
        if t is not None:
            assert "".join("".join(got[i]).split()) == "".join(t.split())
    chunks = chunker.rag_chunks(df.where("i = 5"), splitter=model.splitter(spark)).collect()
    assert sum(len(c.text.split()) for c in chunks) >= 20_000


def test_chance_is_the_likelihood_ratio(spark):
    """Against the sums of binomial log-likelihoods."""
    cases = [tuple(map(float, c)) for c in ((1000, 50, 40, 20), (1000, 20, 20, 20), (500, 10, 400, 9), (1000, 50, 40, 1), (30, 5, 29, 5))]
    log = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)
    df = spark.createDataFrame(cases, "n double, a double, b double, ab double")
    for r in df.select("*", splitter.chance(*(F.col(c) for c in ("n", "a", "b", "ab"))).alias("x")).collect():
        want = 2 * (log(r.ab, r.a, r.ab / r.a) + log(r.b - r.ab, r.n - r.a, (r.b - r.ab) / (r.n - r.a)) - log(r.ab, r.a, r.b / r.n) - log(r.b - r.ab, r.n - r.a, r.b / r.n))
        assert math.isclose(r.x, want if r.ab * r.n > r.a * r.b else 0, abs_tol=1e-6)


def test_nothing_to_learn_from(spark):
    m = splitter.trained(spark.createDataFrame([], "text string"))
    assert m == splitter.Model() and m.sentences("A boat. C dog.") == ["A boat.", "C dog."]


def test_words_are_counted_in_one_pass_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(splitter, "HELD", 3)  # what a task holds is given on now and then
    texts = ["to be or not to be. " * 2_000, "Be! (p.m.) \"to\" to\u2028be ...", None, "", " \n"]
    got = splitter.tokens(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)).collect()
    assert len(got) <= 20 and sum(r.times for r in got) == 12_000 + 6
    before = lambda r: r.before and (r.before.type, r.before.dot, r.before.end, r.before.dots)
    seen = {}
    for r in got:
        seen[before(r), r.type, r.dot] = seen.get((before(r), r.type, r.dot), 0) + r.times
    plain = ("", False, False, False)
    assert seen == {
        (None, "to", False): 1, (("be", True, False, False), "to", False): 1_999, (plain, "to", False): 2_000 + 1, (plain, "be", False): 2_000 + 1, (plain, "be", True): 2_000, (plain, "or", False): 2_000, (plain, "not", False): 2_000,
        (None, "be", False): 1, (("", False, True, False), "p.m", True): 1, (("p.m", True, False, False), "to", False): 1, (plain, "", False): 1,
    }


@pytest.mark.parametrize("vocabulary", [0, 3])
def test_case_beyond_the_vocabulary_is_looked_up(spark, model, monkeypatch, vocabulary):
    monkeypatch.setattr(splitter, "FILED", 4, raising=False)  # several files
    rng = random.Random(7)
    learned = [prose(rng) for _ in range(400)]
    few = splitter.trained(spark.createDataFrame([(t,) for t in learned], "text string").repartition(3), vocabulary=vocabulary)
    texts = [*learned, "He came at 9 p.m. Hall closed. It is 5. Ñu ran... river", "", None]
    want = [None if t is None else model.sentences(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r.i: r.s for r in rows.select("i", few.splitter(spark)("text").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert few.sentences(texts[0]) == want[0] and len(few.cases) == vocabulary < len(model.cases)
    for kind in model.cases:
        for word in ("p.m.", "5.", "J."):
            assert few.ends(word, kind.capitalize()) is model.ends(word, kind.capitalize())
