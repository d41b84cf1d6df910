"""The text operators against brute force, and on odd input."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameledger.llm import leakage, mixing, truncation

DOCS = "doc_id bigint, text string, source string"
ITEMS = "item_id bigint, suite string, text string, lang string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def runs_shared(a, b, n=12):
    wa, wb = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (a, b))
    grams = {tuple(wb[i : i + n]) for i in range(len(wb) - n + 1)}
    return any(tuple(wa[i : i + n]) in grams for i in range(len(wa) - n + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks(spark, seed):
    rng = random.Random(seed)
    vocab = ["la", "Loi", "ÉTÉ", "x1", "straße", "judge", "22", "no", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, "s", text(rng.choice([3, 11, 12, 30, 40, 40])), "en") for i in range(12)] + [(50, "s", None, "en"), (None, "s", text(20), "en"), (51, "s", "", "en")]
    docs = []
    for d in range(80):
        t = text(rng.randint(0, 40))
        src = rng.choice([x[2] for x in items if x[2]]).split()
        a, n = rng.randint(0, max(0, len(src) - 12)), rng.randint(10, 16)
        cut = src[a : a + n]
        if rng.random() < 0.3:
            cut = [w.upper() for w in cut]
        docs.append((d, t + rng.choice([" ", "\n\n- 3 -\n", ", "]) + rng.choice([" ", "\n", "; "]).join(cut) + " " + text(rng.randint(0, 30)), "a"))
    docs += [(100, None, "a"), (101, "", "a"), (102, "long " * 300_000 + items[5][2], None), (None, items[4][2], "a"), docs[0]]
    d = spark.createDataFrame(docs, DOCS).withColumns({"print": F.lit(1), "id": F.lit("x"), "around": F.lit(0)})
    got = leakage.leaked_passages(d, spark.createDataFrame(items, ITEMS))
    want = {(x[0], i[0]) for x in docs for i in items if x[0] is not None and i[0] is not None and runs_shared(x[1], i[2])}
    assert set(rows(got)) == want
    assert len(rows(got)) == len(want)
    assert len(want) > 20


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert rows(leakage.leaked_passages(d, i)) == []
    one = spark.createDataFrame([(1, "s", "a " * 20, "en")], ITEMS)
    assert rows(leakage.leak_report(d, one)) == [(1, "s", 0)]
    with pytest.raises(ValueError, match="between"):
        leakage.leaked_passages(d, i, run=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_winnowing_guarantee(run, left, right, other):
    """Two texts with a common run of GRAM + WINDOW - 1 words have a common fingerprint, whatever stands around it."""
    h = leakage.Hashes()
    prints = lambda ws: {int(g[p]) for g in [leakage.gram_hashes(h.of([str(w) for w in ws]))] for p in leakage.winnow(g, np.array([0]))}
    if len(run) >= leakage.GRAM + leakage.WINDOW - 1:
        assert prints(left + run + right) & prints(other + run)


def test_fingerprints_do_not_cross_texts():
    g = np.array([5, 4, 3, 2, 1, 9, 8, 7], np.uint64)
    assert list(leakage.winnow(g, np.array([0, 5]))) == [4]
    assert list(leakage.winnow(np.array([3, 3, 3, 3, 3, 3], np.uint64), np.array([0]))) == [4, 5]


TARGETS = "source string, target_share double, max_repeats int"


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=mixing.SPLIT, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Der Senat teilt die Auffassung nicht.", "a  b\n\nc <|endoftext|>", "x" * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(spark, d, [F.col("doc_id")]).collect()}
    assert got == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def mixture(spark, n=1500):
    rng = random.Random(4)
    src = ["big", " BIG", "mid", "small", "other", None]
    docs = [(i, "word " * rng.randint(1, 60), rng.choices(src, [60, 5, 20, 5, 8, 2])[0]) for i in range(n)]
    docs += [(None, "word word", "mid"), (None, None, "mid"), (n, "", "small")]
    targets = [("big", 0.4, 1), ("mid", 0.4, 2), ("small", 0.15, 4), ("empty", 0.05, 3), ("none", None, 2), ("zero", 0.1, 0), (None, 0.2, 2)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


def test_mixture(spark):
    docs, targets = mixture(spark)
    sizes = mixing.sizes_of(docs)
    got = mixing.sample(sizes, targets).collect()
    caps = {"big": 1, "mid": 2, "small": 4}
    assert {r.source for r in got} == set(caps)
    assert all(1 <= r.copies <= caps[r.source] for r in got)
    used = {s: sum(r.copies * r.n_tokens for r in got if r.source == s) for s in caps}
    total = sum(used.values())
    for s, share in (("big", 0.4), ("mid", 0.4), ("small", 0.15)):
        assert used[s] / total == pytest.approx(share / 0.95, rel=0.05)
    have = {r.source: r["sum(n_tokens)"] for r in sizes.groupBy("source").sum("n_tokens").collect()}
    # some source uses all it has as often as it may
    assert max(used[s] / have[s] / caps[s] for s in caps) == pytest.approx(1.0, abs=1e-9)
    again = mixing.mixed_documents(docs, targets).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    shares = {r.source: r for r in mixing.reached_shares(docs, targets).collect()}
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1.0)
    assert shares["empty"].used_docs == 0
    assert shares["small"].used_tokens == used["small"]


def test_mixture_to_a_total(spark):
    docs, targets = mixture(spark)
    sizes = mixing.sizes_of(docs)
    got = mixing.sample(sizes, targets, total_tokens=20_000).collect()
    for s, share in (("big", 0.4), ("mid", 0.4), ("small", 0.15)):
        assert sum(r.copies * r.n_tokens for r in got if r.source == s) == pytest.approx(20_000 * share, rel=0.1)
    # beyond what a source has, all of it is used max_repeats times
    got = mixing.sample(sizes, targets, total_tokens=10**9).collect()
    n = {r.source: r["count"] for r in sizes.filter("n_tokens >= 0").groupBy("source").count().collect()}
    assert sum(r.copies for r in got if r.source == "small") == 4 * n["small"]


def test_pareto_ranks_have_the_wanted_probabilities(spark):
    """With weights 1 and 4 the inclusion of heavy documents is four times that of light ones; the sample size is fixed."""
    docs = spark.createDataFrame([(i, "w w w", "a") for i in range(4000)], DOCS).withColumn("w", F.when(F.col("doc_id") % 4 == 0, 4.0).otherwise(1.0))
    one = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    got = [mixing.mixed_documents(docs, one, 2000, F.col("w"), seed=s).collect() for s in (1, 2)]
    tokens = got[0][0].n_tokens
    for g in got:
        assert len(g) == round(2000 / tokens)
        heavy = sum(r.doc_id % 4 == 0 for r in g)
        assert heavy / len(g) == pytest.approx(4 * 1000 / (4 * 1000 + 3000), abs=0.07)
    assert {r.doc_id for r in got[0]} != {r.doc_id for r in got[1]}


def test_sizes_decide_and_the_sample_has_a_fixed_number_of_tokens(spark):
    """Without weights long documents are taken in proportion to their tokens, and the tokens used are within a document of the goal."""
    docs = spark.createDataFrame([(i, "word " * (80 if i % 4 == 0 else 20), "a" if i < 3000 else "b") for i in range(4000)], DOCS)
    two = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    for total in (30_000, 40_001, 50_007):
        got = mixing.mixed_documents(docs, two, total, seed=total).collect()
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.n_tokens for r in mine) - total / 2) <= max(r.n_tokens for r in mine)
        p = [sum(r.source == "a" and (r.doc_id % 4 == 0) is long for r in got) / n for long, n in ((True, 750), (False, 2250))]
        assert p[0] / p[1] == pytest.approx(4, rel=0.35)
    kept = mixing.kept_promises(docs, two).collect()
    assert {tuple(r) for r in kept} == {("a", 3000, 0, 0, True), ("b", 1000, 0, 0, True)}


def test_edge_of_the_sample_is_exact(spark, monkeypatch):
    """With coarse bins many documents share the one on the edge; the sample is the same."""
    docs, targets = mixture(spark)
    sizes = mixing.sizes_of(docs)
    fine = rows(mixing.sample(sizes, targets, 15_000))
    monkeypatch.setattr(mixing, "_BINS", 1)
    assert rows(mixing.sample(sizes, targets, 15_000)) == fine


def test_mixture_of_nothing(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert rows(mixing.mixed_documents(d, t)) == []
    assert rows(mixing.mixed_documents(mixture(spark)[0], spark.createDataFrame([], TARGETS))) == []
    assert [r.source for r in mixing.reached_shares(d, t).collect()] == ["a"]


BODY = "Reasons\n\n[1] It follows that the pump remained the property of the Trust.\n\n"
COMPLETE = [
    "The appeal is dismissed.", "The appeal is dismissed.\n\nJ. Thoeld", "The appeal is dismissed.\n\nJ. Thoeld, presiding", "The appeal is dismissed.\n\nRegistrar: H. Bruink\n",
    "The appeal is dismissed.\n\nVelin, 2023-07-13", "The appeal is dismissed.\n\nCited: [2017] KTR 186; [2008] MBR 41", "The appeal is dismissed.\n\n[signature withheld]", "The appeal is dismissed.\n\n[…]",
    "The appeal is dismissed.\n\n— END —", "The appeal is dismissed.\n\nPage 3 of 3", "The appeal is dismissed.\n\nK-0000003/16 — page 2", "The appeal is dismissed.\n\n- 4 -\n", "The appeal is dismissed (see [2017] KTR 1).",
    "It was challenged by X..", "„Die Sache wird zurückverwiesen.“", "Was it so?", "The\nappeal is\ndismissed.",
]
BROKEN = [
    "The appeal is dismi", "The appeal is", "The appeal is…", "The appeal is [...]", "The appeal is\n\nPage 3 of 3", "The appeal is dismi\n\n[…]", "The appeal is dismi\n\n— END —", "[2] On the evidence of J.", "The appeal is dismissed (see [2017",
    "The appeal is dismissed, see [2017] KTR 5", "[12]", "§ 3", "Das Gericht hat über die Genehmigung entschieden und �", "The rule&am", "Order\nThe appeal is allo\n\n- 3 -", "The trust, says “we pay. ", "The appeal is dismissed. <par", "the court at   \n\n",
]


@pytest.mark.parametrize("end", COMPLETE)
def test_complete(end):
    v = truncation.judge(BODY + end)
    assert (v.structure, v.open_end) == ("", False)


@pytest.mark.parametrize("end", BROKEN)
def test_truncated(end):
    v = truncation.judge(BODY + end)
    assert v.structure or v.open_end


def test_held_out_cuts():
    """Complete texts cut at any place inside a sentence are found; the complete ones are not."""
    rng = random.Random(9)
    sentences = ["The pump was delivered to the Trust on 3 May 2019 without the waybill required by [2016] MBR 179.", "No order as to costs.", "Selon l'arrêt attaqué, le moyen n'est pas fondé.", "Der Betrag von 346,243 crowns umfasst auch die Kosten."]
    found = total = 0
    for _ in range(400):
        t = "\n\n".join(f"[{i}] " + " ".join(rng.choices(sentences, k=3)) for i in range(1, 5))
        assert not any(truncation.judge(t + rng.choice(["", "\n", "\n\nPage 1 of 1"]))[:2])
        cut = rng.randint(30, len(t) - 2)
        if re.search(r"[.!?]\s*$", t[:cut]):
            continue
        total += 1
        v = truncation.judge(t[:cut] + rng.choice(["", "…", "\n\n- 2 -"]))
        found += bool(v.structure or v.open_end)
    assert found == total > 300


def test_unclosed():
    assert truncation.unclosed("a (b [c] d)") == -1
    assert truncation.unclosed("a (b [c d") == 5
    assert truncation.unclosed("1) a) „b“ «c»") == -1


OPEN = [
    ('He said "we pay. The rest is gone.', "unclosed quote"), ("<b>Note: It holds.\n\nThe appeal is dismissed.", "unclosed markup"), ("```\ncode here.\n\nThe appeal ends.", "unclosed markup"),
    ("The rule (see annex one.\n\nThe appeal is dismissed.", "unclosed bracket"), ("<!-- hidden.\n\nThe end.", "unclosed markup"), ("„Es gilt „heute“. Er kam.", "unclosed quote"),
]
CLOSED = ["He (1) came and 2) went.", "„Es gilt.“ Er kam.", "“One.\n\n“Two.” Three.", 'The <br> line <img src="x"> ends.', "a < b and c > d.", 'Size 5" wide.', 'He wrote "yes." Then left.', "Between [. and [2017] it lay.", "```\n( [ <b>\n```\n\nIt ends."]


@pytest.mark.parametrize(("end", "frame"), OPEN)
def test_frames_left_open(end, frame):
    """A frame opened anywhere in the text is seen, though the last sentence is finished."""
    assert truncation.judge(BODY + end).left_open == frame
    assert truncation.judge(end + "\n\nThe appeal is").structure == frame


@pytest.mark.parametrize("end", CLOSED)
def test_frames_closed(end):
    assert truncation.open_frames(end) == []


def test_weak_ends_and_open_frames_against_the_source(spark):
    """A short number, an abbreviation or an open frame is a sign of a cut only where the source does not usually end so."""
    plain = "\n\n".join(["It was so held."] * 60) + "\n\n"
    odd = "\n\n".join(["It is 12.", "See Art."] * 30) + "\n\n"
    ends = ["The sum awarded is 12.", "relied on Art.", "Some matters, e.g.", "The rule (see annex one.\n\nIt ends.", "It ends."]
    docs = [(100 * k + i, t + ends[i % 5 if i < 5 else 4], s) for k, (t, s) in enumerate([(plain, "a"), (odd, "b")]) for i in range(60)]
    docs += [(1000 + i, plain + ends[3], "c") for i in range(5)] + [(2000, plain + "Ã¼ber. It ends.", "a")]
    d = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r for r in truncation.judged_documents(d).collect()}
    assert {i: r.reason for i, r in got.items() if r.truncated} == {0: "ends in short number", 1: "ends in abbreviation", 2: "ends in abbreviation", 3: "unclosed bracket", 103: "unclosed bracket"}
    assert [i for i, r in got.items() if r.spoiled] == [2000]
    assert {tuple(r) for r in truncation.truncation_reasons(d).collect()} == {("a", "ends in short number", 1), ("a", "ends in abbreviation", 2), ("a", "unclosed bracket", 1), ("b", "unclosed bracket", 1)}


def test_rates_and_baseline(spark):
    docs = [(i, BODY + ("The appeal is dismissed." if i % 4 else "The appeal is dis"), ["Alpha", " alpha"][i % 2]) for i in range(40)]
    # a source that never ends its paragraphs with a stop
    docs += [(100 + i, "a line without a stop\n\nanother one\n\nthe last", "bare") for i in range(5)]
    docs += [(200, None, None), (201, "", None), (202, "x" * 200_000 + ".", None), (203, BODY + "and the", None), docs[0]]
    d = spark.createDataFrame(docs, DOCS).withColumns({"structure": F.lit(1), "truncated": F.lit("x"), "closes": F.lit(0), "weak": F.lit(2)})
    assert {r[0] for r in truncation.truncated_documents(d).collect()} == {i for i in range(0, 40, 4)} | {203}
    got = {r.source: (r.docs, r.truncated) for r in truncation.truncation_rates(d).collect()}
    assert got == {"alpha": (41, 11), "bare": (5, 0), None: (4, 1)}
    assert rows(truncation.truncated_documents(spark.createDataFrame([], DOCS))) == []
