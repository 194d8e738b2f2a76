"""Sequence operators against simple loops, grouped analytics, sampling, statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talkloom.functions.chat import CAREGIVERS
from talkloom.operators import analytics as A, ml, sampling as S, sequence as W, stats

SCHEMA = "row_id long, transcript_file string, speaker_code string, transcript_clean string, start_time long, end_time long, is_speech_related boolean"


def turns(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def simple_triples(rows, timing):
    out, files = [], {}
    for r in sorted(rows):
        files.setdefault(r[1], []).append(r)
    for rs in files.values():
        for i, r in enumerate(rs[:-1]):
            n, later = rs[i + 1], [x for x in rs[i + 1 :] if x[2] == "CHI"]
            if r[2] != "CHI" or not later:
                continue
            if n[2] in CAREGIVERS and n[0] == r[0] + 1:
                out.append((r[0], True, n[3], later[0][3]))
            elif n[2] == "CHI" and (not timing or (n[4] is not None and r[5] is not None and n[4] - r[5] >= 1000)):
                other = [x for x in rs[i + 1 :] if x[2] != "CHI"]
                if not other or other[0][2] in CAREGIVERS:
                    out.append((r[0], False, "", n[3]))
    return sorted(out)


def random_turns(seed, times=True):
    rnd, rows, k = random.Random(seed), [], 0
    for f in "abc":
        t = 0
        for _ in range(rnd.randint(0, 25)):
            k += rnd.choice([1, 1, 1, 2])
            t += rnd.randint(0, 3000)
            rows.append((k, f, rnd.choice(["CHI", "CHI", "MOT", "INV"]), f"t{k}", t if rnd.random() > 0.1 else None, t + 100 if rnd.random() > 0.1 else None, rnd.choice([True, False, None])))
    return rows


def test_triples_of_the_fixture(spark):
    rows = [(i, "a", s, f"t{i}", None, None, None) for i, s in [(0, "CHI"), (1, "MOT"), (2, "INV"), (3, "CHI"), (4, "CHI"), (6, "MOT"), (7, "CHI")]]
    got = W.micro_conversations(turns(spark, rows)).select("index", "answered", "response_transcript_clean", "follow_up_transcript_clean").collect()
    assert sorted(map(tuple, got)) == [(0, True, "t1", "t3"), (3, False, "", "t4")]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("timing", [False, True])
def test_triples_equal_a_loop(spark, seed, timing):
    rows = random_turns(seed)
    d = W.micro_conversations(turns(spark, rows).repartition(3), timing, most_overlap_ms=10**9, most_wait_ms=10**9)
    want = simple_triples(rows, timing)
    if timing:
        by = {r[0]: r for r in rows}
        text = {r[3]: r for r in rows}
        want = [w for w in want if by[w[0]][5] is not None and text[w[3]][4] is not None and (not w[1] or text[w[2]][4] is not None)]
    assert sorted(map(tuple, d.select("index", "answered", "response_transcript_clean", "follow_up_transcript_clean").collect())) == want


@pytest.mark.parametrize("timing", [False, True])
def test_triples_in_blocks_are_the_same(spark, timing):
    """Blocks of three row_ids, so that next rows, later children and later others lie in other blocks, several blocks on too; with null speakers and transcripts."""
    rows = [(k, None if f == "c" else f, None if k % 11 == 0 else s, t, a, b, ok) for k, f, s, t, a, b, ok in random_turns(9) + [(k + 1000, "z", s, f"z{k}", 9000 * k, 9000 * k + 5, True) for k, s in enumerate(["CHI", "MOT", "MOT", "INV", "INV", "INV", "INV", "INV", "CHI", "CHI", "CHI", "CHI", "CHI", "CHI", "CHI", "CHI", "FAT"])]]
    d = turns(spark, rows).repartition(3)
    plain, blocks = (W.micro_conversations(d, timing, block_ids=b) for b in (None, 3))
    assert plain.columns == blocks.columns and sorted(map(str, plain.collect())) == sorted(map(str, blocks.collect())) and plain.count() > 5


def test_triples_use_one_shuffle(spark):
    plan = W.micro_conversations(turns(spark, random_turns(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_triples_without_known_nonspeech_and_empty(spark):
    rows = [(0, "a", "CHI", "x", 0, 1, None), (1, "a", "MOT", "y", 2, 3, False), (2, "a", "CHI", "z", 5000, 5001, True)]
    d = turns(spark, rows)
    assert W.micro_conversations(d).first()["answered"] is True
    assert W.micro_conversations(d, drop_non_speech=True).first()["answered"] is False
    assert W.micro_conversations(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_context(spark, n):
    rows = random_turns(9)
    got = {r["row_id"]: r for r in W.with_following(W.with_previous(turns(spark, rows), n), n).collect()}
    end = f"_{n}" if n > 1 else ""
    for f in "abc":
        rs = [r for r in sorted(rows) if r[1] == f]
        for i, r in enumerate(rs):
            use = r[6] is not False
            before = [x[3] for x in rs[:i] if x[6] is not False][-n:]
            after = [x[3] for x in rs[i + 1 :] if x[6] is not False][:n]
            assert got[r[0]][f"prev_transcript_clean{end}"] == (" ".join(before) if use and before else None)
            assert got[r[0]][f"following_transcript_clean{end}"] == (" ".join(after) if use and after else None)


def test_cut_and_dense_ids(spark):
    rows = [(i, "a", s, "", None, None, None) for i, s in enumerate(["MOT", "CHI", "MOT", "CHI", "MOT", "CHI"])]
    assert [r["row_id"] for r in W.cut_at_nth_child(turns(spark, rows), 2).orderBy("row_id").collect()] == [0, 1, 2, 3]
    d = spark.createDataFrame([("b", 0), ("a", 1), ("a", 0), (None, 0)], "transcript_file string, utterance_id int")
    assert sorted((r["row_id"], r["transcript_file"]) for r in W.with_dense_id(d, start=5).collect()) == [(5, None), (6, "a"), (7, "a"), (8, "b")]
    many = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('f', id % 50) END AS transcript_file", "CAST(id % 997 AS int) AS utterance_id", "id")
    got = W.with_dense_id(many.repartition(7)).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(3000)) and [(r["transcript_file"], r["utterance_id"]) for r in got] == sorted((r["transcript_file"], r["utterance_id"]) for r in got)
    assert W.with_dense_id(many.limit(0)).count() == 0


def test_filters_keep_nulls_as_stated(spark):
    d = spark.createDataFrame([(1, "x", True), (2, None, None), (3, "y", False)], "k int, corpus string, f boolean")
    ids = lambda df: sorted(r["k"] for r in df.collect())
    assert ids(A.filter_corpora(d, [], ["x"])) == [2, 3] and ids(A.filter_corpora(d, ["x"])) == [1] and ids(A.not_known_false(d, "f")) == [1, 2]
    assert ids(A.exclude_values(d, "corpus", ["y"])) == [1, 2] and ids(A.groups_having(d, "corpus", F.max("k"), lambda a: a > 2)) == [3]


def test_proportions(spark):
    d = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", None)], "g string, f boolean")
    got = {(r["g"], r["is_total"]): (r["n"], r["n_true"]) for r in A.proportions(d, ["g"], "f", total=True, drop="g").collect()}
    assert got == {("a", False): (2, 1), ("b", False): (1, 1), (None, True): (3, 2)}
    assert A.proportions(d.limit(0), ["g"], "f").count() == 0


def test_contingency(spark):
    d = spark.createDataFrame([("a", True, True), ("a", False, False), ("b", True, True), ("c", True, False), ("c", False, True)], "t string, x boolean, y boolean")
    assert {r["t"]: r["contingency"] for r in A.contingency(d, "t", "x", "y").collect()} == {"a": 1.0, "c": -1.0}
    assert tuple(A.contingency_summary(d, "t", "x", "y").first()) == (2, 0.0, 1.0, 1.0)


def test_labels_and_melting(spark):
    d = spark.createDataFrame([(1, "a, b", True, None), (2, None, False, True)], "index long, labels string, utt_ok boolean, follow_up_ok boolean")
    assert sorted(r["labels"] for r in A.explode_labels(d).collect()) == ["a", "b", "nan"]
    assert A.explode_labels(d, nulls_as=None).count() == 2
    m = A.melt_follow_up(d, "ok", ["labels", "missing"])
    assert m.count() == 4 and set(m.columns) == {"conversation_id", "labels", "ok", "is_follow_up"}
    s = {(r["labels"], r["condition"]): r["share"] for r in A.share_by_condition(A.explode_labels(d), "labels", {"all": F.lit(True), "ok": F.col("utt_ok")}).collect()}
    assert s[("nan", "ok")] == 0.0 and math.isclose(s[("a", "all")], 1 / 3)


def test_top_values_break_ties_by_value(spark):
    d = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    assert [r["v"] for r in A.top_values(d, "v", 2).collect()] == ["c", "a"]


def test_samples_repeat_and_are_disjoint(spark):
    d = spark.range(1000).withColumnRenamed("id", "row_id")
    a, b = (sorted(r[0] for r in S.sample_rows(x, 50, seed=1).collect()) for x in (d, d.repartition(7)))
    assert a == b and len(a) == 50
    parts = {r["split"]: r["count"] for r in S.split_by_share(d, {"train": 0.8, "test": 0.2}).groupBy("split").count().collect()}
    assert sum(parts.values()) == 1000 and 740 < parts["train"] < 860


def test_balanced_equals_ranking(spark):
    rows = [(i, "x" if i % 7 else "y") for i in range(500)] + [(i + 500, None) for i in range(9)]
    d = spark.createDataFrame(rows, "row_id long, label string")
    got = S.balanced(d, "label", seed=2).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"x": 72, "y": 72}
    assert S.balanced(d.limit(0), "label").count() == 0


def test_annotation_sheet(spark):
    rows = [(k, c, f"{c}/{f}", "CHI" if k % 2 else "MOT", f"t{k}") for c in ("p", "q") for f in range(3) for k in range(f * 100, f * 100 + 20)]
    d = spark.createDataFrame(rows, "row_id long, corpus string, transcript_file string, speaker_code string, transcript_clean string")
    s = S.annotation_sheet(d, 5).collect()
    assert len({r["transcript_file"] for r in s}) == 2 and sum(r["utterance"].startswith("[CHI]") for r in s) == 10


def test_agreement(spark):
    d = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15 + [(None, 1)], "a int, b int")
    r = stats.agreement(d, "a", "b").first()
    assert r["n"] == 50 and math.isclose(r["kappa"], 0.4) and math.isclose(r["mcc"], (20 * 15 - 5 * 10) / math.sqrt(25 * 25 * 30 * 20))
    assert stats.agreement(d.limit(0), "a", "b").first()["kappa"] is None
    p = stats.precision_recall(d, "a", "b").first()
    assert math.isclose(p["precision"], 20 / 30) and math.isclose(p["recall"], 20 / 25)


def test_krippendorff(spark):
    rows = [(u, r, v) for r, vs in enumerate(["*****3412113*3"[:12], "1*213312132***"[:12], "**213412113*3*"[:12]]) for u, v in enumerate(vs) if v != "*"]
    d = spark.createDataFrame([(u, r, int(v)) for u, r, v in rows], "u int, r int, v int")
    units = {}
    for u, _, v in rows:
        units.setdefault(u, []).append(int(v))
    for level, far in (("nominal", lambda a, b: float(a != b)), ("interval", lambda a, b: float((a - b) ** 2))):
        values = [v for vs in units.values() if len(vs) > 1 for v in vs]
        n = len(values)
        observed = sum(far(a, b) / (len(vs) - 1) for vs in units.values() if len(vs) > 1 for i, a in enumerate(vs) for j, b in enumerate(vs) if i != j) / n
        expected = sum(far(a, b) for i, a in enumerate(values) for j, b in enumerate(values) if i != j) / (n * (n - 1))
        assert math.isclose(stats.krippendorff_alpha(d, "u", "v", level).first()["alpha"], 1 - observed / expected)


def test_tests_of_means():
    assert math.isclose(stats.z_test(100, 0.196, 1.0)[1], 0.025, abs_tol=1e-4)
    assert math.isclose(stats.t_test(10, 1.833113, math.sqrt(10))[1], 0.05, abs_tol=1e-5)
    assert math.isnan(stats.t_test(1, 1, 0)[1])


def test_simpson(spark):
    rows = [("j", True, True)] * 6 + [("j", True, False)] * 2 + [("j", False, True)] * 3 + [("j", False, False)] + [("b", True, True)] * 3 + [("b", True, False)] * 3
    d = spark.createDataFrame(rows, "c string, ok boolean, asked boolean")
    got = {(r["c"], r["ok"]): r["proportion"] for r in A.proportions(d, ["c", "ok"], "asked", total=True, drop="c").collect()}
    assert got[("j", True)] == 0.75 and got[("j", False)] == 0.75 and math.isclose(got[(None, True)], 9 / 14)


def test_models(spark):
    d = spark.createDataFrame([(i / 100, (i * 37 % 100) / 100, int(i + (i * 37 % 100) > 100)) for i in range(100)], "a double, b double, y int")
    wa, wb, c = ml.fit_ratio_classifier(d, "a", "b", "y")
    right = d.where((F.col("a") * wa + F.col("b") * wb + c > 0) == (F.col("y") == 1)).count()
    assert right >= 95
    t = spark.createDataFrame([(f"{'good fine' if i % 3 else 'bad poor'} thing {i % 5}", i % 3 != 0) for i in range(90)], "text string, ok boolean")
    m = ml.ngram_forest(t, "text", "ok", 20, 10)
    out = m.transform(ml.with_ngram_inputs(t, "text", "ok"))
    assert out.where("prediction = label").count() == 90
    curve = {r["term"]: r["coefficient"] for r in ml.logistic_curve(spark.createDataFrame([(x, 1 / (1 + math.exp(-(0.5 * x - 1)))) for x in range(10)], "x int, p double"), "x", "p").collect()}
    assert math.isclose(curve["x"], 0.5, rel_tol=1e-3)


def test_scoring_hook(spark):
    d = spark.createDataFrame([("a.", "one two."), (None, "one two."), ("a.", "one."), ("a.", "bad day.")], "prev_transcript_clean string, transcript_clean string")
    got = ml.score_with(d, "m", lambda prev, cur: ["bad" not in c for c in cur])
    assert [r["is_grammatical_m"] for r in got.collect()] == [True, None, None, False]
    assert ml.score_with(got, "m", lambda p, c: []) is got


def test_known_words(spark):
    words = spark.createDataFrame([("Ball", 1), ("flarp", 2), (None, 3), ("doggie", 4), ("ball", 5)], "word string, n int")
    known = spark.createDataFrame([("ball",), ("BALL",), (None,)], "word string")
    flags = lambda d: {r["n"]: r["is_word"] for r in d.collect()}
    assert flags(A.with_known_words(words, known)) == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert flags(A.with_known_words(words, known, dictionary=lambda s: s.str.startswith("dog"))) == {1: True, 2: False, 3: False, 4: True, 5: True}
    assert A.with_known_words(words.limit(0), known).count() == 0
