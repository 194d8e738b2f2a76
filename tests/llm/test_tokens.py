"""Encoding against the libraries, and mixing."""

import base64

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from talkloom.llm import mixing, tokenizer

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def automaton():
    return tokenizer.compile_automaton(tokenizer.load_definition())


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_is_its_own_encoding(automaton):
    assert all(automaton.whole(t) for t in automaton.parts)
    assert len(automaton.label) == 50_256


@pytest.mark.parametrize("text", ["", "hello world", "  two  spaces ", "don't they'll", "<|endoftext|>", "naïve café 日本語 😂", "a" * 5000, "x1y22z333 \n\n\t", "ab" * 2000 + " " * 500, "​zero", "\x00\x01"])
def test_encode_equals_library(automaton, library, text):
    ids = automaton.encode(text)
    assert ids == library.encode_ordinary(text) and automaton.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinorst hTH'.,0123\n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(automaton, library, text):
    assert automaton.encode(text) == library.encode_ordinary(text)


def test_small_automaton_equals_merging():
    """All words over {a, b} up to length 8 under a few merges, against merging by rank."""
    from itertools import product

    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("ab", "ab"), ("b", "aa"), ("aa", "b")]
    vocab = {"a": 0, "b": 1} | {x + y: k + 2 for k, (x, y) in enumerate(merges)}
    auto = tokenizer.compile_automaton({"vocab": vocab, "merges": merges, "pattern": ".+"})

    def merged(word):
        ps = list(word)
        for m in merges:
            i = 0
            while i < len(ps) - 1:
                if (ps[i], ps[i + 1]) == m:
                    ps[i : i + 2] = ["".join(m)]
                i += 1
        return [vocab[p] for p in ps]

    for n in range(1, 9):
        for w in map("".join, product("ab", repeat=n)):
            assert auto.encode_word(w.encode()) == merged(w)


def test_encode_documents(spark, library):
    d = spark.createDataFrame([(1, "hello", "x"), (2, None, "y"), (3, "", "z"), (1, "hello", "x"), (4, "word " * 20000, None)], "doc_id long, text string, ids string")
    got = tokenizer.encode_documents(d).collect()
    assert dict(tokenizer.encode_documents(d).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert sorted((r["doc_id"], len(r["ids"])) for r in got) == [(1, 1), (1, 1), (2, 0), (3, 0), (4, len(library.encode_ordinary("word " * 20000)))]
    assert tokenizer.encode_documents(d.limit(0)).count() == 0


def corpus(spark):
    rows = [(i, f"{'apple pear plum' if i % 10 < 6 else 'motor wheel brake' if i % 10 < 9 else 'cloud rain snow'} number {i} again", "fruit" if i % 10 < 6 else "cars" if i % 10 < 9 else "sky") for i in range(600)]
    rows += [(1000 + i, "apple pear plum again", None) for i in range(20)] + [(2000, None, "cars"), (2001, "", "sky"), (2002, "not wanted", "other"), (2003, None, None)]
    t = [("fruit", 0.3, 1), ("cars", 0.4, 2), ("sky", 0.2, 3), ("absent", 0.1, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9)), spark.createDataFrame(t, "source string, target_share double, max_repeats int")


def test_mix_reaches_shares_within_caps(spark):
    docs, targets = corpus(spark)
    r = {x["source"]: x for x in mixing.mix_report(docs, targets).collect()}
    assert r["absent"]["mixed_tokens"] == 0 and r["other"]["n_copies"] == 0
    for s, share in (("fruit", 0.3), ("cars", 0.4), ("sky", 0.2)):
        assert abs(r[s]["expected_share"] - share / 0.9) < 0.01
    m = mixing.mix(docs, targets)
    assert m.count() == docs.count() and {x["source"]: x["m"] for x in m.groupBy("source").agg(F.max("copies").alias("m")).collect()}["sky"] <= 3


def test_mix_with_too_large_a_total_stops_at_the_caps(spark):
    docs, targets = corpus(spark)
    r = {x["source"]: x for x in mixing.mix_report(docs, targets, total=1e9).collect()}
    assert r["sky"]["n_copies"] == 3 * 61 and r["fruit"]["n_copies"] == 360


def test_unknown_sources_are_told_by_their_words(spark):
    docs, _ = corpus(spark)
    m = mixing.memberships(docs, ["absent", "cars", "fruit", "sky"]).where("source is null and n_tokens > 0").select(F.col("member")[2]).collect()
    assert min(r[0] for r in m) >= 6


def test_mix_of_nothing(spark):
    docs, targets = corpus(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert {r["copies"] for r in mixing.mix(docs, targets.limit(0)).collect()} == {0}


def test_cells_are_rounded_as_counted(spark):
    """The tokens that the fit counts on are those that the documents' copies come to."""
    docs, targets = corpus(spark)
    docs = docs.where("source is not null")
    r = {x["source"]: x["mixed_tokens"] for x in mixing.mix_report(docs, targets).collect()}
    names = ["absent", "cars", "fruit", "sky"]
    caps, shares = np.array([4.0, 2.0, 1.0, 3.0]), np.array([0.1, 0.4, 0.3, 0.2])
    cells = mixing.Cells.count(mixing.memberships(docs, names), caps)
    rates, total = mixing.fit_rates(cells, shares, caps)
    assert dict(zip(np.array(names)[cells.member.argmax(1)], cells.copied(rates))).items() >= {s: r[s] for s in ("cars", "fruit", "sky")}.items()
    for s, share in (("cars", 0.4), ("fruit", 0.3), ("sky", 0.2)):
        assert abs(r[s] - share / 0.9 * total) <= total / 200


def test_rates_are_the_least_squares_ones():
    rng = np.random.default_rng(1)
    member = mixing.in_parts(rng.dirichlet(np.ones(3) * 0.3, 40), 8) / 8
    caps, shares = np.array([1.0, 2.0, 4.0]), np.array([0.2, 0.3, 0.5])
    cells = mixing.Cells(member, rng.random((40, mixing.STEPS)), caps)
    rates, total = mixing.fit_rates(cells, shares, caps)
    off = lambda r: ((((cells.tokens * r) @ member - shares * total) / (cells.tokens @ member)) ** 2).sum()
    for _ in range(300):
        other = np.clip(rates + rng.normal(0, 0.05, 40), 0, cells.cap)
        assert off(rates) <= off(other) + 1e-6
    assert (rates >= 0).all() and (rates <= cells.cap).all()


def test_samples_do_not_depend_on_how_rows_lie(spark):
    docs, targets = corpus(spark)
    a, b = docs.repartition(7, "text"), docs.coalesce(1).orderBy(F.desc("doc_id"))
    names = ["cars", "fruit", "sky"]
    assert mixing.labelled_sample(a, names, 50).collect() == mixing.labelled_sample(b, names, 50).collect()
    assert {r["source"] for r in mixing.labelled_sample(a, names, 50).collect()} == set(names)
    assert sorted(mixing.mix(a, targets).collect(), key=str) == sorted(mixing.mix(b, targets).collect(), key=str)


def test_parts_are_whole_and_bounded():
    p = np.random.default_rng(0).dirichlet(np.ones(5), 200)
    w = mixing.in_parts(p, 8)
    assert (w.sum(1) == 8).all() and (w >= 0).all() and (abs(w / 8 - p) < 1 / 8).all()
    assert mixing.parts_for(10) == 8 and mixing.parts_for(200) == 2 and mixing.parts_for(100_000) == 1
