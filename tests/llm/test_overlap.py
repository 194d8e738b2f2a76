import random

import pytest
from hypothesis import given, settings, strategies as st

from talkloom.llm import overlap

SCHEMA = "row_id long, split string, source string, prev_transcript_clean string, transcript_clean string, distance int, key long"


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=300)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9), st.integers(0, 4))
def test_word_distance(a, b, most):
    d = full_distance(a, b)
    assert overlap.word_distance(a, b, most) == (d if d <= most else most + 1)


def sheet(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def brute(rows):
    import re
    ws = lambda t: re.findall(r"[^\W_]+", re.sub("['’]", "", (t or "").lower()))
    r = [(i, s, ws(p), ws(t)) for i, s, _, p, t in rows]
    r = [x for x in r if len(x[2]) + len(x[3]) >= 8 and x[0] is not None]
    return sorted((min(a[0], b[0]), max(a[0], b[0])) for a in r if a[1] == "train" for b in r if b[1] in ("val", "test") and full_distance(a[2], b[2]) + full_distance(a[3], b[3]) <= 2)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12 if seed else 60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(7, 14))] for _ in range(12)]
    rows = []
    for i in range(160):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(ws))
            rnd.choice([lambda: ws.insert(k, rnd.choice(vocabulary)), lambda: ws.pop(k), lambda: ws.__setitem__(k, rnd.choice(vocabulary))])()
        cut = rnd.choice([0, 3, 4, len(ws)])
        text = lambda x: rnd.choice([" ", ", "]).join(x) + rnd.choice(["", ".", " !"]) if x else rnd.choice(["", None])
        rows.append((i, rnd.choice(["train", "train", "val", "test", None]), rnd.choice(["x", None]), text(ws[:cut]), text([w.upper() if rnd.random() < 0.2 else w for w in ws[cut:]])))
    got = sorted(map(tuple, overlap.overlap_found(sheet(spark, rows)).collect()))
    assert got == brute(rows)
    report = overlap.overlap_report(sheet(spark, rows)).collect()
    assert sum(r["n_pairs"] for r in report) == len(got) and sum(r["n_rows"] for r in report) == sum(r[1] in ("val", "test") for r in rows)


def test_hot_copies_apostrophes_and_long_texts(spark):
    long_ = " ".join(f"x{i}" for i in range(3000))
    rows = [(i, "train", "a", "don't you see the big red ball", "there") for i in range(60)] + [(100 + i, "test", "a", "DONT you see, the big red ball!", "there?") for i in range(40)] + [(300, "train", None, long_, None), (301, "val", None, long_ + " y", "z")]
    got = overlap.overlap_found(sheet(spark, rows)).collect()
    assert len(got) == 60 * 40 + 1 == len(set(map(tuple, got)))


def test_short_records_and_empty_tables(spark):
    rows = [(1, "train", "a", "a b c", "d e f g"), (2, "val", "a", "a b c", "d e f g"), (None, "val", "a", "a b c d e", "f g h i"), (4, "train", None, None, None)]
    assert overlap.overlap_found(sheet(spark, rows)).count() == 0
    assert overlap.overlap_found(sheet(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        overlap.overlap_pairs(sheet(spark, rows), least_words=4)
