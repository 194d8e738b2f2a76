import pytest
from hypothesis import given, strategies as st

from talkloom.functions.cells import CellGrammar
from talkloom.operators.cells import split_cells

KNOWN = ["subject", "verb", "object", "tense/aspect", "he/she mix-up", "word order", "missing word", "subject-verb agreement", "sv_agreement", "run-on", "other"]
G = CellGrammar(KNOWN)


@pytest.mark.parametrize("cell, want", [
    (None, []), ("", []), ("  ", []), ("n/a", []), ("None", []), ("--", []), (",", []), ("verb", ["verb"]), (" verb \n", ["verb"]), ("subject, verb", ["subject", "verb"]), ("verb,verb", ["verb", "verb"]),
    ("verb/tense/aspect", ["verb", "tense/aspect"]), ("he/she mix-up;verb", ["he/she mix-up", "verb"]), ("subject verb word order", ["subject", "verb", "word order"]), ('["subject", "verb"]', ["subject", "verb"]),
    ("['tense/aspect']", ["tense/aspect"]), ("- subject\n- verb", ["subject", "verb"]), ("1. subject 2. verb", ["subject", "verb"]), ("(a) subject, (b) verb", ["subject", "verb"]), ("a: verb\nb: object", ["verb", "object"]),
    ("subject, verb, and object", ["subject", "verb", "object"]), ("subject &amp; verb", ["subject", "verb"]), ("verb,&nbsp;object", ["verb", "object"]), ('"self repair, check"/other', ["self repair, check", "other"]),
    ('"odd ""x"", y", verb', ['odd "x", y', "verb"]), (r'["odd \"x\"", "verb"]', ['odd "x"', "verb"]), ("«a; b» → verb", ["a; b", "verb"]), ("subject-verb agreement - sv_agreement", ["subject-verb agreement", "sv_agreement"]),
    ("{verb|run-on}", ["verb", "run-on"]), ("lexical, verb", ["lexical", "verb"]), ("verb lexical", ["verb", "lexical"]), ("lexical «a b»", ["lexical", "a b"]), ("verb、object，other", ["verb", "object", "other"]), ("dialect dialect", ["dialect", "dialect"]),
])
def test_parse(cell, want):
    assert [i.label for i in G.parse(cell)] == want


def test_malformed_quotes_are_flagged():
    items = G.parse('"verb, subject')
    assert [(i.label, i.malformed) for i in items] == [("verb", True), ("subject", False)]
    assert [i.kind for i in G.parse('"verb", object, stutter')] == ["quoted", "known", "bare"]


@pytest.mark.parametrize("cell, want", [
    ("[verb, subject]", [("verb", False), ("subject", False)]), ("[verb, subject", [("verb", True), ("subject", False)]), ("verb], subject", [("verb", True), ("subject", False)]), ("] verb", [("verb", True)]), ("[a [b] c]", [("a", False), ("b", False), ("c", False)]),
    ("{verb, (object]}", [("verb", False), ("object", True)]), ("[verb]]", [("verb", True)]), ("<verb> <object>", [("verb", False), ("object", False)]), ("verb > object", [("verb", False), ("object", False)]), ('["verb", object', [("verb", True), ("object", False)]),
    ("a:b", [("a", False), ("b", False)]), ("2:b", [("2", False), ("b", False)]), ("a: verb", [("verb", False)]), ("1.verb 2.object", [("verb", False), ("object", False)]),
])
def test_brackets_and_list_marks(cell, want):
    assert [(i.label, i.malformed) for i in G.parse(cell)] == want


@given(st.lists(st.sampled_from(KNOWN), min_size=1, max_size=6), st.sampled_from([", ", ";", " | ", " + ", "\n", "\t", " & ", " > ", " • ", " – "]))
def test_round_trip(labels, separator):
    assert [i.label for i in G.parse(separator.join(labels))] == labels


@given(st.text(max_size=60))
def test_any_text_ends(text):
    for i in G.parse(text):
        assert i.label


def test_split_cells(spark):
    d = spark.createDataFrame([(1, "verb, object", "x"), (2, None, "y"), (3, "", "z"), (1, "verb", "x"), (4, "verb, " * 5000, "w")], "row_id long, labels string, label string")
    got = split_cells(d, "labels", KNOWN, ["row_id"]).select("row_id", "item_no", "label").collect()
    assert sorted(map(tuple, got))[:3] == [(1, 1, "verb"), (1, 1, "verb"), (1, 2, "object")] and sum(r["row_id"] == 4 for r in got) == 5000
    assert split_cells(d.limit(0), "labels", KNOWN, ["row_id"]).count() == 0
