"""Text rules: expected values worked out by hand, and rules on lines against the same rules word by word."""

import pytest
from pyspark.sql import functions as F

from talkloom.functions import chat, errors, responses as R, words as T
from talkloom.functions.stemming import stem


def one(spark, value, expression, type_="string"):
    """expression: a function of the column."""
    return spark.createDataFrame([(value,)], f"c {type_}").select(expression(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, how, want", [
    ("it's a dog.", dict(on_apostrophe=True, trailing=True), ["it", "s", "a", "dog"]),
    ("it's a, dog.", dict(on_apostrophe=False, commas=True, trailing=True), ["it's", "a", "dog"]),
    ("a b c", dict(), ["a", "b", "c"]), ("", dict(trailing=True), []), (None, dict(), None),
])
def test_words(spark, text, how, want):
    assert one(spark, text, lambda C: T.words(C, **how)) == want


@pytest.mark.parametrize("age, want", [(8, 10), (9, 12), (13, 12), (60, 60), (90, 60), (None, 10)])
def test_age_bin(spark, age, want):
    assert one(spark, age, lambda C: T.age_bin(C, 10, 60, 6), "int") == want


@pytest.mark.parametrize("text, want", [('he said "no"!?', "he said no"), ("a  b .", "a b"), ("...", ""), (None, None)])
def test_remove_punctuation(spark, text, want):
    assert one(spark, text, lambda C: T.remove_punctuation(C)) == want


def test_parse_bool(spark):
    assert [one(spark, v, lambda C: T.parse_bool(C)) for v in ("Yes", "0", "nan", None)] == [True, False, None, None]
    with pytest.raises(Exception, match="not a truth value"):
        one(spark, "perhaps", lambda C: T.parse_bool(C))


def test_word_pairs(spark):
    assert [tuple(p) for p in one(spark, "a b c", lambda C: T.word_pairs(T.words(C)))] == [("a", "b"), ("b", "c")]
    assert one(spark, "a", lambda C: T.word_pairs(T.words(C))) == []


@pytest.mark.parametrize("raw, want", [
    ("no!?", "no!"), ("want [/] want the ball .", "want want the ball."), ("I gonna go .", "I going to go."), ("xxx ball .", "ball."), ("the dog@f (.) runs [: fix] [*] ?", "the dog runs?"),
    ("[=! laughs] yes .", "yes."), ("look [=! laughs] there .", "look, there."), ("haha .", "."), ("www .", "."), ("wa:nt a_b+c", "want a b c."), ("0is it &=coughs red +...", "it red."), ("", "."), (None, None),
])
def test_clean_line(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "c string")
    assert chat.with_clean_line(d, "c", "x").first()["x"] == want


@pytest.mark.parametrize("raw, speech, intelligible", [
    ("xxx .", None, False), ("haha .", False, False), ("0 .", False, False), ("yes .", True, True), ("baba .", True, False), ("yes baba .", True, False), ("[=! sings]", True, True),
    ("[=! laughs]", False, False), ("yes [=! laughs] .", True, True), ("ouch .", False, False), ("&=mumbles .", True, False), ("", False, False), (None, None, None),
])
def test_labels(spark, raw, speech, intelligible):
    r = chat.with_labels(spark.createDataFrame([(raw,)], "c string"), "c").first()
    assert (r["is_speech_related"], r["is_intelligible"]) == (speech, intelligible)


def test_label_options(spark):
    d = spark.createDataFrame([("yes ouch .",), ("mm [=! babbles] .",)], "c string")
    assert [r[1] for r in chat.with_labels(d, "c", partial_speech=None).collect()] == [None, True]
    assert chat.with_labels(d, "c", vocabulary=["yes"]).collect()[1]["is_intelligible"] is False


def test_line_rules_equal_word_rules(spark):
    lines = ["da dog xxx &um 0is yes, ouch haha", "+/. www zzz +... a@b b@i c@u d@p yyy", "&=sings &=coughs &=mumbles la", ",yes, ,xxx, +//. w.w.w", "UGH Da er, Ewok heh."]
    C, d = F.col("c"), spark.createDataFrame([(x,) for x in lines], "c string")
    by_word = F.array_join(F.filter(F.split(C, " "), chat.word_is_parseable), " ")
    by_line = F.trim(F.regexp_replace(F.regexp_replace(C, chat.UNPARSEABLE_WORDS, ""), " +", " "))
    speech_word = F.array_join(F.filter(F.split(F.replace(C, F.lit(","), F.lit("")), " "), lambda w: chat.word_is_speech_related(w) & ~chat.is_excluded_word(w)), " ")
    speech_line = F.trim(F.regexp_replace(F.regexp_replace(F.replace(C, F.lit(","), F.lit("")), chat.NONSPEECH_WORDS, ""), " +", " "))
    babble_word = F.array_join(F.filter(F.split(C, " "), lambda w: ~chat.word_is_babble(w) & ~chat.is_excluded_word(w)), " ")
    babble_line = F.trim(F.regexp_replace(F.regexp_replace(C, chat.BABBLE_WORDS, ""), " +", " "))
    for r in d.select(by_word, by_line, speech_word, speech_line, babble_word, babble_line).collect():
        assert r[0] == r[1] and r[2] == r[3] and r[4] == r[5]


def test_events(spark):
    assert one(spark, "a [=! door slams] b", lambda C: chat.first_event(C)) == "[=! door slams]"
    assert one(spark, "[=! door slams] .", lambda C: chat.is_external_event(C)) is True
    assert one(spark, "[=! kissing] .", lambda C: chat.event_is_speech_related(C)) is False
    assert one(spark, "[=! makes noise]", lambda C: chat.event_is_external(C)) is False
    assert one(spark, "[=! a] [=! b]", lambda C: chat.has_multiple_events(C)) is True
    assert one(spark, "yes \x1512_34\x15", lambda C: chat.without_timing(C)) == "yes "


def test_repetition_ratios(spark):
    d = spark.createDataFrame([("i want ball.", "the ball?"), ("a b.", None), ("a.", "."), ("the.", "the."), ("playing.", "he plays.")], "u string, r string")
    got = [tuple(r)[2:] for r in R.with_repetition_ratios(d, "u", "r").collect()]
    assert got == [(0.5, 1.0), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert tuple(R.with_repetition_ratios(d, "u", "r", stemmed=True).collect()[4])[2:] == (1.0, 1.0)


@pytest.mark.parametrize("response, want", [("yeah look.", True), ("right.", True), ("right there.", False), ("good job.", True), ("I see.", False), ("yes?", False), (".", False), (None, False)])
def test_keyword_acknowledgement(spark, response, want):
    d = spark.createDataFrame([("look.", response)], "u string, r string")
    assert R.with_keyword_acknowledgement(d, "u", "r", "x").first()["x"] is want


def test_speech_act_request(spark):
    d = spark.createDataFrame([("EQ", "the ball."), ("RR", "mommy."), ("YY", "a."), (None, "a.")], "a string, u string")
    assert [r[0] for r in d.select(R.is_speech_act_request(F.col("a"), F.col("u"))).collect()] == [True, False, False, False]


def test_has_response(spark):
    d = spark.createDataFrame([(500.0, True, False), (1500.0, True, True), (float("inf"), True, True), (None, True, True), (1.0, None, None)], "l double, s boolean, i boolean")
    assert [r[0] for r in d.select(R.has_response(F.col("l"), F.col("s"), F.col("i"), 1000)).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("word, want", [("running", "run"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("skies", "sky"), ("caresses", "caress"), ("generously", "generous"), ("dying", "die"), ("y", "y")])
def test_stem(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("said, meant, want", [
    ("goed", "went", ["tense_aspect"]), ("me", "my", ["possessive"]), ("me", "i", ["subject"]), ("me", "i've", ["subject", "verb"]), ("dis", "this", []), ("i", "i'll", ["verb"]),
    ("a", "an", ["determiner"]), ("mans", "men", ["plural"]), ("go", "going", ["progressive"]), ("ball", "balls", ["unk"]), ("?", "?", ["other"]), ("x y", "y x", ["other"]), ("foo", "bar$lex", []),
])
def test_pair_errors(said, meant, want):
    assert errors.pair_errors(said, meant) == want


def test_pair_errors_with_tags():
    assert errors.pair_errors("ball", "balls", {"ball": "n"}) == ["plural"]
    assert errors.pair_errors("want", "wantes", {"want": "v"}) == ["sv_agreement"]


@pytest.mark.parametrize("word, before, want", [("the", None, ["determiner"]), ("s", "go", ["sv_agreement"]), ("s", "dog", ["plural"]), ("he's", None, ["subject", "verb"]), (".", None, []), ("'s", "it", ["verb"]), ("'s", "dogs", ["possessive"])])
def test_omission_errors(word, before, want):
    assert errors.omission_errors(word, before) == want


def test_error_labels():
    assert errors.error_labels("he goed [: went] [*] home .", "he goed home.", None) == ["tense_aspect"]
    assert errors.error_labels("yes .", "yes.", None) is None
    assert errors.error_labels(None, None, None) is None
    assert errors.error_labels("x", "x", "0the = the;goed = went") == ["determiner", "tense_aspect"]
    assert errors.error_labels("there [*] go it", "there go it.", None) == ["subject"]
    assert errors.error_labels("he [* +ed] x", "he x.", None) == ["tense_aspect"]
    assert errors.error_labels("x", "x", None, ["0is", "dog"], ["AUX", "SUBJ"]) == ["auxiliary"]


def test_is_grammatical(spark):
    d = spark.createDataFrame([(None,), (["unk"],), (["verb"],)], "c array<string>")
    assert [r[0] for r in d.select(errors.is_grammatical(F.col("c"))).collect()] == [True, None, False]


def test_actually_said():
    assert errors.actually_said("I went [= actually says goed] home .") == ("I goed home .", ["goed=went"])
    assert errors.actually_said("look at this [= actually says dis] .") == ("look at this .", [])
    assert errors.actually_said("no note") == ("no note", [])


def test_with_error_labels_keeps_extra_columns(spark):
    d = spark.createDataFrame([("he goed [: went] .", "he goed.", None, 1), (None, None, None, 2)], "transcript_raw string, transcript_clean string, error string, extra int")
    got = errors.with_error_labels(d).orderBy("extra").collect()
    assert (got[0]["labels"], got[0]["is_grammatical"], got[1]["labels"], got[1]["is_grammatical"]) == (["tense_aspect"], False, None, True)


def test_omitted_words_of_raw_lines(spark):
    d = spark.createDataFrame([("0is want to lose wagon !", 1), ("0 .", 2), ("&=laughs where 0are you ?", 3), ("I have 0.5 .", 4), (None, 5)], "transcript_raw string, n int")
    d = d.selectExpr("*", "transcript_raw AS transcript_clean", "CAST(null AS string) AS error")
    got = {r["n"]: (r["labels"], r["is_grammatical"]) for r in errors.with_error_labels(d).collect()}
    assert got == {1: (["verb"], False), 2: (None, True), 3: (["verb"], False), 4: (None, True), 5: (None, True)}


def test_omitted_words_by_relation_of_chat_tiers(spark):
    d = spark.createDataFrame([("&-um 0is want .", ["&-um", "0is", "want", "."], [(1, 2, "SUBJ"), (2, 0, "ROOT"), (3, 2, "PUNCT")], 1), ("0is want .", ["0is", "want", "."], [(1, 2, "SUBJ")], 2)], "transcript_raw string, tokens array<string>, gra array<struct<dep int, head int, rel string>>, n int")
    d = d.selectExpr("*", "transcript_raw AS transcript_clean", "CAST(null AS string) AS error")
    assert {r["n"]: r["labels"] for r in errors.with_error_labels(d).collect()} == {1: ["subject"], 2: ["verb"]}


def test_pairs_that_are_no_errors_and_parts_of_speech_reach_the_rules(spark):
    from talkloom.plans import composites as Q

    d = spark.createDataFrame([("I wanna [: want to] go .", ["i", "wanna", "go", "."], ["pro", "v", "v"], None, 1), ("two ball [: balls] .", ["two", "ball", "."], ["det:num", "n"], None, 2), ("he want .", ["he", "want", "."], ["pro", "v"], "want = wants", 3)], "transcript_raw string, tokens array<string>, pos array<string>, error string, n int").selectExpr("*", "transcript_raw AS transcript_clean")
    labels = lambda x: {r["n"]: r["labels"] for r in x.collect()}
    assert labels(Q.annotate_errors(d)) == {1: None, 2: ["plural"], 3: ["sv_agreement"]}  # "wanna" is dialect
    d = d.withColumn("transcript_raw", F.replace("transcript_raw", F.lit("wanna"), F.lit("flarp")))
    assert labels(Q.annotate_errors(d)) == {1: ["unk"], 2: ["plural"], 3: ["sv_agreement"]}
    assert labels(Q.annotate_errors(d, [("flarp", "want to")])) == {1: None, 2: ["plural"], 3: ["sv_agreement"]}
    assert errors.actually_said("he is coming [= actually says flooping] .", [("flooping", "coming")]) == ("he is coming .", [])
    assert errors.star_errors("x [* a0b] .", "x", None, [("a", "ab")]) == [] and errors.tier_errors("cos = because", None, {("cos", "because")}) == []


@pytest.mark.parametrize("raw, want", [
    ("I'm gonna [: going to] go .", None), ("'cause [: because] yes .", None), ("he's fwee [: three] .", None), ("don't [: do not] .", None), ("yea:h [: yes] .", None), ("there's [: there are] two .", ["sv_agreement"]), ("that's [: they're] red .", ["plural"]),
])
def test_corrections_that_are_no_errors(raw, want):
    assert errors.error_labels(raw, raw, None) == want


@pytest.mark.parametrize("raw, clean, want", [
    ("here [*] are .", "here are.", "subject"), ("wants [*] ball .", "wants ball.", "subject"), ("what are them [*] .", "what are them.", "object"), ("a [*] apple .", "a apple.", "determiner"), ("that's [*] cup .", "that's cup.", "determiner"),
    ("will [*] go .", "will go.", "preposition"), ("on [*] the .", "on the.", "preposition"), ("they goes [*] .", "they goes.", "sv_agreement"), ("she [*] gone .", "she gone.", "auxiliary"), ("two box [*] .", "two box.", "plural"),
    ("him [*] was jumping .", "him was jumping.", "progressive"), ("put [*] in .", "put in.", "object"), ("he [*] my friend .", "he my friend.", "verb"), ("it [*] want .", "it want.", "sv_agreement"), ("much [*] thing .", "much thing.", "progressive"),
    ("oh [*] she is go .", "oh she is go.", "progressive"), ("well [*] not see .", "well not see.", "auxiliary"), ("go see [*] .", "go see.", "subject"), ("yes [*] goed .", "yes goed.", "tense_aspect"), ("oh [*] foots .", "oh foots.", "plural"), ("oh [*] .", "oh.", "unk"),
])
def test_one_error_of_a_line(raw, clean, want):
    assert errors.line_error(raw, clean) == want
