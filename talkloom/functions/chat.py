"""Coded transcript lines: what the codes mean, and lines without them, as Column expressions.

Lines carry bracketed codes ([/], [*], [: fix], [=! laughs]), codes on words (word@c,
&=event, 0word, xxx) and terminators. A null line gives null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .steps import steps, where_any, where_not_ascii
from .words import BLANK, remove_punctuation

# ---- Fixed values -------------------------------------------------------------------
CAREGIVERS = ["MOT", "FAT", "DAD", "MOM", "GRA", "GRF", "GRM", "GMO", "GFA", "CAR"]
LAUGHTER_LINES = ["ha ha", "ha ha ha"]
LAUGHTER = ["haha", "hahaha", "hahahaha", "hehehe", "heehee", "hehe", "hohoho", "hhh", "hah"]
BABBLE = ["da", "ba", "baba", "baa", "babaa", "ababa", "bada", "gagaa", "gaga", "ow", "ay", "pss", "ugh", "bum", "brrr", "oop", "er"]
NONSPEECH = ["ouch", "yack", "ugh", "woah", "oy", "ee", "hee", "whoo", "oo", "hoo", "ew", "oof", "baaee", "ewok", "ewoks", "urgh", "ow", "heh"]
SLANG = {
    "hasta": "has to", "hafta": "have to", "hadta": "had to", "needta": "need to", "dat's": "that is", "dat": "that", "dis": "this",
    "dere": "there", "de": "the", "gonna": "going to", "anoder": "another", "dunno": "don't know", "'cause": "because",
}
BODY_SOUNDS = [
    "laugh", "cough", "squeak", "squeal", "crie", "moan", "giggl", "shout", "snor", "hiccup", "cry", "sigh", "gasp", "exhale", "clap", "gurgle",
    "groan", "yawn", "murmum", "whinge", "whine", "whining", "whing", "sneeze", "roar", "shriek", "growl", "grunt", "chuckle", "slurp", "sob",
    "raspberr", "scream", "whimper", "burp", "chant", "whistl", "yell", "kiss", "cheer", "screech", "blow", "cooing", "belch", "squawk",
]
# -------------------------------------------------------------------------------------

EVENT = r"\[=! [^\]]*\]"
SPOKEN_EVENT = r"babbl|hum|sung|whisper|mumbl|mutter|voc"
UNDERSTOOD_EVENT = r"sing|sung|hum|whisper"
EXCLUDED_WORD = r'^(?:\.*w\.*w\.*w\.*|\+/.*|\+\.\.\.?|.*@x.*|0.*|‡|\+"(?:/?\.?)|zzz)$'
CODES = r"\[[+\-%*/x?][^\]]*\]|\[:+ [^\]]*\]|\[=\? [^\]]*\]|\[[<>]\d*\]|\[!+\]|\[\^ \S*\]"
SIGNS = "↓→↑↗∙“”„▔▁⁎∇∆↫☺"
WORD_CODES = r"@z:\S*|@s\S*|@(?:wp|[cfngodlktq])|&-|[()<>‹›⌊⌋⌈⌉°:^]"


def first_event(c: Column) -> Column:
    """The first [=! ...] of a line, '' where there is none."""
    return F.regexp_extract(c, EVENT, 0)


def all_events(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EVENT), 0)


def has_multiple_events(c: Column) -> Column:
    return F.size(all_events(c)) > 1


def event_is_speech_related(event: Column) -> Column:
    return event.rlike(SPOKEN_EVENT) | (event.contains("sing") & ~event.contains("fussing") & ~event.contains("kissing"))


def event_is_intelligible(event: Column) -> Column:
    return event.rlike(UNDERSTOOD_EVENT)


def event_is_external(event: Column) -> Column:
    """Whether an event is neither like speech nor made by a body."""
    return ~(event_is_speech_related(event) | event.rlike("|".join(BODY_SOUNDS)) | (event.contains("mak") & event.contains("noise")))


def is_external_event(c: Column) -> Column:
    """Whether an external event is all there is to a line."""
    event = first_event(c)
    return (event != "") & event_is_external(event) & (remove_punctuation(F.replace(c, event, F.lit(""))) == "")


def without_timing(c: Column) -> Column:
    """Without time marks between \\x15 bytes."""
    return F.regexp_replace(c, r"\x15[^\x15]+?\x15", "")


def _bare(w: Column) -> Column:
    return F.replace(w, F.lit(","), F.lit(""))


def is_excluded_word(w: Column) -> Column:
    return _bare(w).rlike(EXCLUDED_WORD)


def word_is_laughter(w: Column) -> Column:
    return _bare(w).isin(LAUGHTER)


def word_is_babble(w: Column, known: Column | None = None) -> Column:
    """Whether a word is babble. known: whether the word without @u or @p is a word, where a vocabulary can tell; else all such words are babble."""
    b = _bare(w)
    phonetic = b.endswith("@u") | b.endswith("@p")
    if known is not None:
        phonetic = phonetic & ~known
    told = b.endswith("@b") | b.endswith("@i") | b.startswith("&") | b.contains("xxx") | (b == "yyy") | F.lower(b).isin(BABBLE) | phonetic
    return F.when(b.startswith("&="), ~event_is_intelligible(b)).otherwise(told)


def word_is_speech_related(w: Column) -> Column:
    """Of &= events whether they are like speech; laughter and exclamations are not. Commas are kept in mind only for laughter."""
    return F.when(w.startswith("&="), event_is_speech_related(w)).otherwise(~word_is_laughter(w) & ~F.lower(w).isin(NONSPEECH))


def word_is_parseable(w: Column) -> Column:
    b = _bare(w)
    return ~(b.startswith("&=") | b.isin(LAUGHTER) | F.lower(b).isin(NONSPEECH) | is_excluded_word(w) | word_is_babble(w) | b.endswith("@u") | b.endswith("@p"))


# ---- The same rules on whole lines ---------------------------------------------------
# Words are runs between blanks; commas at a word's ends do not count.
_START, _STOP = r"(?<!\S),*(?:", r"),*(?!\S)"
_EXCLUDED = r'\.*w\.*w\.*w\.*|\+/\S*|\+\.\.\.?|\S*@x\S*|0\S*|‡|\+"(?:/?\.?)|zzz'
EXCLUDED_WORDS = _START + _EXCLUDED + _STOP
UNPARSEABLE_WORDS = _START + rf"&\S*|\S*@[biup]|\S*xxx\S*|yyy|{'|'.join(LAUGHTER)}|(?i:{'|'.join(BABBLE + NONSPEECH)})|{_EXCLUDED}" + _STOP
_LIKE_SPEECH = rf"(?!\S*(?:{SPOKEN_EVENT}))(?!(?=\S*sing)(?!\S*fussing)(?!\S*kissing))"
NONSPEECH_WORDS = r"(?<!\S)(?:" + rf"&={_LIKE_SPEECH}\S*|{'|'.join(LAUGHTER)}|(?i:{'|'.join(NONSPEECH)})|{_EXCLUDED}" + r")(?!\S)"
BABBLE_WORDS = _START + rf"&=(?!\S*(?:{UNDERSTOOD_EVENT}))\S*|&(?!=)\S*|(?!&=)(?:\S*@[biup]|\S*xxx\S*|yyy|(?i:{'|'.join(BABBLE)}))|{_EXCLUDED}" + _STOP
SLANG_WORDS = _START + "|".join(SLANG) + _STOP
_BLANKS = BLANK + "+"


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def strip_steps(raw: Column, out: str) -> list[tuple[str, Column]]:
    """A line without codes as column `out`; [=! ...] events stay, and [= ...] where the line has a "[= actually says"."""
    t = F.col("__t")
    return [
        ("__t", raw),
        ("__t", where_any(t, ["["], F.regexp_replace(t, CODES, ""))),
        ("__t", F.when(t.contains("[= ") & ~t.contains("[= actually says"), F.regexp_replace(t, r"\[= [^\]]*\]", "")).otherwise(t)),
        ("__t", where_not_ascii(t, F.translate(t, SIGNS, ""))),
        ("__t", where_any(t, ["(", "\\x", "\x15"], F.regexp_replace(t, r"\([.\d]*\)|\\x\d*|\x15", ""))),
        ("__t", F.regexp_replace(t, EXCLUDED_WORDS, "")),
        ("__t", where_any(t, "@&()<>:^‹›⌊⌋⌈⌉°", F.regexp_replace(t, WORD_CODES, ""))),
        ("__t", F.trim(F.regexp_replace(t, _BLANKS, " "))),
        (out, F.trim(F.translate(t, "_+", "  "))),
    ]


def clean_steps(stripped: str, out: str) -> list[tuple[str, Column]]:
    """A stripped line as clean text that ends in one mark: the leftmost of its final run, '.' where there is none."""
    t, event = F.col("__t"), F.col("__e")
    inside = ~t.startswith(event) | t.endswith(event)
    table = F.create_map(*[F.lit(x) for kv in SLANG.items() for x in kv])
    return [
        ("__m", F.regexp_extract(stripped, r"([.!?])[.!?]*$", 1)),
        ("__t", F.when(F.col("__m") != "", F.regexp_replace(stripped, r"[.!?]+$", "")).otherwise(F.col(stripped))),
        ("__e", F.when(t.contains("[=! "), first_event(t)).otherwise("")),
        ("__t", F.when(event == "", t).when(inside, F.replace(F.replace(t, event, F.lit(",")), F.lit(" ,"), F.lit(","))).otherwise(F.replace(t, event, F.lit("")))),
        ("__t", F.when(t.isin(LAUGHTER_LINES), "").otherwise(_squeezed(F.regexp_replace(t, UNPARSEABLE_WORDS, "")))),
        ("__t", F.when(t.rlike(SLANG_WORDS), F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(table[_bare(w)], w)), " ")).otherwise(t)),
        ("__t", where_any(t, [","], F.replace(F.replace(t, F.lit(" ,"), F.lit(",")), F.lit(",,"), F.lit(",")))),
        ("__t", where_any(t, ["."], F.regexp_replace(F.replace(F.regexp_replace(t, r"\s\.$", "."), F.lit(",."), F.lit(".")), r"\.\.\.(?:\s\.\.\.)*", "..."))),
        ("__t", where_any(t, [","], F.regexp_replace(t, r"^(?:\s*,)+\s*|(?:\s*,)+\s*$", ""))),
        (out, F.concat(F.trim(t), F.when(F.col("__m") == "", ".").otherwise(F.col("__m")))),
    ]


STRIPPED = "_stripped"


def with_clean_line(df: DataFrame, raw: str = "transcript_raw", out: str = "transcript_clean", keep_stripped: bool = False) -> DataFrame:
    """Adds the clean text of raw lines; null for null. keep_stripped: the line without codes stays as column STRIPPED, for with_labels."""
    name = STRIPPED if keep_stripped else "__stripped"
    return steps(df, strip_steps(F.col(raw), name) + clean_steps(name, out))


def label_steps(stripped: str, partial_speech: bool | None = True, unintelligible: bool | None = None, partial_intelligible: bool | None = False, empty: bool | None = False, vocabulary: list[str] | None = None) -> list[tuple[str, Column]]:
    """is_speech_related and is_intelligible of a stripped line.

    Speech: false if nothing is left without laughter, exclamations, codes and events that
    are unlike speech; `unintelligible` if only xxx is; `partial_speech` if something was
    taken out. Intelligible: `empty` if there is no speech, false if only babble,
    `partial_intelligible` if some of it. With a vocabulary a single word beside an event
    that cannot be understood is babble unless the vocabulary holds it.
    """
    speech, left, event = F.col("__speech"), F.col("__left"), F.col("__e")
    boolean = lambda v: F.lit(v).cast("boolean")
    spoken = (event != "") & event_is_speech_related(event)
    understood = (event != "") & event_is_intelligible(event)
    lone = (event != "") & ~understood & ~speech.contains(" ") & ~F.lower(speech).isin(vocabulary or []) if vocabulary else F.lit(False)
    return [
        ("__plain", remove_punctuation(F.col(stripped))),
        ("__e", F.when(F.col("__plain").contains("[=! "), first_event(F.col("__plain"))).otherwise("")),
        ("__speech", F.trim(F.when(event != "", F.replace(F.col("__plain"), event, F.lit(""))).otherwise(F.col("__plain")))),
        ("__speech", F.when(speech.isin(LAUGHTER_LINES), "").otherwise(_squeezed(F.regexp_replace(F.replace(speech, F.lit(","), F.lit(" ")), NONSPEECH_WORDS, "")))),
        ("__all", F.when(spoken, F.concat_ws(" ", F.nullif(speech, F.lit("")), event)).otherwise(speech)),
        ("is_speech_related", F.when(F.col("__all") == "", False)
            .when(F.col("__all").contains("xxx") & ~F.col("__all").rlike(r"(?<![^\s',])(?!\S*xxx)[^\s',]+"), boolean(unintelligible))
            .when(F.length("__all") != F.length("__plain"), boolean(partial_speech)).when(F.col("__all").isNotNull(), True)),
        ("__e", F.when(spoken, event).otherwise("")),
        ("__left", F.when(lone, "").otherwise(_squeezed(F.regexp_replace(speech, BABBLE_WORDS, "")))),
        ("__left", F.when(understood & spoken, F.concat_ws(" ", F.nullif(left, F.lit("")), event)).otherwise(left)),
        ("is_intelligible", F.when(F.col("__all") == "", boolean(empty)).when(left == "", False).when(F.length(left) != F.length("__all"), boolean(partial_intelligible)).when(left.isNotNull(), True)),
    ]


def with_labels(df: DataFrame, raw: str = "transcript_raw", **how) -> DataFrame:
    """Adds is_speech_related and is_intelligible of raw lines (see label_steps); null for null. A column STRIPPED of with_clean_line is used up."""
    if STRIPPED not in df.columns:
        df = steps(df, strip_steps(F.col(raw), STRIPPED))  # on its own, as longer methods are not compiled to machine code
    return steps(df, label_steps(STRIPPED, **how)).drop(STRIPPED)
