"""The text rules once more, in SQL over lists of words, to check the Column rules with.

Each function gives common table expressions that read a relation with row_id and raw,
and end in one of the name given.
"""

from __future__ import annotations

from ..functions import chat, error_values as V
from ..functions.errors import ING_VERBS, SUBJECTS, VERBS

BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def texts(values) -> str:
    return "(" + ", ".join(text(v) for v in sorted(values)) + ")"


def _sub(c: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({c}, {text(pattern)}, {text(new)}, 'g')"


def _squeezed(c: str) -> str:
    return f"trim({_sub(c, BLANKS, ' ')})"


def _words_but(c: str, condition: str) -> str:
    """c without the words w of which a condition holds."""
    return f"array_to_string(list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: NOT ({condition})), ' ')"


_BARE = "trim(w, ',')"
_EXCLUDED = f"regexp_full_match({_BARE}, {text(r'\.*w\.*w\.*w\.*|\+/\S*|\+\.\.\.?|\S*@x\S*|0\S*|‡|\+\"(/?\.?)|zzz')})"
_WORDLIKE = r"\S*@[biup]|\S*xxx\S*|yyy"


def _like_speech(w: str) -> str:
    return f"(regexp_matches({w}, {text(chat.SPOKEN_EVENT)}) OR (contains({w}, 'sing') AND NOT contains({w}, 'fussing') AND NOT contains({w}, 'kissing')))"


def _understood(w: str) -> str:
    return f"regexp_matches({w}, {text(chat.UNDERSTOOD_EVENT)})"


def stripped(source: str, out: str) -> str:
    """Lines without codes: stripped (and raw)."""
    no_codes = _sub("raw", r"\[[+\-%*/x?][^\]]*\]|\[:+ [^\]]*\]|\[=\? [^\]]*\]|\[[<>]\d*\]|\[!+\]|\[\^ [^\s]*\]")
    no_notes = f"CASE WHEN contains(t, '[= actually says') THEN t ELSE {_sub('t', r'\[= [^\]]*\]')} END"
    return f"""{out}_a AS (SELECT *, {no_codes} AS t FROM {source}),
{out}_b AS (SELECT * REPLACE ({_sub(_sub(f"({no_notes})", "[↓→↑↗∙“”„▔▁⁎∇∆↫☺]"), r"\([.\d]*\)|\\x\d*|\x15")} AS t) FROM {out}_a),
{out}_c AS (SELECT * REPLACE ({_words_but("t", _EXCLUDED)} AS t) FROM {out}_b),
{out} AS (SELECT * EXCLUDE (t), trim(translate({_squeezed(_sub("t", r"@z:\S*|@s\S*|@(?:wp|[cfngodlktq])|&-|[()<>‹›⌊⌋⌈⌉°:^]"))}, '_+', '  ')) AS stripped FROM {out}_c)"""


def cleaned(source: str, out: str) -> str:
    """Clean lines: transcript_clean, from stripped."""
    unparseable = f"starts_with({_BARE}, '&') OR regexp_full_match({_BARE}, {text(_WORDLIKE)}) OR {_BARE} IN {texts(chat.LAUGHTER)} OR lower({_BARE}) IN {texts(chat.BABBLE + chat.NONSPEECH)} OR {_EXCLUDED}"
    slang = "CASE replace(w, ',', '') " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in chat.SLANG.items()) + " ELSE w END"
    has_slang = f"len(list_filter(string_split(t, ' '), lambda w: {_BARE} IN {texts(chat.SLANG)})) > 0"
    return f"""{out}_a AS (SELECT *, regexp_extract(stripped, '([.!?])[.!?]*$', 1) AS mark, regexp_replace(stripped, '[.!?]+$', '') AS t FROM {source}),
{out}_b AS (SELECT *, regexp_extract(t, '\\[=! [^\\]]*\\]') AS e FROM {out}_a),
{out}_c AS (SELECT * REPLACE (CASE WHEN e = '' THEN t WHEN NOT starts_with(t, e) OR ends_with(t, e) THEN replace(replace(t, e, ','), ' ,', ',') ELSE replace(t, e, '') END AS t) FROM {out}_b),
{out}_d AS (SELECT * REPLACE (CASE WHEN t IN {texts(chat.LAUGHTER_LINES)} THEN '' ELSE {_squeezed(_words_but("t", unparseable))} END AS t) FROM {out}_c),
{out}_e AS (SELECT * REPLACE (CASE WHEN {has_slang} THEN array_to_string(list_transform(string_split(t, ' '), lambda w: {slang}), ' ') ELSE t END AS t) FROM {out}_d),
{out}_f AS (SELECT * REPLACE (replace(replace(t, ' ,', ','), ',,', ',') AS t) FROM {out}_e),
{out}_g AS (SELECT * REPLACE ({_sub("replace(regexp_replace(t, '\\s\\.$', '.'), ',.', '.')", r"\.\.\.(?:\s\.\.\.)*", "...")} AS t) FROM {out}_f),
{out} AS (SELECT * EXCLUDE (t, e, mark), trim({_sub("t", r"^(?:\s*,)+\s*|(?:\s*,)+\s*$")}) || CASE mark WHEN '' THEN '.' ELSE mark END AS transcript_clean FROM {out}_g)"""


def labelled(source: str, out: str) -> str:
    """is_speech_related and is_intelligible, from stripped."""
    event = "starts_with(w, '&=')"
    nonspeech = f"({event} AND NOT {_like_speech('w')}) OR w IN {texts(chat.LAUGHTER)} OR lower(w) IN {texts(chat.NONSPEECH)} OR {_EXCLUDED.replace(_BARE, 'w')}"
    b_event = f"starts_with({_BARE}, '&=')"
    babble = f"({b_event} AND NOT {_understood(_BARE)}) OR (NOT {b_event} AND (starts_with({_BARE}, '&') OR regexp_full_match({_BARE}, {text(_WORDLIKE)}) OR lower({_BARE}) IN {texts(chat.BABBLE)})) OR {_EXCLUDED}"
    spoken, understood = f"(e <> '' AND {_like_speech('e')})", f"(e <> '' AND {_understood('e')})"
    heard = "len(list_filter(regexp_split_to_array(said, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: regexp_matches(w, '[^'',]') AND NOT contains(regexp_extract(w, '[^'',]+['',]*$'), 'xxx'))) = 0"
    return f"""{out}_a AS (SELECT *, trim(regexp_replace(replace(replace(translate(stripped, '"„”', ''), '''''', ''), '  ', ' '), '[.!?]+\\s*$', '')) AS plain FROM {source}),
{out}_b AS (SELECT *, regexp_extract(plain, '\\[=! [^\\]]*\\]') AS e FROM {out}_a),
{out}_c AS (SELECT *, trim(CASE e WHEN '' THEN plain ELSE replace(plain, e, '') END) AS speech FROM {out}_b),
{out}_d AS (SELECT * REPLACE (CASE WHEN speech IN {texts(chat.LAUGHTER_LINES)} THEN '' ELSE {_squeezed(_words_but("replace(speech, ',', ' ')", nonspeech))} END AS speech) FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN {spoken} THEN concat_ws(' ', nullif(speech, ''), e) ELSE speech END AS said, {_squeezed(_words_but("speech", babble))} AS kept FROM {out}_d),
{out}_f AS (SELECT * REPLACE (CASE WHEN {spoken} AND {understood} THEN concat_ws(' ', nullif(kept, ''), e) ELSE kept END AS kept) FROM {out}_e),
{out} AS (SELECT * EXCLUDE (plain, e, speech, said, kept), CASE WHEN said = '' THEN false WHEN contains(said, 'xxx') AND {heard} THEN NULL WHEN said IS NOT NULL THEN true END AS is_speech_related,
  CASE WHEN said = '' OR kept = '' OR length(kept) <> length(said) THEN false WHEN kept IS NOT NULL THEN true END AS is_intelligible FROM {out}_f)"""


def _pair_class() -> str:
    """The class of s said for m meant, '' where it is no error; parts of speech are not known."""
    def either(*ends: str) -> str:
        return "(" + " OR ".join(f"m = s || {text(e)} OR s = m || {text(e)}" for e in ends) + ")"

    def within(pairs) -> str:
        return "(s, m) IN (" + ", ".join(f"({text(a)}, {text(b)})" for a, b in sorted(pairs)) + ")"

    rules = {
        "verb": "m = s || '''ve' OR m = s || '''ll'", "possessive": either("'s"), "plural": f"s IN {texts(V.WRONG_PLURAL)}", "tense_aspect": f"s IN {texts(V.WRONG_TENSE)} OR " + either("ed", "d", "ped", "ted"),
        "progressive": either("ing", "ting", "ning") + " OR m = left(s, greatest(length(s) - 1, 0)) || 'ing' OR m = left(s, greatest(length(s) - 2, 0)) || 'ing' OR s = left(m, greatest(length(m) - 1, 0)) || 'ing'",
    }
    dialect = " OR ".join([within(V.DIALECT | V.WORD_CHOICE_OR_SOUND), "contains(s, '@d')", *(f"s = replace(m, {text(b)}, {text(a)})" for a, b in V.SOUNDS_SAID), *(f"m = replace(s, {text(a)}, {text(b)})" for a, b in V.SHORT_FORMS)])
    classes = " ".join(f"WHEN {within(pairs)}{' OR ' + rules[c] if c in rules else ''} THEN {text(c)}" for c, pairs in V.PAIRS.items())
    return f"CASE WHEN {within(V.SUBJECT_AND_VERB)} THEN 'subject, verb' WHEN {dialect} THEN '' {classes} ELSE 'unk' END"


def _omission_class() -> str:
    """The class of an omitted word w."""
    lists = [("determiner", V.DETERMINERS), ("auxiliary", V.AUXILIARIES), ("verb", VERBS), ("preposition", V.PREPOSITIONS), ("subject", SUBJECTS), ("object", V.OBJECTS), ("possessive", {"'s", "0's", "my", "his", "your"}),
             ("progressive", {"ing"}), ("tense_aspect", {"ed", "en", "ne", "n", "ten", "ped"}), ("sv_agreement", {"es", "es'nt"}), ("plural", {"s"})]
    return "CASE " + " ".join(f"WHEN w IN {texts(ws)} THEN {text(c)}" for c, ws in lists) + " ELSE 'other' END"


def error_labels(source: str, out: str) -> str:
    """labels (joined) and is_grammatical, from raw and error, for error tiers of "said = meant" pieces, omitted words, corrections and [* m]."""
    return f"""{out}_tier AS (SELECT row_id, trim(split_part(p, '=', 1)) AS s, trim(split_part(p, '=', 2)) AS m FROM (SELECT row_id, lower(unnest(string_split(error, ';'))) AS p FROM {source}) WHERE contains(p, '=')),
{out}_fix AS (SELECT row_id, lower(unnest(regexp_extract_all(raw, {text(FIX)}, 1))) AS s, trim(lower(unnest(regexp_extract_all(raw, {text(FIX)}, 2)))) AS m FROM {source}),
{out}_pairs AS (SELECT row_id, s, m FROM {out}_tier UNION ALL SELECT row_id, {_sub("s", r"@\S+|[<>()]")}, m FROM {out}_fix),
{out}_words AS (SELECT row_id, replace(regexp_extract(x, '^0([a-z].*|''.+)', 1), ':', '') AS w FROM (SELECT row_id, {_sub("unnest(regexp_split_to_array(lower(" + _sub("raw", r"\[[^\]]*\]|[<>]", " ") + "), '\\s+'))", r"[()]|@.*|[,;.!?]+$")} AS x FROM {source}) WHERE regexp_matches(x, '^0([a-z]|''.)')),
{out}_found AS (SELECT row_id, {_pair_class()} AS label FROM {out}_pairs WHERE s <> m UNION ALL SELECT row_id, {_omission_class()} FROM {out}_words),
{out}_marked AS (SELECT row_id, label FROM {out}_found WHERE label <> '' UNION SELECT row_id, 'tense_aspect' FROM {source} WHERE contains(raw, '[* m]') AND NOT contains(raw, '[:') AND row_id NOT IN (SELECT row_id FROM {out}_found WHERE label <> '')),
{out}_split AS (SELECT DISTINCT row_id, unnest(string_split(label, ', ')) AS label FROM {out}_marked),
{out}_all AS (SELECT row_id, list_sort(list(label)) AS l FROM {out}_split GROUP BY row_id),
{out} AS (SELECT s.*, array_to_string(CASE WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> 'unk') ELSE l END, ', ') AS labels, CASE WHEN l IS NULL THEN true WHEN l = ['unk'] THEN NULL ELSE false END AS is_grammatical FROM {source} s LEFT JOIN {out}_all a ON a.row_id = s.row_id)"""


# A word, codes that may stand between, and its correction.
FIX = r"(\S+)\s+(?:\[[^:\]][^\]]*\]\s*|\([.\d]*\)\s*)*\[: ([^\]]*)\]"
