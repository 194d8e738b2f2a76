"""Reading uncleaned transcript lines: what was said, by whom, in which transcript.

Everything here is a Column expression, so that cleaning runs inside the scan stage
without Python. A null line is a line in which nothing is said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import stage
from . import fillers

# Spellings of the roles. Left the code, right other ways to write it,
# in capitals and with blanks for underscores.
ROLE_SPELLINGS = {
    "CHI": ["CHI", "TARGET CHILD", "CHILD"],
    "MOT": ["MOT", "MOTHER", "MOM", "MOMMY", "MUM", "MUMMY", "MAMA"],
    "FAT": ["FAT", "FATHER", "DAD", "DADDY", "PAPA"],
    "GRM": ["GRM", "GRANDMOTHER", "GRANDMA", "GRANNY", "GMO", "NANA"],
    "GRF": ["GRF", "GRANDFATHER", "GRANDPA", "GRANDDAD", "GFA"],
    "CAR": ["CAR", "CARETAKER", "CAREGIVER"],
    "INV": ["INV", "INVESTIGATOR"],
    "SIB": ["SIB", "SIBLING", "BROTHER", "SISTER"],
    "OTH": ["OTH", "VISITOR", "OTHER"],
}
# Codes that tell no speaker.
NO_SPEAKER = ["", "?", "UNK", "UNKNOWN", "XXX", "NA", "N/A", "NONE", "NULL"]
# Cyrillic and Greek capitals that look like Latin ones.
LOOKALIKES = ("АВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABESIJKMHOPCTYXABEZHIKMNOPTYX")
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
INVISIBLE = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD]))
BLANKS = "".join(map(chr, [0xA0, 0x2007, 0x202F, 0x3000])) + "\t"

# Time marks: \x15 or bullet marks, subtitle ranges, bracketed and bare clock times.
TIME_MARKS = "|".join([
    r"\x15[^\x15]*\x15",
    r"•[0-9]+_[0-9]+•",
    r"(?<!\S)[0-9]+:[0-9]{2}:[0-9]{2}[.,][0-9]+(?:\s*-->\s*[0-9]+:[0-9]{2}:[0-9]{2}[.,][0-9]+)?(?!\S)",
    r"\[[0-9]+:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?(?:-[0-9]+:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?)?\]",
    r"\([0-9]+:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?\)",
])
# A speaker label that opens a line: "*MOT:", "Target Child:", "[MOT]"; up to six words of any length.
LABEL = r"^\s*(?:\*?([\p{L}?][\p{L}\p{N}_'-]*(?: +[\p{L}\p{N}_'-]+){0,5})\s*:(?=\s|$)|\[([\p{L}\p{N}]{3})\])"
# Notes of sounds, actions and events, pauses and coding marks that stand in brackets or stars.
NOTES = "|".join([
    r"\(\([^)]*\)\)",
    r"\{[^}]*\}",
    r"\[[^\]]*\]",
    r"(?<!\S)\*[^\s*][^*]*\*(?![\p{L}\p{N}])",
    r"(?<!\S)\([^()]*\)(?![\p{L}\p{N}])",
])
# Filled pauses are what boosted trees take for such; their verdicts are compiled.
FILLED_PAUSE = fillers.pattern()
UNINTELLIGIBLE = r"x{2,3}|y{2,3}|w{3}"
# Words of which nothing counts as said: codes with & (events, fragments, fillers), linkers and
# terminators with +, omitted words with 0, babble with @b, filled pauses, and unintelligible speech.
UNSAID_WORDS = (
    r'(?<!\S)[<“”"‘(]*'
    rf"(?:[&+0‡]\S*|[\p{{L}}']+@b\S*|(?iu:{FILLED_PAUSE}|{UNINTELLIGIBLE})(?:@\S*)?[^\s\p{{L}}\p{{N}}]*)(?!\S)"
)


def _where_any(c: Column, marks: str, then: Column) -> Column:
    """`then` where c holds any of the marks, else c: a byte search spares most lines the regular expression."""
    found = reduce(lambda x, y: x | y, [c.contains(m) for m in marks])
    return F.when(found, then).otherwise(c)


def tidy(c: Column) -> Column:
    """c without invisible characters, and with plain blanks."""
    return F.translate(c, BLANKS + INVISIBLE, " " * len(BLANKS))


def transcript_key(path: Column) -> Column:
    """One spelling of a transcript's path for joining; null for a null or blank path.

    Blind to case, blanks, the direction and number of slashes, a leading "./" and a missing ".cha".
    """
    # most paths need no more than small letters
    usual = path.endswith(".cha") & ~(path.contains("\\") | path.contains("//") | path.contains(" ") | path.contains("\t") | path.startswith(".") | path.startswith("/")) & (F.octet_length(path) == F.length(path))
    p = F.translate(F.lower(path), "\\ \n\r" + BLANKS + INVISIBLE, "/")
    p = F.replace(F.replace(p, F.lit("//"), F.lit("/")), F.lit("//"), F.lit("/"))
    p = F.replace(F.concat(F.ltrim(p, F.lit("./")), F.lit("|")), F.lit(".cha|"), F.lit("|"))
    return F.when(usual, F.lower(F.left(path, F.length(path) - 4))).otherwise(F.nullif(F.rtrim(p, F.lit("|")), F.lit("")))


def child_key(name: Column, corpus: Column) -> Column:
    """One spelling of a child's name for joining: letters and digits, led by its corpus; null for a blank name."""
    drop = "".join(c for c in NARROW if not c.isalnum()) + " \n\r" + BLANKS + INVISIBLE
    bare = lambda c: F.translate(F.lower(c), drop, "")
    n, k = bare(name), F.coalesce(bare(corpus), F.lit(""))
    return F.when(n != "", F.when(n.startswith(k), n).otherwise(F.concat(k, n)))


def bare_speaker(code: Column) -> Column:
    """A speaker code or label in capitals without its marks."""
    c = F.translate(tidy(code), WIDE, NARROW)
    return F.trim(F.regexp_replace(F.upper(c), r"[*\[\]():.,_\s]+", " "))


def role_of(bare: Column) -> Column:
    """The role's code that a bare speaker names, else null (it may still be a person's name)."""
    latin = F.translate(bare, *LOOKALIKES)
    code = F.when(F.length(latin) == 3, F.translate(latin, "0135", "OIES")).otherwise(latin)
    spellings = F.create_map(*[F.lit(x) for code_, all_ in ROLE_SPELLINGS.items() for s in all_ for x in (s, code_)])
    return F.element_at(spellings, code)


def with_said(df: DataFrame, raw: str = "transcript_raw") -> DataFrame:
    """Adds what a line says.

    said_text  the words said, without marks; '' if nothing is said, also for a null line
    said       whether anything is said
    label      the speaker label that opens the line, as written; '' where there is none

    Each step is a column of its own, so that none is worked out twice. Speakers are told
    apart later (with_roles): both together make methods too long for the JVM to compile.
    """
    t = F.col("_t")
    steps = [
        ("_t", F.coalesce(F.col(raw), F.lit(""))),
        ("_t", F.when((F.octet_length(t) != F.length(t)) | t.contains("\t"), tidy(t)).otherwise(t)),
        ("_t", _where_any(t, ":\x15•", F.regexp_replace(t, TIME_MARKS, " "))),
        ("label", F.when(t.contains(":") | t.contains("["), F.regexp_extract(t, LABEL, 0)).otherwise("")),
        ("_t", F.when(F.col("label") != "", F.expr("substr(_t, length(label) + 1)")).otherwise(t)),
        ("_t", _where_any(t, ":", F.regexp_replace(t, r"(?<=\p{L}):(?=\p{L})", ""))),
        ("_t", _where_any(t, "([{*", F.regexp_replace(t, NOTES, " "))),
        ("_t", F.regexp_replace(t, UNSAID_WORDS, " ")),
        ("_t", _where_any(t, '@<>()“”"', F.regexp_replace(t, r'@[^\s.,!?]+|[<>()“”"]', ""))),
        ("said_text", F.trim(F.regexp_replace(t, r"(?<!\S)[^\p{L}\p{N}\s.!?]+(?!\S)|\s+(?=[.!?\s]|$)", ""))),
        ("said", F.col("said_text").rlike(r"[\p{L}\p{N}]")),
    ]
    for name, c in steps:
        df = df.withColumn(name, c)
    return df.drop("_t")


def with_roles(df: DataFrame, code: str = "speaker_code", label: str = "label") -> DataFrame:
    """Adds who is told to speak a line of with_said; takes the code and the label away.

    role            the speaker's code where speaker_code names a role
    role_2          the same of the label, where the code does not
    name_1, name_2  names to look up among the transcript's people where role is null (of the code, of the label)
    """
    roles = list(ROLE_SPELLINGS)
    steps = [
        ("_c", F.when(F.col(code).isin(roles), F.col(code)).otherwise(bare_speaker(F.col(code)))),
        ("_c", F.when(~F.col("_c").isin(NO_SPEAKER), F.col("_c"))),
        ("role", F.when(F.col("_c").isin(roles), F.col("_c")).otherwise(role_of(F.col("_c")))),
        ("name_1", F.when(F.col("role").isNull(), F.col("_c"))),
        ("_l", F.when(F.col("role").isNull() & (F.col(label) != ""), bare_speaker(F.col(label)))),
        ("name_2", F.when(~F.col("_l").isin(NO_SPEAKER), F.col("_l"))),
        ("role_2", F.when(F.col("name_2").isNotNull(), role_of(F.col("name_2")))),
    ]
    for name, c in steps:
        df = df.withColumn(name, c)
    return df.drop("_c", "_l", code, label)


def only(df: DataFrame, wanted: Column, *without: str) -> DataFrame:
    """df's rows where `wanted` holds, without some columns.

    Written as a generator, as a filter would be pushed below the cleaning and have it done twice.
    """
    keep = [c for c in df.columns if c not in without]
    return df.select(F.explode(F.when(wanted, F.array(F.struct(*keep)))).alias("x")).select("x.*")


def only_known(df: DataFrame, column: str) -> DataFrame:
    """df's rows whose column is not null, by a generator over that column alone, so that the others can still be pruned."""
    known = F.explode(F.when(F.col(column).isNotNull(), F.array(column))).alias("_known")
    return df.select(*[c for c in df.columns if c != column], known).withColumnRenamed("_known", column)


def words_hash(text: Column) -> Column:
    """A 64-bit hash of the words of a cleaned line, blind to case, punctuation and spacing."""
    return F.xxhash64(F.trim(F.translate(F.lower(text), ".,!?…;\"“”„()<>‡", "")))


def people(transcripts: DataFrame, participants: DataFrame, *more: str) -> DataFrame:
    """A row per transcript: key, transcript_file, the named people as (name, code), and the columns `more`.

    Each role occurs at most once per transcript, so the lists are short. Of transcripts
    whose spellings give one key, the smallest spelling is kept.
    """
    names = (
        participants.select(transcript_key(F.col("transcript_file")).alias("key"), bare_speaker(F.col("participant_name")).alias("name"), F.col("speaker_code").alias("code"))
        .where("key is not null and name != ''")
        .groupBy("key").agg(F.array_sort(F.collect_set(F.struct("name", "code"))).alias("names"))
    )
    head = (
        transcripts.withColumn("key", transcript_key(F.col("transcript_file"))).where("key is not null")
        .groupBy("key").agg(F.min_by(F.struct("transcript_file", *more), "transcript_file").alias("h"))
        .select("key", "h.*")
    )
    return head.join(names.hint("shuffle_hash"), "key", "left")


#: Transcripts with more rows than this are worked on in blocks of BLOCK_IDS places, over several tasks.
HOT_ROWS = 1_000_000
BLOCK_IDS = 4096
COUNTED_ROWS = 64


def hot_transcripts(utterances: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """key of the transcripts with more than about hot_rows rows, or None where there is none.

    They are told from every COUNTED_ROWS-th row by hash; what is hot is only worked on
    differently, with the same result, so a miss near the limit does no harm.
    """
    if utterances.count() <= hot_rows:  # from the files' footers
        return None
    every = COUNTED_ROWS if hot_rows >= 100 * COUNTED_ROWS else 1
    counted = utterances.where(F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0)
    hot = counted.groupBy(transcript_key(F.col("transcript_file")).alias("key")).agg((F.count(F.lit(1)) * every).alias("n")).where((F.col("n") > hot_rows) & F.col("key").isNotNull())
    hot = stage(hot.select("key"))
    return None if hot.isEmpty() else hot


def with_speaker(df: DataFrame) -> DataFrame:
    """Adds speaker to rows of with_said joined with people(); takes away what it is told from."""
    return with_roles(df).withColumn("speaker", speaker()).drop("names", "name_1", "name_2", "role", "role_2")


def speaker(names: str = "names") -> Column:
    """The speaker of a row of with_roles joined with people(), else null."""
    def named(n: str) -> Column:
        return F.get(F.filter(names, lambda x: x["name"] == F.col(n)), 0)["code"]

    found = [F.col("role"), F.when(F.col("name_1").isNotNull(), named("name_1")), F.col("role_2"), F.when(F.col("name_2").isNotNull(), named("name_2"))]
    return reduce(lambda a, b: F.coalesce(a, b), found)
