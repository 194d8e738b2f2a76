"""Words and punctuation of transcript lines, as Column expressions (null in, null out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Blanks as Python's \s knows them; Java's \s alone misses the no-break space and its like.
BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"


def words(c: Column, on_apostrophe: bool = True, commas: bool = False, trailing: bool = False) -> Column:
    """The words of a line. commas: commas part words too; trailing: the last character is dropped first, whatever it is."""
    if trailing:
        c = F.when(F.length(c) > 0, F.left(c, F.length(c) - 1)).otherwise(c)
    parts = BLANK + ("|'" if on_apostrophe else "") + ("|," if commas else "")
    return F.filter(F.split(c, parts), lambda w: w != "")


def num_words(c: Column, punctuation: bool = True) -> Column:
    """How many words, parted at apostrophes; punctuation: commas and the last character do not count."""
    return F.size(words(c, True, punctuation, punctuation))


def num_unique_words(c: Column, punctuation: bool = True) -> Column:
    """How many different words, not parted at apostrophes."""
    return F.size(F.array_distinct(words(c, False, punctuation, punctuation)))


def remove_punctuation(c: Column, commas: bool = False) -> Column:
    """Without double quotation marks, doubled apostrophes and the final run of . ! ?; double blanks are halved once."""
    c = F.replace(F.replace(F.translate(c, '"„”', ""), F.lit("''"), F.lit("")), F.lit("  "), F.lit(" "))
    if commas:
        c = F.replace(c, F.lit(","), F.lit(""))
    return F.trim(F.regexp_replace(c, r"[.!?]+\s*$", ""))


def final_punctuation(c: Column) -> Column:
    """The leftmost mark of the final run of . ! ?, '' where there is none."""
    return F.regexp_extract(c, r"([.!?])[.!?]*$", 1)


def is_empty(c: Column) -> Column:
    """Whether nothing but punctuation is there."""
    return remove_punctuation(c) == ""


def word_pairs(ws: Column) -> Column:
    """The neighbouring pairs (first, second) of an array of words, in order."""
    n = F.size(ws)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(ws, i).alias("first"), F.get(ws, i + 1).alias("second")))).otherwise(
        F.array().cast("array<struct<first:string,second:string>>"))


def parse_bool(c: Column) -> Column:
    """True, false or null as people write them (yes/true/t/y/1, no/false/f/n/0, none/nan); anything else is an error."""
    v = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | v.isin("none", "nan"), F.lit(None).cast("boolean")).when(v.isin("yes", "true", "t", "y", "1"), True)
        .when(v.isin("no", "false", "f", "n", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), c)).cast("boolean"))
    )


def age_bin(age: Column, least: int, most: int, months: int) -> Column:
    """The age bin: the nearest multiple of `months` by cutting, held between least and most."""
    return F.least(F.lit(most), F.greatest(F.lit(least), (F.floor((age + months / 2) / months) * months).cast("int")))


def special_token(speaker: Column, caregivers: list[str]) -> Column:
    """[CHI], [CAR] or [OTH]."""
    return F.when(speaker == "CHI", "[CHI]").when(speaker.isin(caregivers), "[CAR]").otherwise("[OTH]")
