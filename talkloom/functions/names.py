"""Names for untranscribed ones ("Mwww"): the same name for the same template throughout a corpus."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

TEMPLATE = r"[_().A-Za-z]+www"
# Titles that tell a sex, and sounds that only look like templates.
FEMALE_TITLES = ["Mrs", "Miss", "Aunty", "Auntie", "Missus", "Granny"]
MALE_TITLES = ["Uncle", "Mr"]
NOT_NAMES = ["eeeowww", "miaoowww", "wwww"]


def assign_names(templates: list[str], names: list[tuple[str, str]]) -> dict[str, str]:
    """A name for each template, in the templates' order: the first unused one of `names` (name, sex; most frequent first) with its initial, or of its title's sex."""
    used: set[str] = set()
    out: dict[str, str] = {}
    for t in sorted(set(templates)):
        if t in NOT_NAMES:
            continue
        stem = re.sub(r"w{3,}", "", t).replace("(.)", "").replace("(", "").replace(")", "")
        title, _, rest = stem.partition("_")
        letter = (rest or ("" if "_" in stem else stem[-1:])).strip("_.").upper()[:1]
        prefix = title if "_" in stem else stem[:-1]
        sex = "girl" if title in FEMALE_TITLES else "boy" if title in MALE_TITLES else None
        fits = [n for n, s in names if n.upper().startswith(letter)] if letter else [n for n, s in names if sex in (None, s)]
        whole = ((prefix + " " + n).strip() for n in fits)
        out[t] = next((w for w in whole if w not in used), (prefix + " " + (letter or "Somebody")).strip())
        used.add(out[t])
    return out


def replace_untranscribed_names(df: DataFrame, names: list[tuple[str, str]], raw: str = "transcript_raw", corpus: str = "corpus") -> DataFrame:
    """df with the templates in `raw` replaced, longest first, by names assigned per corpus.

    Templates are made distinct first; a corpus's different templates (some hundreds) are
    named in one task, and the names are joined back to the rows that hold templates.
    """
    found = df.select(corpus, F.explode(F.regexp_extract_all(raw, F.lit(TEMPLATE), 0)).alias("template")).distinct()

    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = assign_names(pdf["template"].tolist(), names)
        return pd.DataFrame({corpus: key[0], "pairs": [[{"t": t, "n": n} for t, n in sorted(got.items(), key=lambda x: (-len(x[0]), x[0]))]]})

    named = found.groupBy(corpus).applyInPandas(assign, f"{corpus} string, pairs array<struct<t:string,n:string>>")
    d = df.join(named, corpus, "left")
    new = F.aggregate("pairs", F.col(raw), lambda text, p: F.replace(text, p["t"], p["n"]))
    return d.withColumn(raw, F.when(F.col("pairs").isNotNull() & F.col(raw).contains("www"), new).otherwise(F.col(raw))).drop("pairs").select(df.columns)
