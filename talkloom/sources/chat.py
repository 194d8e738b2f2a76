"""Reading transcripts in the CHAT format and other text layouts into tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.chat import CAREGIVERS, clean_steps, has_multiple_events, is_external_event, strip_steps
from ..functions.error_values import OTHER_SCHEME
from ..functions.errors import raw_tokens
from ..functions.steps import steps
from ..functions.words import is_empty

GRA = T.StructType([T.StructField("dep", T.IntegerType()), T.StructField("head", T.IntegerType()), T.StructField("rel", T.StringType())])
UTTERANCES = T.StructType([
    T.StructField("utterance_id", T.IntegerType()), T.StructField("speaker_code", T.StringType()), T.StructField("transcript_raw", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("pos", T.ArrayType(T.StringType())), T.StructField("gra", T.ArrayType(GRA)),
    T.StructField("start_time", T.LongType()), T.StructField("end_time", T.LongType()), T.StructField("age", T.IntegerType()), T.StructField("corpus", T.StringType()),
    T.StructField("transcript_file", T.StringType()), T.StructField("child_name", T.StringType()), T.StructField("error", T.StringType()),
])
# Part-of-speech tags of punctuation, which stand for no word.
PUNCTUATION_TAGS = {".", "?", "...", "!", "+/", "+/?", "...?", ",", "-", '+"/.', "+...", "++/.", "+/."}


def _months(age: str) -> int | None:
    """Months of an age written years;months.days, days rounded half to even."""
    m = re.match(r"(\d+);(\d+)?\.?(\d+)?", age or "")
    return round(int(m[1]) * 12 + int(m[2] or 0) + int(m[3] or 0) / 30) if m else None


def parse_transcript(text: str, path: str) -> list[dict]:
    """The utterances of one file. Main lines begin with *, tiers with %, headers with @; indented lines go on."""
    lines: list[str] = []
    for raw in text.replace("\r\n", "\n").split("\n"):
        if raw[:1] in ("\t", " ") and lines:
            lines[-1] += " " + raw.strip()
        elif raw.strip():
            lines.append(raw)
    child, age, rows = None, None, []
    parts = path.rstrip("/").split("/")
    corpus = parts[-3] if len(parts) > 2 else parts[0]
    for line in lines:
        head, _, body = line.partition(":")
        body = body.strip()
        if line.startswith("@Participants"):
            for p in body.split(","):
                words = p.split()
                if words[:1] == ["CHI"]:
                    child = words[1] if len(words) > 2 else "Target_Child"
        elif line.startswith("@ID"):
            fields = body.split("|")
            if len(fields) > 3 and fields[2] == "CHI":
                age = _months(fields[3])
        elif line.startswith("*"):
            m = re.search(r"\x15(\d+)_(\d+)\x15", body)
            raw = re.sub(r"\x15[^\x15]+?\x15", "", body).strip()
            rows.append(dict(utterance_id=len(rows), speaker_code=head[1:], transcript_raw=raw, tokens=raw_tokens(raw), pos=[], gra=[], start_time=int(m[1]) if m else None, end_time=int(m[2]) if m else None,
                             age=None, corpus=corpus, transcript_file="/".join(parts[-3:]), child_name=None, error=None))
        elif line.startswith("%") and rows:
            if head == "%mor":
                tags = [w.split("|")[0] for w in body.split()]
                rows[-1]["pos"] = [t.lower() for t in tags if t not in PUNCTUATION_TAGS]
            elif head == "%gra":
                rows[-1]["gra"] = [dict(dep=int(a), head=int(b), rel=c) for a, b, c in (w.split("|") for w in body.split() if w.count("|") == 2)]
            elif head == "%err":
                rows[-1]["error"] = body
    for r in rows:
        r["age"], r["child_name"] = age, f"{corpus}_{child}" if child else None
    return rows


def read_chat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All utterances of CHAT files (whole files, parsed in parallel); file names tell corpus and transcript."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, path in zip(b["value"], b["path"]):
                rows = parse_transcript(text, path.removeprefix("file:"))
                if rows:
                    out = pd.DataFrame(rows, columns=[f.name for f in UTTERANCES])
                    yield out.astype({c: "Int64" for c in ("start_time", "end_time", "age")})

    return files.mapInPandas(parse, UTTERANCES)


def transcript_gates(df: DataFrame, require_timing: bool = False, caregivers: list[str] | None = None) -> DataFrame:
    """Rows of transcripts in which the child and a caregiver speak, that are no interviews, and, if asked for, have times."""
    care = F.col("speaker_code").isin(caregivers or CAREGIVERS)
    g = df.groupBy("transcript_file").agg(F.bool_or(F.col("speaker_code") == "CHI").alias("c"), F.bool_or(care).alias("g"), F.bool_or(F.col("start_time").isNotNull()).alias("t"))
    kept = g.where(F.col("c") & F.col("g") & ~F.col("transcript_file").contains("Interview") & (F.col("t") | F.lit(not require_timing)))
    return df.join(kept.select("transcript_file"), "transcript_file", "left_semi")


def row_gates(df: DataFrame, raw: str = "transcript_raw") -> DataFrame:
    """Rows with at most one event that is not an external one on its own, and with more than punctuation; "O ." is read as "0 ."."""
    df = df.withColumn(raw, F.when(F.col(raw) == "O .", "0 .").otherwise(F.col(raw))).where(F.col(raw).isNotNull())
    return df.where(~has_multiple_events(F.col(raw)) & ~is_external_event(F.col(raw)) & ~is_empty(F.col(raw)))


# Where corpora tell a missing name (the file's name, without digits, without its last letter, its first five letters, or its folder) ...
NAME_FROM_PATH = {
    "file": ["EllisWeismer", "Bates"], "file without digits": ["Edinburgh", "Tommerdahl", "Rollins"], "file without last letter": ["Valian"], "first five of file": ["HSLLD"],
    "folder": ["Bernstein", "McCune", "Sekali", "Belfast", "MPI-EVA-Manchester"],
}
# ... and a missing age: years and months in the file's first four letters, or months in two letters of the file or the folder.
AGE_FROM_PATH = {
    "yymm of file": ["MPI-EVA-Manchester", "Bernstein", "Brent", "Braunwald", "Weist", "MacWhinney", "Belfast", "Sekali"], "third and fourth of file": ["Rollins"], "first two of folder": ["EllisWeismer"],
}


def name_and_age_from_path(path: Column, corpus: Column, age: Column, name: Column, names: dict[str, list[str]] = NAME_FROM_PATH, ages: dict[str, list[str]] = AGE_FROM_PATH) -> tuple[Column, Column]:
    """(child_name, age) with what is missing read from the path, by lists of corpora; null where neither tells it.

    A name is missing where it is null or says "Target_Child" only, an age where it is null or 0.
    """
    base, folder = F.regexp_extract(path, r"([^/]+?)(?:\.cha)?$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    number = lambda c: F.try_to_number(c, F.lit("99")).cast("int")
    of = lambda kinds, values: F.coalesce(*[F.when(corpus.isin(kinds[k]), v) for k, v in values.items() if kinds.get(k)], F.lit(None))
    found = of(names, {"file": base, "file without digits": F.regexp_replace(base, r"\d", ""), "file without last letter": F.left(base, F.length(base) - 1), "first five of file": F.left(base, F.lit(5)), "folder": folder})
    told = of(ages, {"yymm of file": number(F.substring(base, 1, 2)) * 12 + number(F.substring(base, 3, 2)), "third and fourth of file": number(F.substring(base, 3, 2)), "first two of folder": number(F.substring(folder, 1, 2))})
    missing = name.isNull() | name.endswith("_Target_Child") | (name == "Target_Child")
    return F.when(missing & found.isNotNull(), F.concat_ws("_", corpus, found)).otherwise(name), F.when(age.isNull() | (age == 0), told.cast("int")).otherwise(age)


def read_error_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """transcript_raw, response_transcript_raw, is_grammatical, labels, transcript_file of blank-line-separated blocks of a child's line, a response and "%cof: $ERR = ..." ; blocks without $ERR are left out."""
    b = spark.read.option("lineSep", "\n\n").text(paths).select("value", F.col("_metadata.file_path").alias("transcript_file"))
    tier = F.regexp_extract("value", r"(?m)^%cof:(.*)$", 1)
    codes = F.regexp_extract_all(tier, F.lit(r"\$ERR = ([^;\n]*)"), 1)
    scheme = F.create_map(*[F.lit(x) for kv in OTHER_SCHEME.items() for x in kv])
    none = F.array_contains(codes, "0")
    d = b.where(tier.contains("$ERR")).select(
        F.regexp_extract("value", r"(?m)^\*CHI:(.*)$", 1).alias("_child"), F.regexp_extract("value", r"(?m)^\*(?:CAR|MOT|INV|DAD|FAT|GRM|GRF):(.*)$", 1).alias("_care"),
        none.alias("is_grammatical"), F.when(~none, F.array_join(F.transform(codes, lambda c: scheme[F.trim(c)]), ", ")).alias("labels"), "transcript_file")
    for side, pre in (("_child", ""), ("_care", "response_")):
        d = steps(d, strip_steps(F.col(side), f"{pre}transcript_raw") + clean_steps(f"{pre}transcript_raw", f"{pre}transcript_clean"))
    return d.drop("_child", "_care").withColumn("prev_transcript_clean", F.lit("."))


def read_minimal_pairs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """transcript_clean, prev_transcript_clean ("."), is_grammatical (0 on the first line of a pair, 1 on the second), line_no."""
    t = spark.read.text(paths, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("line_no", "transcript_clean"))
    return t.select("transcript_clean", F.lit(".").alias("prev_transcript_clean"), (F.col("line_no") % 2).alias("is_grammatical"), "line_no")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: the different lines of a headerless file."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word != ''").distinct()


def read_names(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, sex) of a names table with columns name, sex, percent, most frequent first; a small table by its nature."""
    rows = spark.read.csv(path, header=True, schema="name string, sex string, percent double").dropna(subset=["name"]).orderBy(F.desc("percent"), "name").select("name", "sex").collect()
    return [(r["name"], r["sex"]) for r in rows]


def read_annotated(spark: SparkSession, folder: str, corpus: str = "") -> DataFrame:
    """row_id, utterance, is_grammatical, labels, note, transcript of all <corpus>*_annotated.csv files of a folder."""
    d = spark.read.csv(f"{folder}/{corpus}*_annotated.csv", header=True, escape='"', multiLine=True, schema="row_id long, utterance string, is_grammatical string, labels string, note string")
    return d.withColumn("transcript", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_annotated\.csv$", 1))


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header and quoted line breaks, read by a given schema. Array columns are Python literals and come as arrays."""
    declared = T.StructType.fromDDL(schema)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in declared])
    df = spark.read.csv(path, schema=flat, header=True, escape='"', multiLine=True)
    for f in declared:
        if isinstance(f.dataType, T.ArrayType):
            text = F.regexp_replace(F.regexp_replace(F.col(f.name), r"\bNone\b", "null"), r"""(?<=[\[,{:\s])'|'(?=[\],}:])""", '"')
            df = df.withColumn(f.name, F.from_json(text, f.dataType))
    return df


def write_language_model_lines(df: DataFrame, path: str, separator: str = "[SEP]", end: str = "[EOS]") -> None:
    """One line of text per row: the text before, the separator, the text, the end mark. A null text before is empty."""
    df.select(F.concat(F.coalesce("prev_transcript_clean", F.lit("")), F.lit(separator), F.col("transcript_clean"), F.lit(end)).alias("value")).where("value is not null").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with header that read_table_csv reads again; arrays and structs are written as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_by_corpus(df: DataFrame, path: str) -> None:
    """Parquet files in a folder per corpus."""
    df.write.mode("overwrite").partitionBy("corpus").parquet(path)


def latex_table(df: DataFrame, most_rows: int = 1000) -> str:
    """A small result as a LaTeX table; more than most_rows rows are an error."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows do not make a table to print")
    safe = lambda v: re.sub(r"([&%$#_{}])", r"\\\1", "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
    body = "\n".join(" & ".join(map(safe, r)) + r" \\" for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n\\hline\n{' & '.join(map(safe, df.columns))} \\\\\n\\hline\n{body}\n\\hline\n\\end{{tabular}}"
