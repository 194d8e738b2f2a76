"""Filters, grouped proportions, contingencies, label shares and reshaping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.words import words


# ---- Filters ------------------------------------------------------------------------
def age_between(df: DataFrame, least: int, most: int, age: str = "age") -> DataFrame:
    """Rows with an age from least to most, both included; null ages are dropped."""
    return df.where(F.col(age).between(least, most))


def filter_corpora(df: DataFrame, included: list[str] = (), excluded: list[str] = (), corpus: str = "corpus") -> DataFrame:
    """Rows of the included corpora without the excluded ones; an empty list is no filter. Null corpora stay unless some are included."""
    if included:
        df = df.where(F.col(corpus).isin(list(included)))
    return df.where(F.coalesce(~F.col(corpus).isin(list(excluded)), F.lit(True))) if excluded else df


def exclude_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value is not listed; nulls stay."""
    return df.where(F.coalesce(~F.col(column).isin(list(values)), F.lit(True)))


def not_known_false(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is true or null."""
    return df.where(~F.col(flag).eqNullSafe(False))


def at_least_words(df: DataFrame, text: str, least: int, on_apostrophe: bool = False) -> DataFrame:
    """Rows whose text, its last character aside, has at least so many words."""
    return df.where(F.size(words(F.col(text), on_apostrophe, True, True)) >= least)


def more_than_child_rows(df: DataFrame, n: int) -> DataFrame:
    """Rows of the transcripts with more than n child rows (one shuffle, no join)."""
    child = F.sum((F.col("speaker_code") == "CHI").cast("int")).over(Window.partitionBy("transcript_file"))
    return df.withColumn("_n", child).where(F.col("_n") > n).drop("_n")


def groups_having(df: DataFrame, key: str, aggregate: Column, test) -> DataFrame:
    """Rows of the groups whose aggregate passes the test."""
    kept = df.groupBy(key).agg(aggregate.alias("_a")).where(test(F.col("_a"))).select(key)
    return df.join(kept, key, "left_semi")


def cascade_flags(df: DataFrame) -> DataFrame:
    """What is not speech is not intelligible, and what is not intelligible is not grammatical (where the columns exist)."""
    for flag, by in (("is_intelligible", "is_speech_related"), ("is_grammatical", "is_intelligible")):
        if flag in df.columns and by in df.columns:
            df = df.withColumn(flag, F.when(F.col(by).eqNullSafe(False), False).otherwise(F.col(flag)))
    return df


# ---- Proportions --------------------------------------------------------------------
def proportions(df: DataFrame, by: list[str], flag: str, total: bool = False, drop: str | None = None, z: float = 1.96) -> DataFrame:
    """by..., n, n_true, proportion, low, high: the share of true flags per group; null flags do not count.

    total: also all groups of `drop` together (that column null, is_total true), in one
    pass by grouping sets. low and high bound the share by Wilson's interval.
    """
    d = df.select(*by, F.col(flag).cast("boolean").alias("_f"))
    aggregates = [F.count("_f").alias("n"), F.count_if("_f").alias("n_true")]
    if total:
        rest = [c for c in by if c != drop]
        g = d.groupingSets([[F.col(c) for c in by], [F.col(c) for c in rest]], *by).agg(*aggregates, (F.grouping(drop) == 1).alias("is_total"))
    else:
        g = d.groupBy(*by).agg(*aggregates)
    p, n = F.try_divide(F.col("n_true").cast("double"), F.col("n")), F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    known = n > 0
    return g.withColumns({"proportion": p, "low": F.when(known, F.greatest(F.lit(0.0), mid - half)), "high": F.when(known, mid + half)})


def subtype_proportions(df: DataFrame, by: list[str], subtypes: list[str], flag: str) -> DataFrame:
    """subtype, holds, by..., n, n_true, proportion of a flag: per subtype the rows where it holds against those where no subtype does.

    One pass: each row is counted under each subtype that it bears or is a base row for.
    """
    other = reduce(lambda a, b: a | b, [F.coalesce(F.col(s), F.lit(False)) for s in subtypes])
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(F.col(s), F.lit(False)) | ~other, F.struct(F.lit(s).alias("subtype"), F.coalesce(F.col(s), F.lit(False)).alias("holds"))) for s in subtypes]))
    d = df.select(*by, flag, F.explode(kinds).alias("_k")).select(*by, flag, "_k.*")
    return proportions(d, ["subtype", "holds", *by], flag)


def contingency(df: DataFrame, by: str, condition: str, outcome: str) -> DataFrame:
    """by, contingency: mean outcome where the condition holds less where it does not, per group; groups without either are dropped."""
    y = F.col(outcome).cast("double")
    g = df.groupBy(by).agg((F.avg(F.when(F.col(condition), y)) - F.avg(F.when(~F.col(condition), y))).alias("contingency"))
    return g.where("contingency is not null")


def contingency_summary(df: DataFrame, by: str, condition: str, outcome: str) -> DataFrame:
    """n, mean, std (of the population), sem (of the sample mean) of the contingencies of all groups."""
    x = F.col("contingency")
    return contingency(df, by, condition, outcome).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"))


def per_transcript(df: DataFrame, flags: list[str], age: str = "age") -> DataFrame:
    """transcript_file, mean of each flag, least and mean age."""
    return df.groupBy("transcript_file").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags], F.min(age).alias("min_age"), F.avg(age).alias("mean_age"))


def value_shares(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """column, n, share of all rows; the total is summed over the values' counts."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_all"))
    return g.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_all")).alias(name))  # one row of totals


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; ties go by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def top_words(df: DataFrame, text: str, k: int) -> DataFrame:
    """The k most frequent words in small letters."""
    return top_values(df.select(F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("word")), "word", k)


def with_known_words(words: DataFrame, vocabulary: DataFrame, column: str = "word", dictionary: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Adds is_word: whether a row's word, in small letters, is one of the vocabulary (a table with a column `word`), or else the dictionary knows it.

    A null word is no word. dictionary: a function of a series of words; it is asked about different
    words only, and only about those that the vocabulary lacks.
    """
    w = F.lower(column)
    there = vocabulary.select(F.lower("word").alias("_w")).where("_w is not null").distinct().withColumn("_there", F.lit(True))
    if dictionary:
        @F.pandas_udf("boolean")
        def knows(s: pd.Series) -> pd.Series:
            return dictionary(s)

        asked = words.select(w.alias("_w")).where("_w is not null").distinct().join(there, "_w", "left_anti").withColumn("_there", knows("_w"))
        there = there.unionByName(asked)
    return words.join(there, w == F.col("_w"), "left").withColumn("is_word", F.coalesce("_there", F.lit(False))).drop("_w", "_there")


def top_ngrams(df: DataFrame, text: str, n: int, k: int) -> DataFrame:
    """The k most frequent runs of n words in small letters (of the word sequence, not of its different words)."""
    d = df.select(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "").alias("_w")).where(F.size("_w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, F.lit(n)), " "))
    return top_values(d.select(F.explode(runs).alias("ngram")), "ngram", k)


# ---- Labels and reshaping -----------------------------------------------------------
def explode_labels(df: DataFrame, labels: str = "labels", nulls_as: str | None = "nan", separator: str = ", ") -> DataFrame:
    """One row per label of a joined string; a null stands for the label `nulls_as`, or gives no row if that is None."""
    c = F.coalesce(F.col(labels), F.lit(nulls_as)) if nulls_as is not None else F.col(labels)
    return df.withColumn(labels, F.explode(F.split(c, separator)))


def share_by_condition(df: DataFrame, label: str, conditions: dict[str, Column]) -> DataFrame:
    """label, condition, n, share: how labels are shared out under each condition; a label missing under one has 0 there.

    One pass: conditional counts per label, then unpivoted; shares are of each condition's total.
    """
    g = df.groupBy(label).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    long = g.unpivot(label, list(conditions), "condition", "n")
    total = Window.partitionBy("condition")
    return long.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(total)), F.lit(0.0)))


def in_fixed_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """A row for each value of `order` with its place, whether df has it or not."""
    places = df.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {column} string")
    return F.broadcast(places).join(df, column, "left")


def melt_follow_up(df: DataFrame, suffix: str, keep: list[str], index: str = "index") -> DataFrame:
    """conversation_id, is_follow_up, <suffix>, keep...: two rows per triple, of the turn and of its follow-up."""
    kept = [c for c in keep if c in df.columns]
    long = df.select(F.col(index).alias("conversation_id"), *kept, f"utt_{suffix}", f"follow_up_{suffix}").unpivot(["conversation_id", *kept], [f"utt_{suffix}", f"follow_up_{suffix}"], "_which", suffix)
    return long.withColumn("is_follow_up", F.col("_which") == f"follow_up_{suffix}").drop("_which")


def error_ratios(df: DataFrame, corpus: str = "corpus", is_error: Column | None = None) -> DataFrame:
    """corpus, n_utterances, n_errors, ratio, mean_age, lowest ratio first."""
    e = is_error if is_error is not None else ~F.coalesce(F.col("is_grammatical"), F.lit(True))
    return df.groupBy(corpus).agg(F.count(F.lit(1)).alias("n_utterances"), F.count_if(e).alias("n_errors"), F.avg("age").alias("mean_age")).withColumn("ratio", F.col("n_errors") / F.col("n_utterances")).orderBy("ratio", corpus)


def corpus_label_shares(df: DataFrame, corpus: str, label: str, more_than: int = 0) -> DataFrame:
    """corpus, label, n, share within the corpus, of the corpora with more than so many rows."""
    g = df.groupBy(corpus, label).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy(corpus)))
    return g.where(F.col("_all") > more_than).select(corpus, label, "n", (F.col("n") / F.col("_all")).alias("share"))


def centred(df: DataFrame, column: str, stats_of: DataFrame | None = None) -> DataFrame:
    """Adds <column>_centred: less the mean, over the range (null where the range is 0); statistics are those of `stats_of`."""
    s = (stats_of if stats_of is not None else df).agg(F.avg(column).alias("_mean"), (F.max(column) - F.min(column)).alias("_range"))
    return df.crossJoin(F.broadcast(s)).withColumn(f"{column}_centred", F.try_divide(F.col(column) - F.col("_mean"), F.col("_range"))).drop("_mean", "_range")  # one row of statistics


def plus_minus_half(c: Column) -> Column:
    """0.5 for true, -0.5 for false, null for null."""
    return F.when(c, 0.5).when(~c, -0.5)


def accuracies(df: DataFrame, truth: str, models: list[str]) -> DataFrame:
    """model, n, accuracy, accuracy_true, accuracy_false of boolean model columns, over the rows where both are known."""
    long = df.select(F.col(truth).alias("_t"), *models).unpivot(["_t"], models, "model", "_p").where("_t is not null and _p is not null")
    right = (F.col("_t") == F.col("_p")).cast("double")
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(F.when(F.col("_t"), right)).alias("accuracy_true"), F.avg(F.when(~F.col("_t"), right)).alias("accuracy_false"))


def mean_correct_by_label(df: DataFrame, label: str, models: list[str]) -> DataFrame:
    """label, model, share_correct of boolean <model>_is_correct columns."""
    cols = [f"{m}_is_correct" for m in models]
    g = df.groupBy(label).agg(*[F.avg(F.col(c).cast("double")).alias(m) for c, m in zip(cols, models)])
    return g.unpivot(label, models, "model", "share_correct")


def counts_where(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: n and, per condition, how many rows fulfil it and what share that is."""
    n = F.count(F.lit(1))
    cols = [x for name, c in conditions.items() for x in (F.count_if(c).alias(f"n_{name}"), F.try_divide(F.count_if(c).cast("double"), n).alias(f"share_{name}"))]
    return df.agg(n.alias("n"), *cols)


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
