"""Samples, splits and balanced sets. All draws go by the hash of a key and a seed, so that they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def draw(key: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) by md5 of key and seed, the same in any engine (48 bits)."""
    c = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(c.cast("string"), F.lit(f"/{seed}")))
    return F.conv(F.left(digest, F.lit(12)), 16, 10).cast("double") / float(1 << 48)


def sample_rows(df: DataFrame, n: int, key: str = "row_id", seed: int = 0) -> DataFrame:
    """n rows at random; all if there are fewer. Each task keeps its n best."""
    return df.withColumn("_u", draw(key, seed)).orderBy("_u", key).limit(n).drop("_u")


def split_by_share(df: DataFrame, shares: dict[str, float], key: str = "row_id", seed: int = 0) -> DataFrame:
    """Adds split: disjoint and near the shares, by key (rows of one key stay together; null keys go to the last split)."""
    u, c, low = draw(key, seed), None, 0.0
    names = list(shares)
    for name in names[:-1]:
        low += shares[name] / sum(shares.values())
        c = F.when(u < low, name) if c is None else c.when(u < low, name)
    return df.withColumn("split", c.otherwise(names[-1]) if c is not None else F.lit(names[-1]))


def balanced(df: DataFrame, label: str, key: str = "row_id", seed: int = 0) -> DataFrame:
    """As many rows at random of each label as the rarest has; rows without label are dropped.

    A hot label is not ranked in one task: rows are ranked within salts of the draw, and
    the draw's n-th smallest value is found from counts of 4096 equal steps, so that only
    the step in which it falls is sorted.
    """
    steps = 4096
    d = df.where(F.col(label).isNotNull()).withColumn("_u", draw(key, seed)).withColumn("_s", F.floor(F.col("_u") * steps))
    counts = d.groupBy(label, "_s").agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(label).orderBy("_s")))
    least = counts.groupBy(label).agg(F.sum("_n").alias("_all")).agg(F.min("_all").alias("_least"))
    places = upto.crossJoin(F.broadcast(least)).select(F.col(label).alias("_l"), F.col("_s").alias("_step"), (F.col("_least") - (F.col("_upto") - F.col("_n"))).alias("_room")).where("_room > 0")  # one row
    d = d.join(places, (F.col(label) == F.col("_l")) & (F.col("_s") == F.col("_step")))
    rank = F.row_number().over(Window.partitionBy(label, "_s").orderBy("_u", key))
    return d.withColumn("_r", rank).where("_r <= _room").drop("_u", "_s", "_l", "_step", "_room", "_r")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: weight_false (the share of true rows) and weight_true (the share of false rows), so that classes weigh the same."""
    p = F.avg(F.col(label).cast("double"))
    return df.agg(p.alias("weight_false"), (1 - p).alias("weight_true"))


def annotation_sheet(df: DataFrame, n_child_rows: int = 50, ignore: int = 0, seed: int = 0, caregivers: list[str] | None = None) -> DataFrame:
    """Rows to annotate by hand: of each corpus a transcript at random among those with n_child_rows child rows after the first `ignore` rows, cut at that child row.

    Adds utterance (text led by [CHI], [CAR] or [OTH]) and empty is_grammatical, labels, note.
    """
    from ..functions.chat import CAREGIVERS
    from ..functions.words import special_token

    w = Window.partitionBy("transcript_file").orderBy("row_id")
    child = F.coalesce(F.col("speaker_code") == "CHI", F.lit(False)).cast("int")
    d = df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") > ignore)
    d = d.withColumns({"_all": F.sum(child).over(Window.partitionBy("transcript_file")), "_before": F.sum(child).over(w) - child})
    d = d.where((F.col("_all") >= n_child_rows) & (F.col("_before") < n_child_rows))
    best = d.groupBy("corpus").agg(F.min(F.struct(draw("transcript_file", seed).alias("u"), F.col("transcript_file").alias("t"))).alias("_b")).select(F.col("_b.t").alias("transcript_file"))
    d = d.join(best, "transcript_file", "left_semi")
    text = F.concat_ws(" ", special_token(F.col("speaker_code"), caregivers or CAREGIVERS), F.col("transcript_clean"))
    none = F.lit(None).cast("string")
    return d.select("row_id", "corpus", "transcript_file", text.alias("utterance"), none.alias("is_grammatical"), none.alias("labels"), none.alias("note"))
