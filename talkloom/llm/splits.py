"""Splits that keep related records together: components, then balanced bins, then splits."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import drop_stage, stage
from . import speech

#: Components that one task balances at a time, about.
SHARD = 2000


def components(edges: DataFrame) -> DataFrame:
    """node, component of an undirected graph given as edges (a, b); component is its least node.

    Alternates large-star and small-star steps, which shrink any graph to stars in
    O(log^2 n) rounds: each node points its larger (then its smaller) neighbours to the
    least of them. Rounds are written to shared storage and end when nothing changes. Hubs
    are safe: the least neighbour is a partially aggregated minimum, and its way back to
    the edges is a join that adaptive execution can split. Edges with a null end and loops
    are ignored; nodes without edges do not appear.
    """
    e = stage(edges.select("a", "b").where("a != b").distinct())
    sign = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = None
    while (now := sign(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        small = small.join(least, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        old, e = e, stage(new)
        drop_stage(old)
    stars = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def transcript_groups(transcripts: DataFrame, utterances: DataFrame, children: DataFrame) -> DataFrame:
    """transcript_file, group_name of every transcript of transcripts; group_name is null where neither header nor rows name a child.

    Children are related if a transcript names both. Spellings are resolved by the
    children table; a name that it does not hold stands for itself. Rows without child or
    transcript tell nothing. Rows are made distinct as written before spellings are
    resolved, so that the large table is reduced in the scan.
    """
    named = lambda df: df.select("transcript_file", "child_name", "corpus").where("child_name is not null").distinct()
    pairs = named(utterances).unionByName(named(transcripts))
    pairs = pairs.select(speech.transcript_key(F.col("transcript_file")).alias("key"), speech.child_key(F.col("child_name"), F.col("corpus")).alias("child_key")).where("key is not null and child_key is not null").distinct()
    right = children.where("child_name is not null").groupBy(speech.child_key(F.col("child_name"), F.col("corpus")).alias("child_key")).agg(F.min("child_name").alias("child"))
    pairs = stage(pairs.join(right, "child_key", "left").select("key", F.coalesce("child", "child_key").alias("child")).distinct())
    hubs = pairs.groupBy("key").agg(F.min("child").alias("hub"))
    edges = pairs.join(hubs, "key").where("child != hub").select(F.col("child").alias("a"), F.col("hub").alias("b"))
    found = components(edges).withColumnRenamed("node", "hub")
    heads = transcripts.select("transcript_file", speech.transcript_key(F.col("transcript_file")).alias("key")).where("transcript_file is not null")
    grouped = heads.join(hubs, "key", "left").join(found, "hub", "left")
    return grouped.select("transcript_file", F.coalesce("component", "hub").alias("group_name"))


def largest_differencing(weights: list[float], bins: int) -> list[int]:
    """The bin of each weight by Karmarkar and Karp's differencing in `bins` ways.

    Each weight begins as a partition of its own; the two with the widest spread are
    merged again and again, the heaviest part of one with the lightest of the other.
    """
    heap = []
    for i, w in enumerate(weights):
        parts = [(0.0, [])] * (bins - 1) + [(float(w), [i])]
        heapq.heappush(heap, (-float(w), i, parts))
    while len(heap) > 1:
        _, i, p = heapq.heappop(heap)
        _, _, q = heapq.heappop(heap)
        parts = sorted(((a[0] + b[0], a[1] + b[1]) for a, b in zip(p, reversed(q))), key=lambda x: x[0])
        least = parts[0][0]
        parts = [(w - least, items) for w, items in parts]
        heapq.heappush(heap, (-parts[-1][0], i, parts))
    out = [0] * len(weights)
    if heap:
        for b, (_, items) in enumerate(heap[0][2]):
            for i in items:
                out[i] = b
    return out


def balance(groups: DataFrame, bins: int, shard: int = SHARD) -> DataFrame:
    """group_name, bin of groups (group_name, weight): differencing in shards, then of the shards' bins, until one shard is left.

    A task gets about `shard` items however many groups there are.
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
        pdf["bin"] = largest_differencing(pdf["weight"].tolist(), bins)
        return pdf[["item", "shard", "bin", "weight"]]

    schema = "item string, shard long, bin int, weight double"
    items = groups.select(F.col("group_name").alias("item"), F.col("weight").cast("double").alias("weight"))
    n, placed = items.count(), None
    while True:
        shards = max(1, math.ceil(n / shard))
        packed = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards))).groupBy("shard").applyInPandas(pack, schema)
        packed = stage(packed.withColumn("to", F.concat_ws("/", "shard", "bin")))
        step = packed.select("item", "to", "bin")
        placed = step.withColumnRenamed("item", "group_name") if placed is None else placed.select("group_name", F.col("to").alias("item")).join(step, "item").select("group_name", "to", "bin")
        if shards == 1:
            return placed.select("group_name", "bin")
        items = packed.groupBy(F.col("to").alias("item")).agg(F.sum("weight").alias("weight"))
        n = min(n - 1, shards * bins) if shards * bins >= n else shards * bins


def split_transcripts(transcripts: DataFrame, utterances: DataFrame, children: DataFrame, shares: dict[str, float] | None = None, bins: int = 200) -> DataFrame:
    """transcript_file, group_name, split: related transcripts together, the splits near their shares of transcripts.

    Components are balanced into `bins` bins by differencing; whole bins, heaviest first,
    go to the split that lacks most. A component heavier than a split's share cannot be
    parted, so the split that takes it may exceed its share; ties go by name. Transcripts
    that name no child are groups of their own.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    grouped = transcript_groups(transcripts, utterances, children)
    grouped = stage(grouped.withColumn("group_name", F.coalesce("group_name", F.concat(F.lit("transcript "), "transcript_file"))))
    binned = stage(balance(grouped.groupBy("group_name").agg(F.count(F.lit(1)).alias("weight")), bins))
    loads = grouped.join(binned, "group_name").groupBy("bin").count().collect()  # `bins` rows
    total, taken, where = sum(r["count"] for r in loads), dict.fromkeys(shares, 0), {}
    for r in sorted(loads, key=lambda r: (-r["count"], r["bin"])):
        lacks = max(shares, key=lambda s: (shares[s] * total - taken[s], s))
        taken[lacks] += r["count"]
        where[r["bin"]] = lacks
    split = F.element_at(F.create_map(*[F.lit(x) for kv in where.items() for x in kv]), F.col("bin")) if where else F.lit(None).cast("string")
    return grouped.join(binned, "group_name").select("transcript_file", "group_name", split.alias("split"))
