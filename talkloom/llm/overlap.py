"""Same or near-same records across splits, by code blocks of a similarity hash.

A record's words (each tagged with its field and, where a word recurs, with its turn) are
hashed to bit places. Its fingerprint tells which bits are set; two records within RADIUS
word edits differ in at most RADIUS set bits on either side. The bits are put in one fixed
order, rarest first, and the code of a record has one block for each of its first BLOCKS
set bits. The BLOCKS - RADIUS first bits that two such records share are among the blocks
of both: joining on every choice of BLOCKS - RADIUS blocks finds every such pair. In the
fingerprint folded to 64 bits, in which each word flips one bit, they differ in at most
2 * RADIUS bits. What passes both is verified by the exact word edit distance.

Blocks of equal width of the folded fingerprint would not do: of a record of eight words
two of six such blocks are often empty, and all of those would meet. BLOCKS is chosen by
measure (README): more blocks make more keys, fewer make more candidates.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.tables import spread, stage
from .speech import only

RADIUS = 2
BLOCKS = 5
#: Records with fewer words take no part.
LEAST_WORDS = 8
#: Words are counted in so many hash buckets; the bucket's count stands for the word's rarity.
#: Any order of words gives the same result; a good one gives fewer candidates. 2**16 longs at most reach the driver.
RARITY_BUCKETS = 1 << 16


APOSTROPHES = "'’‘ʼ＇`´"


def plain_words(c: Column) -> Column:
    """Lower-case runs of letters and digits after dropping apostrophes, parted by blanks; empty for null."""
    t = F.translate(F.lower(F.coalesce(c, F.lit(""))), APOSTROPHES, "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def words_of(c: Column | str) -> Column:
    """The words of plain_words as an array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """The fewest words to insert, delete or replace; most + 1 where it is more than `most`."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i if i <= most else far] + [far] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        if min(new) > most:
            return far
        row = new
    return row[-1]


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _told_apart(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes sorted by row, in which the second, third ... copy of a word in a row gets a hash of its own."""
    order = np.lexsort((words, rows))
    rows, h = rows[order], words[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    place = np.arange(len(h))
    turn = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return rows, np.where(turn > 0, _mix(h + turn), h)


CODES = T.StructType([T.StructField("print", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def codes_udf(rarity: np.ndarray):
    """A Column function from the hashes of a record's words to its fingerprint and block keys."""
    kept = list(combinations(range(BLOCKS), BLOCKS - RADIUS))

    @F.pandas_udf(CODES)
    def codes(words: pd.Series) -> pd.DataFrame:
        n = len(words)
        keys, prints = np.zeros((n, len(kept)), np.uint64), np.zeros(n, np.uint64)
        if n:
            rows, h = _told_apart(np.repeat(np.arange(n), words.map(len).to_numpy()), np.concatenate(words.to_numpy()).astype(np.int64).view(np.uint64))
            begins = np.searchsorted(rows, np.arange(n))
            prints = np.bitwise_xor.reduceat(np.uint64(1) << (_mix(h) >> np.uint64(58)), begins)
            ranked = h[np.lexsort((h, rarity[h & np.uint64(RARITY_BUCKETS - 1)], rows))]
            blocks = ranked[begins[:, None] + np.arange(BLOCKS)]
            for k, choice in enumerate(kept):
                for b in choice:
                    keys[:, k] = _mix(keys[:, k] ^ blocks[:, b]) + np.uint64(1)
        return pd.DataFrame({"print": prints.view(np.int64), "keys": list(keys.view(np.int64))})

    return codes


def near_classes(records: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records (row_id, side in 'train', 'held', first, second).

    members: class_id, row_id, side; a class holds the records of exactly the same words.
    links: train_class, held_class, distance (0, 1 or 2) of every pair of classes, one with
    train and one with held members, within RADIUS word edits in both fields together.
    Records with fewer than `least_words` words are left out; least_words must be BLOCKS or more.
    """
    if least_words < BLOCKS:
        raise ValueError(f"least_words must be at least {BLOCKS}: shorter records have too few blocks")
    count = lambda c: F.size(words_of(c))
    r = spread(records).select("row_id", "side", plain_words(F.col("first")).alias("a"), plain_words(F.col("second")).alias("b"))
    r = only(r.withColumn("n", count("a") + count("b")), F.col("n") >= least_words)
    r = stage(r.withColumn("text_id", F.unhex(F.md5(F.concat("a", F.lit("\n"), "b")))))
    classes = r.groupBy("text_id").agg(F.min("row_id").alias("class_id"), F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") == "held").alias("held"), F.any_value("n").alias("n"), F.any_value("a").alias("a"), F.any_value("b").alias("b"))
    classes = stage(classes)
    hashed = lambda field, c: F.transform(words_of(c), lambda w: F.xxhash64(F.lit(field), w))
    words = F.concat(hashed(0, "a"), hashed(1, "b"))
    rarity = np.zeros(RARITY_BUCKETS, np.int64)
    bucket = F.expr(f"w & {RARITY_BUCKETS - 1}")
    for k, n in classes.select(F.explode(words).alias("w")).groupBy(bucket.alias("k")).count().collect():
        rarity[k] = n
    coded = classes.select("class_id", "train", "held", "n", codes_udf(rarity)(words).alias("c"))
    keyed = coded.select("class_id", "train", "held", "n", F.col("c.print").alias("print"), F.explode("c.keys").alias("key"))
    side = lambda s: keyed.where(s).select("key", F.col("class_id").alias(f"{s}_class"), F.col("print").alias(f"{s}_print"), F.col("n").alias(f"{s}_n"))
    near = side("train").join(side("held"), "key").where((F.bit_count(F.expr("train_print ^ held_print")) <= 2 * RADIUS) & (F.abs(F.col("train_n") - F.col("held_n")) <= RADIUS))
    near = near.where("train_class != held_class").select("train_class", "held_class").distinct()
    texts = lambda s: classes.select(F.col("class_id").alias(f"{s}_class"), F.col("a").alias(f"{s}_a"), F.col("b").alias(f"{s}_b"))

    @F.pandas_udf("int")
    def distance(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series) -> pd.Series:
        out = []
        for p, q, x, y in zip(a1, a2, b1, b2):
            d = word_distance(p.split(), q.split(), RADIUS)
            out.append(d + word_distance(x.split(), y.split(), RADIUS - d) if d <= RADIUS else d)
        return pd.Series(out, dtype="int32")

    near = near.join(texts("train"), "train_class").join(texts("held"), "held_class").withColumn("distance", distance("train_a", "held_a", "train_b", "held_b"))
    links = near.where(F.col("distance") <= RADIUS).select("train_class", "held_class", "distance")
    same = classes.where("train and held").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("held_class"), F.lit(0).alias("distance"))
    members = r.select("text_id", "row_id", "side").join(classes.select("text_id", "class_id"), "text_id").select("class_id", "row_id", "side")
    return links.unionByName(same), members


def _records(sheet: DataFrame) -> DataFrame:
    side = F.when(F.col("split") == "train", "train").when(F.col("split").isin("val", "test"), "held")
    return sheet.select("row_id", side.alias("side"), F.col("prev_transcript_clean").alias("first"), F.col("transcript_clean").alias("second")).where("side is not null and row_id is not null")


def overlap_pairs(sheet: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row_id_a, row_id_b (a < b), distance: every train record with every val or test record within RADIUS word edits.

    Null texts count as empty; rows without split or row_id take no part; other columns are
    ignored. The expansion of exact copies into pairs happens last, in a join on class ids.
    """
    links, members = near_classes(_records(sheet), least_words)
    of = lambda s: members.where(F.col("side") == s).select(F.col("class_id").alias(f"{s}_class"), F.col("row_id").alias(f"{s}_row"))
    pairs = links.join(of("train"), "train_class").join(of("held"), "held_class")
    return pairs.select(F.least("train_row", "held_row").alias("row_id_a"), F.greatest("train_row", "held_row").alias("row_id_b"), "distance")


def overlap_found(sheet: DataFrame) -> DataFrame:
    """row_id_a, row_id_b."""
    return overlap_pairs(sheet).select("row_id_a", "row_id_b")


def overlap_report(sheet: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """split, source, n_rows, n_overlapping, n_exact, n_pairs of the val and test records (null source as 'unknown').

    Counts follow from class sizes; pairs are not expanded.
    """
    links, members = near_classes(_records(sheet), least_words)
    trains = members.where(F.col("side") == "train").groupBy(F.col("class_id").alias("train_class")).agg(F.count(F.lit(1)).alias("n"))
    held = links.join(trains, "train_class").groupBy(F.col("held_class").alias("class_id")).agg(F.sum("n").alias("pairs"), F.max(F.col("distance") == 0).alias("exact"))
    found = members.where(F.col("side") == "held").join(held, "class_id").select("row_id", "pairs", "exact")
    rows = sheet.where(F.col("split").isin("val", "test")).select("row_id", "split", F.coalesce("source", F.lit("unknown")).alias("source"))
    return rows.join(found, "row_id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("pairs").alias("n_overlapping"), F.count_if("exact").alias("n_exact"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
