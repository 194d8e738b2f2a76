"""Mixing sources to target weights, measured in tokens."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.tables import spread, stage
from .tokenizer import Encoder

#: Labelled documents that the domain classifier is fitted on, at most, and the hash buckets of its token counts.
MOST_LABELLED = 4000
BUCKETS = 512
#: Posteriors are told in at most so many parts, and documents so fall into at most so many cells; rates of documents of one source are told in so many steps.
PARTS, MOST_CELLS, STEPS = 8, 50_000, 1024


def parts_for(sources: int) -> int:
    """The most parts, up to PARTS, by which documents fall into MOST_CELLS cells at most."""
    return max([p for p in range(1, PARTS + 1) if math.comb(p + sources - 1, p) <= MOST_CELLS], default=1) if sources else PARTS


def _features(ids: list[list[int]]) -> np.ndarray:
    """Log counts of hashed token ids, of length one."""
    x = np.zeros((len(ids), BUCKETS), np.float32)
    for i, doc in enumerate(ids):
        if doc:
            h = (np.asarray(doc, np.int64) * 2654435761 % (1 << 32)) * BUCKETS >> 32
            x[i] = np.bincount(h, minlength=BUCKETS)
    x = np.log1p(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights (features + 1 by classes) of a softmax regression, by gradient descent with momentum."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = np.zeros((x.shape[1], classes), np.float32)  # of the inputs' type: others would be cast anew in each round
    if not len(x):
        return w
    v, t = np.zeros_like(w), np.eye(classes, dtype=np.float32)[y]
    for _ in range(rounds):
        v = np.float32(0.9) * v - np.float32(rate * 0.1) * (x.T @ (_softmax(x @ w) - t) / np.float32(len(x)) + np.float32(ridge) * w)
        w = w + v
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def in_parts(p: np.ndarray, parts: int) -> np.ndarray:
    """Shares (rows that sum to 1) as whole numbers of parts, by largest remainders; ties go to the first."""
    x = p * parts
    whole = np.floor(x + 1e-9).astype(int)
    order = np.argsort(-(x - whole), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(p.shape[1])[None, :].repeat(len(p), 0), 1)
    return whole + (rank < (parts - whole.sum(1))[:, None])


def labelled_sample(documents: DataFrame, sources: list[str], most: int = MOST_LABELLED) -> DataFrame:
    """At most `most` labelled documents with text, those of the smallest hashes, with like quotas of all sources: source, text."""
    there = documents.where(F.col("source").isin(sources) & (F.length("text") > 0))
    counts = {r["source"]: r["count"] for r in there.groupBy("source").count().collect()}  # a row per source
    if not counts:
        return there.select("source", "text").limit(0)
    quota = most / len(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30))
    share = F.create_map(*[x for s, n in sorted(counts.items()) for x in (F.lit(s), F.lit(int(min(1.0, 1.5 * quota / n) * (1 << 30))))])
    drawn = there.where(draw < share[F.col("source")]).select("source", "text", (draw / share[F.col("source")]).alias("u"), "doc_id")
    return drawn.orderBy("u", "doc_id", "text").limit(most).select("source", "text")


def memberships(documents: DataFrame, sources: list[str], tokenizer_path: str | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, source, n_tokens, member of every document; member has the parts (of parts_for) in which it belongs to each of `sources`.

    A document of a known source belongs to it alone (to none where `sources` lacks it).
    One without source belongs to all as a classifier of its tokens tells, which is fitted
    on labelled_sample.
    """
    spark = documents.sparkSession
    encoder, k = Encoder(spark, tokenizer_path), len(sources)
    parts = parts_for(k)
    place = {s: i for i, s in enumerate(sources)}

    @F.pandas_udf(T.BinaryType())
    def features(texts: pd.Series) -> pd.Series:
        encode = encoder.automaton().encode
        return pd.Series([x.tobytes() for x in _features([encode(t) for t in texts])])

    sample = labelled_sample(documents, sources, most_labelled).repartition(spark.sparkContext.defaultParallelism).select("source", features("text").alias("x")).collect()
    sample.sort(key=lambda r: (r["source"], bytes(r["x"])))  # sums of floats come out the same in any order of arrival
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.float32).reshape(-1, BUCKETS)
    y = np.array([place[r["source"]] for r in sample], int)
    fitted = fit_softmax(x, y, k)
    fitted[-1, np.bincount(y, minlength=k) == 0] = -1e9  # a source without labelled documents has no members among the others
    weights = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("member", T.ArrayType(T.IntegerType()))]))
    def measure(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        encode = encoder.automaton().encode
        ids = [encode(t) for t in texts]
        member = np.zeros((len(ids), k), int)
        unknown = known.isna().to_numpy()
        for i, s in enumerate(known):
            if not unknown[i] and s in place:
                member[i, place[s]] = parts
        if k and unknown.any():
            f = _features([d for d, u in zip(ids, unknown) if u])
            member[unknown] = in_parts(_softmax(np.concatenate([f, np.ones((len(f), 1))], 1) @ weights.value), parts)
        return pd.DataFrame({"n": [len(d) for d in ids], "member": list(member)})

    return spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", measure("text", "source").alias("m")).select("doc_id", "source", F.col("m.n").alias("n_tokens"), "m.member")


def _uniform():
    """A number in [0, 1) by the hash of doc_id."""
    return F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))


class Cells:
    """The documents' tokens by membership: cells of documents that belong alike, of which there is a bounded number.

    member (cells by sources, rows sum to 1 or 0), tokens per cell, and tokens per cell and
    step of the draw that rounds rates to whole copies.
    """

    def __init__(self, member: np.ndarray, steps: np.ndarray, caps: np.ndarray):
        self.member, self.steps, self.tokens = member, steps, steps.sum(1)
        #: How often documents may be used: as their likeliest source allows, not at all if they belong to none.
        self.cap = np.where(member.sum(1) > 0, caps[member.argmax(1)], 0.0) if len(caps) else np.zeros(len(member))

    @classmethod
    def count(cls, measured: DataFrame, caps: np.ndarray) -> "Cells":
        """One pass over measured; what reaches the driver is a row per cell and step that occur (for mixed cells, which are rounded by expectation, one row)."""
        k = len(caps)
        pure = F.array_max("member") >= parts_for(k)
        step = F.when(pure, F.floor(_uniform() * STEPS)).otherwise(0)
        rows = measured.groupBy("member", step.alias("step")).agg(F.sum("n_tokens").alias("n")).collect() if k else []
        keys = sorted({tuple(r["member"]) for r in rows})
        at = {c: i for i, c in enumerate(keys)}
        steps = np.zeros((len(keys), STEPS))
        for r in rows:
            steps[at[tuple(r["member"])], r["step"]] += r["n"] or 0
        return cls(np.array(keys, float).reshape(len(keys), k) / parts_for(k), steps, caps)

    @property
    def pure(self) -> np.ndarray:
        return self.member.max(1, initial=0) >= 1

    def copied(self, rates: np.ndarray) -> np.ndarray:
        """Tokens of each cell when its documents' rates are rounded to whole copies: exactly for cells of one source, by expectation for mixed ones."""
        low = np.floor(rates)
        first = STEPS - np.rint((rates - low) * STEPS).astype(int)
        upper = np.array([s[f:].sum() for s, f in zip(self.steps, first)])
        return np.where(self.pure, low * self.tokens + upper, rates * self.tokens)


def fit_rates(cells: Cells, shares: np.ndarray, caps: np.ndarray, total: float | None = None, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Rates of the cells' documents that bring the expected tokens of each source nearest to shares * total by least squares, within 0 and the caps; and total.

    Projected gradient descent over the cells, with steps scaled by the sources' tokens, so
    that descent is as fast for small sources as for large ones. The rates of cells of one
    source are then rounded to STEPS, each to the step whose whole copies come nearest.

    total: the mixture's size in tokens; by default the largest at which every source that
    occurs can have its share within its cap.
    """
    m, n = cells.member, cells.tokens[:, None]
    there, most = (n * m).sum(0), (n * m * cells.cap[:, None]).sum(0)
    occurs = (there > 0) & (shares > 0) & (caps > 0)
    wanted = np.where(occurs, shares, 0.0)
    wanted = wanted / wanted.sum() if wanted.sum() else wanted
    if total is None:
        total = float(np.min(most[occurs] / wanted[occurs])) if occurs.any() else 0.0
    scale = np.where(occurs, there, 1.0)
    rates = np.clip(m @ np.where(occurs, wanted * total / scale, 0.0), 0, cells.cap)
    for _ in range(rounds):
        off = ((n * m * rates[:, None]).sum(0) - wanted * total) * occurs
        if np.abs(off).max(initial=0) <= 1e-6 * max(total, 1.0):
            break
        rates = np.clip(rates - m @ (off / scale), 0, cells.cap)
    for c in np.nonzero(cells.pure)[0]:
        j = int(m[c].argmax())
        if occurs[j] and cells.tokens[c]:
            others = (n[:, 0] * m[:, j] * rates).sum() - cells.tokens[c] * rates[c]
            aim = np.clip(wanted[j] * total - others, 0, cells.cap[c] * cells.tokens[c])
            low = min(np.floor(aim / cells.tokens[c]), cells.cap[c])
            upper = np.concatenate([[0.0], np.cumsum(cells.steps[c][::-1])])
            f = int(np.abs(low * cells.tokens[c] + upper - aim).argmin())
            rates[c] = min(low + f / STEPS, cells.cap[c])
        else:
            rates[c] = 0.0
    return rates, total


def _fit(documents: DataFrame, mix_targets: DataFrame, total: float | None, tokenizer_path: str | None):
    targets = sorted((r["source"], float(r["target_share"] or 0), max(0, r["max_repeats"] or 0)) for r in mix_targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect())  # a fixed table
    sources, caps = [t[0] for t in targets], np.array([t[2] for t in targets], float)
    measured = stage(memberships(documents, sources, tokenizer_path))
    cells = Cells.count(measured, caps)
    rates, total = fit_rates(cells, np.array([t[1] for t in targets]), caps, total)
    keys = np.rint(cells.member * parts_for(len(caps))).astype(int).tolist()
    of_cell = documents.sparkSession.createDataFrame([(k, float(r), int(c)) for k, r, c in zip(keys, rates, cells.cap)], "member array<int>, rate double, cap int")
    rated = measured.join(F.broadcast(of_cell) if len(keys) <= MOST_CELLS else of_cell, "member", "left")
    rate = F.coalesce("rate", F.lit(0.0))
    copies = F.least(F.floor(rate + _uniform()), F.coalesce("cap", F.lit(0))).cast("int")
    mixed = rated.select("doc_id", "source", "n_tokens", "member", rate.alias("rate"), copies.alias("copies"))
    return targets, mixed, total


def mix(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate, copies: how often each document is used in the mixture.

    copies is 0 for documents left out, for empty and null texts' sources alike by their
    rate, and for sources without target. No document is used more often than
    max_repeats of its source (of the likeliest one where source is null).
    """
    return _fit(documents, mix_targets, total, tokenizer_path)[1].drop("member")


def mix_report(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Per source of mix_targets: source, target_share, max_repeats, available_tokens, n_documents, n_copies, mixed_tokens, actual_share, expected_tokens, expected_share.

    actual_* count documents by their recorded source (null as 'unknown', with a row of its own), expected_* by membership.
    """
    targets, mixed, _ = _fit(documents, mix_targets, total, tokenizer_path)
    spark = documents.sparkSession
    actual = mixed.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    by_cell = mixed.groupBy("member").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"))
    expected = by_cell.select(F.posexplode("member").alias("i", "m"), "t").groupBy("i").agg((F.sum(F.col("m") * F.col("t")) / parts_for(len(targets))).alias("expected_tokens"))
    names = spark.createDataFrame([(i, *t) for i, t in enumerate(targets)], "i int, source string, target_share double, max_repeats int")
    out = names.join(expected, "i", "left").join(actual, "source", "full")
    sums = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.crossJoin(F.broadcast(sums)).select(  # one row of sums
        "source", "target_share", "max_repeats", *[zero(c).alias(c) for c in ("available_tokens", "n_documents", "n_copies", "mixed_tokens")],
        F.coalesce(F.try_divide(zero("mixed_tokens"), "all"), F.lit(0.0)).alias("actual_share"),
        zero("expected_tokens").alias("expected_tokens"), F.coalesce(F.try_divide(zero("expected_tokens"), "all"), F.lit(0.0)).alias("expected_share"))
