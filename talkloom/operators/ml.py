"""Classifiers on ratios and n-grams, regressions, and the hook for outside models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, NGram, RFormula, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.words import num_unique_words
from .sampling import class_weights


def fit_ratio_classifier(df: DataFrame, first: str, second: str, label: str) -> tuple[float, float, float]:
    """(weight, weight, intercept) of a balanced logistic regression on two columns, to be used as a plain expression (responses.linear_decision)."""
    d = df.select(first, second, F.col(label).cast("double").alias("label")).dropna()
    n, n1 = d.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not n1 or n1 == n:
        return 0.0, 0.0, -1.0 if not n1 else 1.0
    d = d.withColumn("weight", F.when(F.col("label") == 1, n / (2 * n1)).otherwise(n / (2 * (n - n1))))
    model = LogisticRegression(weightCol="weight", regParam=1.0 / n, standardization=False).fit(VectorAssembler(inputCols=[first, second], outputCol="features").transform(d))
    return (*map(float, model.coefficients), float(model.intercept))


def save_weights(weights: dict[str, tuple[float, ...]], path: str, spark: SparkSession) -> None:
    """Writes named weights as a small table of JSON, readable by load_weights."""
    spark.createDataFrame([(k, list(map(float, v))) for k, v in sorted(weights.items())], "name string, weights array<double>").coalesce(1).write.mode("overwrite").json(path)


def load_weights(path: str, spark: SparkSession) -> dict[str, tuple[float, ...]]:
    """What save_weights wrote."""
    return {r["name"]: tuple(r["weights"]) for r in spark.read.schema("name string, weights array<double>").json(path).collect()}


def ngram_forest(train: DataFrame, text: str, label: str, per_order: int = 100, trees: int = 100, seed: int = 0):
    """A random forest on counts of the per_order most frequent words, pairs and triples of words; classes weigh the same. Gives a fitted pipeline that expects columns `tokens`, label, weight."""
    stages = []
    for n in (1, 2, 3):
        stages += [NGram(n=n, inputCol="tokens", outputCol=f"n{n}"), CountVectorizer(vocabSize=per_order, inputCol=f"n{n}", outputCol=f"c{n}")]
    stages += [VectorAssembler(inputCols=["c1", "c2", "c3"], outputCol="features"), RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, seed=seed)]
    return Pipeline(stages=stages).fit(with_ngram_inputs(train, text, label))


def with_ngram_inputs(df: DataFrame, text: str, label: str) -> DataFrame:
    """Adds tokens, label (0.0 or 1.0) and weight; rows with a null text or label are dropped."""
    d = df.dropna(subset=[text, label]).withColumns({"label": F.col(label).cast("double"), "tokens": F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")})
    w = class_weights(d, "label")
    return d.crossJoin(F.broadcast(w)).withColumn("weight", F.when(F.col("label") == 1, F.col("weight_true")).otherwise(F.col("weight_false"))).drop("weight_true", "weight_false")  # one row


def logistic_curve(df: DataFrame, x: str, share: str) -> DataFrame:
    """term, coefficient, std_error of a binomial regression of a share on x."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(share).cast("double").alias("y")).dropna()
    m = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(d))
    errors = [float(v) for v in m.summary.coefficientStandardErrors]
    return df.sparkSession.createDataFrame([("x", float(m.coefficients[0]), errors[0]), ("intercept", float(m.intercept), errors[1])], "term string, coefficient double, std_error double")


def fixed_effects(df: DataFrame, formula: str, group: str | None = None) -> DataFrame:
    """term, coefficient of a logistic regression by formula ("y ~ a * b").

    group: adds a dummy per group's value in place of a random intercept, which Spark does
    not have; meant for groupings of some hundreds of values.
    """
    if group:
        formula += f" + {group}"
    rf = RFormula(formula=formula).fit(df)
    d = rf.transform(df)
    m = LogisticRegression(regParam=1e-8, maxIter=100).fit(d)
    meta = d.schema["features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for kind in meta.values() for a in kind), key=lambda a: a["idx"])]
    rows = [("intercept", float(m.intercept))] + [(n, float(c)) for n, c in zip(names, m.coefficients)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def score_with(df: DataFrame, name: str, model: Callable[[list[str], list[str]], list[bool]], text: str = "transcript_clean", before: str = "prev_transcript_clean", invert: bool = False) -> DataFrame:
    """Adds is_grammatical_<name> by an outside model: a function of the texts before and the texts of a batch.

    Only rows with more than one different word and a known text before are scored; others
    are null. invert: the model's answer is turned round. A column that is there already stays.
    """
    column = f"is_grammatical_{name}"
    if column in df.columns:
        return df

    @F.pandas_udf("boolean")
    def score(prev: pd.Series, cur: pd.Series, wanted: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(cur), dtype=object)
        rows = [i for i, w in enumerate(wanted) if w]
        if rows:
            for i, y in zip(rows, model([prev[i] for i in rows], [cur[i] for i in rows])):
                out[i] = bool(y) != invert
        return out

    wanted = F.coalesce((num_unique_words(F.col(text)) > 1) & F.col(before).isNotNull(), F.lit(False))
    return df.withColumn(column, score(before, text, wanted))


def with_correctness(df: DataFrame, names: list[str], truth: str = "is_grammatical") -> DataFrame:
    """Adds <name>_is_correct per model; null where either is unknown."""
    return df.withColumns({f"{n}_is_correct": F.col(f"is_grammatical_{n}") == F.col(truth) for n in names})


def mistakes(df: DataFrame, predicted: str, truth: str, correct: bool = False) -> DataFrame:
    """The rows that a model gets wrong (or right)."""
    same = F.col(predicted) == F.col(truth)
    return df.where(same if correct else ~same)


def model_input(text: Column, before: Column, separator: str = "[SEP]", end: str | None = None) -> Column:
    """The text before, the separator and the text, and an end mark if given, as one line."""
    return F.concat(F.coalesce(before, F.lit("")), F.lit(separator), text, *([F.lit(end)] if end else []))
