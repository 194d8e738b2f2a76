"""Splitting packed fields into one row per value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.cells import CellGrammar

ITEMS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("malformed", T.BooleanType()),
]))


def split_cells(df: DataFrame, column: str, known: list[str], keep: list[str]) -> DataFrame:
    """One row per value of df[column]: the columns `keep`, item_no (from 1), label, start, kind, malformed.

    Null, empty and placeholder cells give no rows; repeated values give a row each; cells
    of any length are read whole. Null cells never reach Python. `known` is the short list
    of usual values, as written when unquoted.
    """
    grammar = CellGrammar(known)

    @F.pandas_udf(ITEMS)
    def parse(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: [i._asdict() for i in grammar.parse(c)])

    packed = df.where(F.col(column).isNotNull()).select(*keep, parse(F.col(column)).alias("_items"))
    return packed.select(*keep, F.posexplode("_items").alias("_at", "_item")).select(*keep, (F.col("_at") + 1).alias("item_no"), "_item.*")


def label_items(annotated: DataFrame, sheet: DataFrame, label_classes: DataFrame) -> DataFrame:
    """table_name, row_id, item_no, label, start, kind, malformed of the label cells of both tables."""
    known = [r[0] for r in label_classes.select("label").where("label is not null").distinct().collect()]  # a fixed table of label classes
    both = annotated.select(F.lit("annotated_transcripts").alias("table_name"), "row_id", "labels").unionByName(
        sheet.select(F.lit("grammaticality_sheet").alias("table_name"), "row_id", "labels"))
    return split_cells(both, "labels", known, ["table_name", "row_id"])


def label_items_found(annotated: DataFrame, sheet: DataFrame, label_classes: DataFrame) -> DataFrame:
    """table_name, row_id, item_no, label."""
    return label_items(annotated, sheet, label_classes).select("table_name", "row_id", "item_no", "label")
