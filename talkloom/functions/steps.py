"""Long expressions as named steps, so that none is worked out twice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def steps(df: DataFrame, pairs: Iterable[tuple[str, Column]]) -> DataFrame:
    """df with the columns added one after the other (a name may come again); those whose names begin with "__" are dropped at the end.

    A later step names an earlier one; the optimizer keeps a step of its own where its
    column is used more than once, while a nested Column would repeat it each time. The
    results leave through a generator, as a later filter on one of them would otherwise be
    pushed below all steps, with each of them written out in it again and again.
    """
    kept, made = list(df.columns), []
    for name, c in pairs:
        df = df.withColumn(name, c)
        if not name.startswith("__") and name not in made:
            made.append(name)
    rest = [c for c in kept if c not in made]
    out = df.select(*rest, F.explode(F.array(F.struct(*made))).alias("__made")).select(*rest, "__made.*")
    return out.select(*kept, *[c for c in made if c not in kept])


def where_any(c: Column, marks: Iterable[str], then: Column) -> Column:
    """`then` where c holds any of the marks, else c: byte searches spare most lines a regular expression."""
    found = None
    for m in marks:
        found = c.contains(m) if found is None else found | c.contains(m)
    return F.when(found, then).otherwise(c)


def where_not_ascii(c: Column, then: Column) -> Column:
    """`then` where c holds letters beyond ASCII, else c."""
    return F.when(F.octet_length(c) != F.length(c), then).otherwise(c)
