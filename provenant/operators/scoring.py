"""Precision and recall of tags against values that tell whether they are sensitive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "[taint]"


def expected(value: Column, kind: T.DataType, mark: str = MARK) -> Column:
    """Whether a cell's value shows that it is sensitive: a marked string, a number but zero, a list with such an item."""
    if isinstance(kind, T.StringType):
        shows = value.contains(mark)
    elif isinstance(kind, T.BooleanType):
        shows = F.lit(False)
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        shows = F.abs(value) > 1e-20
    elif isinstance(kind, T.NumericType):
        shows = value != 0
    elif isinstance(kind, T.ArrayType):
        shows = F.exists(value, lambda x: expected(x, kind.elementType, mark))
    else:
        shows = F.lit(False)
    return F.coalesce(shows, F.lit(False))


def score(cells: DataFrame, truth: dict[str, bool], mark: str = MARK) -> DataFrame:
    """tp, tn, fp, fn over the cells of the columns (or `column.field`s) in `truth`; null cells don't count.

    False in `truth` means that no cell of the column is sensitive.
    """
    sums = dict.fromkeys(("tp", "tn", "fp", "fn"), F.lit(0))
    for path, may in truth.items():
        kind = cells.schema
        for step in path.split("."):
            kind = kind[step].dataType
        value, tag = F.col(f"{path}.value"), F.col(f"{path}.tag")
        want = expected(value, kind["value"].dataType, mark) if may else F.lit(False)
        for name, hit in (("tp", tag & want), ("tn", ~tag & ~want), ("fp", tag & ~want), ("fn", ~tag & want)):
            sums[name] = sums[name] + (hit & value.isNotNull()).cast("long")
    return cells.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))


def precision_recall(scores: DataFrame) -> DataFrame:
    return scores.select(
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall")
    )
