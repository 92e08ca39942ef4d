"""Global positions and splits without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import materialize


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Number the rows from 0 in the order of columns that identify them: rows are dealt into ranges, ranges are
    counted, and rows are numbered inside their range behind the counts of the ranges before."""
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__range").orderBy(*order)
    numbered = dealt.withColumn("__at", F.row_number().over(inside) - 1).join(F.broadcast(counts), "__range")
    return numbered.withColumn(name, (F.col("__first") + F.col("__at")).cast("bigint")).drop("__range", "__at", "__first")


def label_encode(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Distinct values of a column, in order, with codes from 0."""
    return with_position(df.select(column).filter(F.col(column).isNotNull()).distinct(), column, name=name)


def folds(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Contiguous folds 1..k; the first ones take one row more where the rows don't divide."""
    placed = materialize(with_position(df, *order), "positions")
    n = placed.count()
    small, extra = n // k, n % k
    edge = extra * (small + 1)
    position = F.col("position")
    late = F.lit(extra + 1) + F.floor((position - edge) / max(1, small))
    fold = F.when(position < edge, F.floor(position / (small + 1)) + 1).otherwise(late)
    return placed.withColumn("fold", fold.cast("bigint")).drop("position")


def per_group(df: DataFrame, group: str, order: Column) -> DataFrame:
    """``place``: the row's place in its group, from 1, and ``n``: the group's size."""
    window = Window.partitionBy(group)
    return df.withColumn("place", F.row_number().over(window.orderBy(order, "item"))).withColumn("n", F.count(F.lit(1)).over(window))


def holdout(interactions: DataFrame, share: float = 0.8) -> DataFrame:
    """A share of each user's items for training, picked by a hash of the pair; ``split`` is train or test."""
    key = F.md5(F.concat_ws("-", "user", "item").cast("binary"))
    placed = per_group(interactions, "user", key)
    return placed.withColumn("split", F.when(F.col("place") <= F.bround(F.col("n") * share), "train").otherwise("test")).drop("place", "n")


def nth_of_user(interactions: DataFrame, start: int, stop: int) -> DataFrame:
    """The start-th to stop-th item of each user in item order."""
    return per_group(interactions, "user", F.col("item")).filter(F.col("place").between(start, stop)).drop("n")
