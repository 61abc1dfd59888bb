"""Distributed prefix sums and ranks within groups, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import materialize


def unit_hash(*cols: Column | str, salt: str = "") -> Column:
    """A uniform number in [0, 1) that depends on the values (as texts) and the salt only: the
    first 52 bits of an MD5, so other systems can follow it. Null values count as empty texts."""
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    h = F.md5(F.concat_ws("\x1f", F.lit(salt), *texts))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def prefix_sums(
    df: DataFrame, groups: Sequence[str], order: str, tie: str, value: str, out: str = "before", rows_per_bucket: int = 20000, largest_group: int | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come earlier by
    (``order``, ``tie``). ``order`` must be uniform in [0, 1) (:func:`unit_hash`), so equal-width
    ranges of it hold about equally many rows: each range is summed on its own, the sums of the
    ranges are accumulated (``groups x ranges`` rows), and only rows of one range are sorted
    together. Null values count as 0; null group keys form a group. An empty input gives none."""
    g = list(groups)
    if largest_group is None:
        row = df.groupBy(*g).count().agg(F.max("count")).first()
        largest_group = (row and row[0]) or 0
    n = max(1, -(-largest_group // rows_per_bucket))
    b = df.withColumn("__b", F.least(F.floor(F.col(order) * n), F.lit(n - 1)).cast("int"))
    v = F.coalesce(F.col(value), F.lit(0)).cast(_sum_type(df, value))
    sums = b.groupBy(*g, "__b").agg(F.sum(v).alias("__s"))
    w = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(_sum_type(df, value))
    sums = sums.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.col("__b").alias("__k"), F.coalesce(F.sum("__s").over(w), zero).alias("__o"))
    cond = F.col("__b") == F.col("__k")
    for i, c in enumerate(g):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inner = Window.partitionBy(*g, "__b").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.withColumn("__i", F.coalesce(F.sum(v).over(inner), zero))
        .join(sums, cond)
        .withColumn(out, F.col("__o") + F.col("__i"))
        .drop("__b", "__k", "__o", "__i", *[f"__g{i}" for i in range(len(g))])
    )


def _sum_type(df: DataFrame, value: str) -> str:
    return "double" if dict(df.dtypes)[value] in ("double", "float") else "bigint"


def take_first(df: DataFrame, groups: Sequence[str], order: str, tie: str, quota: str) -> DataFrame:
    """The first ``quota`` rows (a column, constant in a group) of each group by
    (``order``, ``tie``), exactly, by distributed ranks."""
    return prefix_sums(df.withColumn("__one", F.lit(1).cast("bigint")), groups, order, tie, "__one", "__rank").where(F.col("__rank") < F.col(quota)).drop("__one", "__rank")


def global_rank(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    """Adds the position of each row in the given order, from 0. Rows are range-partitioned and
    sorted, numbered within their partition, and shifted by the counts of the partitions before:
    one small row for each partition is all that is brought together. The order should be
    total; otherwise tied rows get any of their places, but each only one."""
    d = df.orderBy(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    d = materialize(d, "ranked")
    n = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = n.select("__p", before.alias("__o"))
    place = F.col("__m") - F.shiftleft(F.col("__p").cast("bigint"), 33) + F.col("__o")
    return d.join(F.broadcast(at), "__p").withColumn(out, place).drop("__p", "__m", "__o")  # a row a partition
