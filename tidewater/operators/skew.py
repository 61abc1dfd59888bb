"""Equi-joins whose left side may have keys that hold a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import parallelism

#: A key with more than this share of the rows is hot; there are at most 1 / HOT such keys.
HOT = 0.02


def hot_keys(df: DataFrame, key: str, share: float = HOT) -> list:
    """The keys that hold more than ``share`` of the rows, at most 1 / share of them. Counts
    are combined before the shuffle."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in n.where(F.col("n") > share * total).orderBy(F.desc("n"), key).limit(int(1 / share)).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left", hot: list | None = None, salts: int | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``. Rows of hot keys are spread over ``salts``
    partitions (as many as shuffles have) by a hash of the column ``spread``; the rows of
    ``right`` with these keys are repeated as often, all others once. Nulls match nothing and
    are spread as well."""
    hot = hot_keys(left, key) if hot is None else hot
    salts = max(16, parallelism(left.sparkSession)) if salts is None else salts
    none = F.col(key).isNull()
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    a = left.withColumn("__salt", F.when(is_hot | none, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int"))
    every = F.array(*[F.lit(i) for i in range(salts)])
    b = right.withColumn("__salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "__salt"], how).drop("__salt")
