"""Intervals: containment, overlap with proportional shares, and energy of power rails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest(slices: DataFrame, name: str) -> DataFrame:
    """The longest slice of a name, ties to the earliest."""
    return slices.where((F.col("name") == name) & (F.col("dur") > 0)).orderBy(F.desc("dur"), "ts").limit(1)


def within_longest(slices: DataFrame, counters: DataFrame, name: str) -> DataFrame:
    """Counter samples inside the longest slice; one row is broadcast."""
    s = longest(slices, name).select(F.col("ts").alias("s0"), (F.col("ts") + F.col("dur")).alias("s1"), F.col("dur").alias("slice_dur"))
    return counters.join(F.broadcast(s), F.col("ts").between(F.col("s0"), F.col("s1"))).drop("s0", "s1")


def rail_energy(samples: DataFrame, rails: DataFrame) -> DataFrame:
    """Joules and watts of each rail over the slice: the counter's rise, micro to whole."""
    g = samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"), ((F.max("energy_since_boot") - F.min("energy_since_boot")) / 1e6).alias("joules"), F.first("slice_dur").alias("dur"))
    return g.join(rails, "track_id").withColumn("watts", F.col("joules") / (F.col("dur") / 1e9)).drop("dur")


def subsystem(c: Column) -> Column:
    """The group of a subsystem in energy reports."""
    return F.when(c.startswith("CPU("), "cpu").when(c == "GPU", "gpu").when(c.isin("DDR", "MIF", "INT", "SLC"), "memory").otherwise("other")


def overlaps(left: DataFrame, right: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals ``[ts, ts + dur)`` that overlap, with ``overlap``. Both sides are cut
    into buckets of ``width``, so the join is an equi-join on keys and bucket; a pair is given
    only in the bucket where its overlap begins. ``right``'s columns get the prefix ``r_``.
    Intervals that are null or not positive overlap nothing."""

    def cut(d: DataFrame, ts: str, dur: str) -> DataFrame:
        b0, b1 = F.floor(F.col(ts) / width), F.floor((F.col(ts) + F.col(dur) - 1) / width)
        return d.where(F.col(dur) > 0).withColumn("__b", F.explode(F.sequence(b0, b1)))

    r = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    j = cut(left, "ts", "dur").join(cut(r, "r_ts", "r_dur"), [*keys, "__b"])
    begin = F.greatest("ts", "r_ts")
    end = F.least(F.col("ts") + F.col("dur"), F.col("r_ts") + F.col("r_dur"))
    return j.where((end > begin) & (F.floor(begin / width) == F.col("__b"))).withColumn("overlap", end - begin).drop("__b")


def attributed(pairs: DataFrame, by: tuple[str, ...], amount: str = "r_energy_delta", dur: str = "r_dur") -> DataFrame:
    """Amounts of the right side shared out by overlap."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col(amount) * F.col("overlap") / F.col(dur)).alias("amount"))
