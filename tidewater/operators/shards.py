"""Sharded runs: assignment, merging, resuming, identity of a run's settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T


class ShardError(ValueError):
    """Shards that can't be one run."""


def fingerprint(settings: Mapping, extra: Mapping | None = None) -> str:
    """SHA-256 of settings as JSON with sorted keys; extras may add keys but not change any."""
    clash = sorted(set(settings) & set(extra or {}))
    if clash:
        raise ShardError(f"extras may not replace {', '.join(clash)}")
    text = json.dumps({**settings, **(extra or {})}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def problems(rows: DataFrame, cases: DataFrame, shards: int) -> DataFrame:
    """``(problem, case_id)``: what keeps the rows of all shards from being one run. ``rows``:
    case_id, shard_index, shard_count, evaluation_fingerprint, source_index; ``cases``: case_id,
    source_index."""
    n = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    right = T.shard_of("case_id", shards)
    none = F.lit(None).cast("string")
    prints = rows.agg(F.countDistinct("evaluation_fingerprint").alias("k")).where("k > 1").select(F.lit("several_settings").alias("problem"), none.alias("case_id"))
    parts = [
        n.where("n > 1").select(F.lit("repeated").alias("problem"), "case_id"),
        n.join(cases, "case_id", "left_anti").select(F.lit("unknown").alias("problem"), "case_id"),
        cases.join(n, "case_id", "left_anti").select(F.lit("missing").alias("problem"), "case_id"),
        rows.where((F.col("shard_count") != shards) | (F.col("shard_index") != right)).select(F.lit("wrong_shard").alias("problem"), "case_id"),
        rows.join(cases.select("case_id", F.col("source_index").alias("at")), "case_id").where("at <> source_index").select(F.lit("wrong_place").alias("problem"), "case_id"),
        prints,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def merged(rows: DataFrame, cases: DataFrame, shards: int) -> DataFrame:
    """The rows of all shards in the order of the cases; fails with the first problem."""
    bad = problems(rows, cases, shards).orderBy("problem", "case_id").limit(1).collect()
    if bad:
        raise ShardError(f"{bad[0].problem}: {bad[0].case_id}")
    return rows.orderBy("source_index")


def remaining(assigned: DataFrame, done: DataFrame, order: str = "source_index") -> DataFrame:
    """The cases of a shard that are left. What is done must be its beginning: counts up to each
    place tell, within one shard."""
    d = assigned.join(done.select("case_id").distinct().withColumn("done", F.lit(1)), "case_id", "left")
    last = d.where("done = 1").agg(F.max(order).alias("last"))
    gap = d.where("done IS NULL").join(F.broadcast(last), F.col(order) < F.col("last"))  # one row
    strange = done.join(assigned, "case_id", "left_anti")
    if not gap.isEmpty() or not strange.isEmpty():
        raise ShardError("what is done isn't the beginning of what is assigned")
    return d.where("done IS NULL").drop("done")


def ordered_digest(df: DataFrame, column: str, order: str) -> DataFrame:
    """SHA-256 over the texts in order, one a line. A digest of a sequence is one stream: one task
    reads the sorted rows and holds nothing but the state of the hash. Null texts count as empty;
    no rows give the digest of nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = hashlib.sha256()
        for b in batches:
            for t in b["text"]:
                h.update((t or "").encode() + b"\n")
        yield pd.DataFrame({"digest": [h.hexdigest()]})

    d = df.select(F.col(order).alias("place"), F.col(column).alias("text"))
    return d.repartition(1).sortWithinPartitions("place").mapInPandas(run, "digest string")


def runs(results: DataFrame, label: str | None = None) -> DataFrame:
    """Results with a run label: the given one, with the prompt variant where there are several."""
    ends = results.agg(*[f(F.coalesce("prompt_variant", F.lit(""))) for f in (F.min, F.max)]).first()
    several = F.lit(ends[0] != ends[1])
    base = F.lit(label) if label else F.coalesce("run_source", F.lit("run"))
    return results.withColumn("run_label", F.when(several, F.concat_ws(":", base, F.coalesce("prompt_variant", F.lit("default")))).otherwise(base))


def run_specs(spark: SparkSession, specs: Sequence[str]) -> DataFrame:
    """Results of several files, each given as ``[LABEL=]PATH``, with the label of their run; a
    label may be given once only. Without a label the run's source names it."""
    seen: set[str] = set()
    out = None
    for spec in specs:
        label, sep, path = spec.partition("=")
        if not sep or "/" in label:
            label, path = "", spec
        if label in seen and label:
            raise ShardError(f"the label {label} is given twice")
        seen.add(label)
        d = runs(spark.read.json(path, primitivesAsString=True), label or None)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ShardError("no result is given")
    return out


def text_free(cases: DataFrame, columns: Sequence[str] = ("id", "raw", "categories")) -> DataFrame:
    """Only the named columns of cases: what a device may see."""
    return cases.select(*columns)
