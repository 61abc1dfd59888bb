"""The queries of the nine problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import leakage, mixing, neardup, pairs, quantiles, residue, sampling, splits, truncation
from tidewater.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _q(f: Callable[..., DataFrame], *tables: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(*[table(spark, sf_dir, t) for t in tables])

    return run


RESULTS = ("cleanup_results", "cleanup_cases", "heldout_cases")
SAMPLE = ("cleanup_cases", "train_sotto_lfm", "sample_targets")
SPLIT = ("train_sotto_lfm", "split_targets")


def _splits(train: DataFrame, targets: DataFrame) -> DataFrame:
    return splits.assign_splits(train, targets)[0]


def _split_report(train: DataFrame, targets: DataFrame) -> DataFrame:
    return splits.split_report(_splits(train, targets), targets)


QUERIES: dict[str, Query] = {
    "p1_found": _q(lambda *t: truncation.cut_results(*t).select("result_id"), *RESULTS),
    "p1_rates": _q(truncation.truncation_report, *RESULTS),
    "p1_spikes": _q(truncation.length_spikes, "cleanup_results"),
    "p2_found": _q(neardup.near_pairs, "train_sotto_lfm"),
    "p2_groups": _q(neardup.near_groups, "train_sotto_lfm"),
    "p3_found": _q(pairs.first_defects, *RESULTS),
    "p3_report": _q(pairs.defect_report, *RESULTS),
    "p4_found": _q(sampling.unmet_targets, *SAMPLE),
    "p4_sample": _q(sampling.draw, *SAMPLE),
    "p4_report": _q(sampling.sample_report, *SAMPLE),
    "p5_found": _q(splits.related_records, *SPLIT),
    "p5_splits": _q(_splits, *SPLIT),
    "p5_batches": _q(lambda t, s: splits.split_in_batches(t, s).groupBy("component").agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("records")), *SPLIT),
    "p5_report": _q(_split_report, *SPLIT),
    "p6_percentiles": _q(quantiles.timing_percentiles, "cleanup_results"),
    "p6_bounds": _q(quantiles.percentile_check, "cleanup_results"),
    "p7_found": _q(leakage.leaked, "documents", "heldout_cases"),
    "p7_leaks": _q(leakage.leaks, "documents", "heldout_cases"),
    "p7_items": _q(leakage.leak_report, "documents", "heldout_cases"),
    "p8_found": _q(mixing.short_sources, "documents", "mix_targets"),
    "p8_mix": _q(mixing.mix, "documents", "mix_targets"),
    "p8_mix_bytes": _q(lambda d, t: mixing.mix(d, t, mixing.BYTES), "documents", "mix_targets"),
    "p8_report": _q(mixing.mix_report, "documents", "mix_targets"),
    "p9_found": _q(residue.residue_kinds, "documents"),
    "p9_sources": _q(residue.residue_sources, "documents"),
    "p9_clean": _q(lambda d: residue.without_residue(d).select("doc_id"), "documents"),
}
