"""Scoring of model and speech results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions import udfs
from tidewater.operators.skew import salted_join
from tidewater.session import materialize


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last by ``order``: re-delivered rows count once. Null keys fall
    out; ties are broken by all columns, so the result is the same for any partitioning."""
    rest = [c for c in df.columns if c != key]
    plain = [c for c in rest if c not in order]
    s = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in plain])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(s).alias("__r")).select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def one_case(*tables: DataFrame) -> DataFrame:
    """Cases of all tables, one row for each id."""
    cols = ["id", "raw", "expected", "categories", "must_preserve", "must_remove"]
    every = tables[0].select(*cols)
    for t in tables[1:]:
        every = every.unionByName(t.select(*cols))
    s = F.struct(*cols[1:])
    return every.where("id IS NOT NULL").groupBy("id").agg(F.min(s).alias("c")).select(F.col("id").alias("case_id"), "c.*")


def paired(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results beside their cases; a case with many results is spread over partitions."""
    return salted_join(results, cases, "case_id", "result_id", "inner")


def unmatched(results: DataFrame, cases: DataFrame, run: str | None = None) -> DataFrame:
    """``(kind, case_id, n)``: results of unknown cases, cases without a result, and, where the
    column of the runs is named, cases answered more than once by a run (with the most answers)."""
    r = results.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    kind = lambda d, k, n="n": d.select(F.lit(k).alias("kind"), "case_id", F.col(n).cast("bigint").alias("n"))
    out = kind(r.join(cases, "case_id", "left_anti"), "unknown")
    out = out.unionByName(kind(cases.join(r, "case_id", "left_anti").withColumn("n", F.lit(0)), "missing"))
    if run:
        twice = results.groupBy("case_id", run).agg(F.count(F.lit(1)).alias("m")).where("m > 1").groupBy("case_id").agg(F.max("m").alias("n"))
        out = out.unionByName(kind(twice, "repeated"))
    return out


def _score_columns(pairs: DataFrame, field: str, nfc: bool = False) -> DataFrame:
    """The tests of one answer column beside the case. With ``nfc`` the texts are put into that
    form first, in one Arrow pass; otherwise all stays in the JVM."""
    form = (lambda c: udfs.nfc(F.col(c))) if nfc else F.col
    p = pairs.withColumns({f"__{k}": T.tidy(F.coalesce(form(v), F.lit(""))) for k, v in (("c", field), ("e", "expected"), ("r", "raw"))})
    anchors = F.coalesce("must_preserve", F.array().cast("array<string>"))
    return p.withColumns(
        {
            "exact": F.col("__c") == F.col("__e"),
            "empty": F.col("__c") == "",
            "expanded": T.expands("__c", "__r"),
            "anchors": F.size(anchors),
            "missed": F.size(T.missing_anchors(anchors, "__c")),
        }
    )


def stream_totals() -> list[Column]:
    n = F.count(F.lit(1))
    out = {
        "cases": n,
        "exact_matches": F.count_if("exact"),
        "exact_rate": T.ratio(F.count_if("exact"), n),
        "anchors_kept": F.sum(F.col("anchors") - F.col("missed")),
        "anchors_wanted": F.sum("anchors"),
        "anchor_rate": T.ratio(F.sum(F.col("anchors") - F.col("missed")), F.sum("anchors")),
        "cases_kept": F.count_if(F.col("missed") == 0),
        "empties": F.count_if("empty"),
        "expansions": F.count_if("expanded"),
    }
    return [v.alias(k) for k, v in out.items()]


def score_streams(pairs: DataFrame, by: Sequence[str], field: str = "model_text", nfc: bool = False) -> DataFrame:
    """Exact, preserved, empty and expanded answers per group; rates are null without rows."""
    return _score_columns(pairs, field, nfc).groupBy(*by).agg(*stream_totals())


def score_categories(pairs: DataFrame, by: Sequence[str] = (), field: str = "model_text", nfc: bool = False) -> DataFrame:
    """As :func:`score_streams` for each category; a case counts in every one of its own."""
    p = pairs.withColumn("category", F.explode(F.array_distinct("categories")))
    return _score_columns(p, field, nfc).groupBy(*by, "category").agg(*stream_totals())


def failures(pairs: DataFrame, field: str = "model_text") -> DataFrame:
    """The results that fail, with every reason."""
    p = _score_columns(pairs, field)
    why = {"exact_mismatch": ~F.col("exact"), "missing_preservation_anchor": F.col("missed") > 0, "empty": F.col("empty"), "expansion_guard": F.col("expanded")}
    reasons = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in why.items()]))
    return p.select("result_id", "case_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def run_summary(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fallbacks and cap hits; rates over the rows that report them."""
    raw = T.tidy("selected_text") == T.tidy("raw")
    reported = F.count("hit_output_token_limit")
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("used_fallback").alias("fallbacks"),
        F.count_if(F.col("used_fallback") & raw).alias("fallbacks_to_raw"),
        F.count("finish_reason").alias("finish_reported"),
        reported.alias("cap_reported"),
        F.count_if("hit_output_token_limit").alias("cap_hits"),
        T.ratio(F.count_if("hit_output_token_limit"), reported).alias("cap_rate"),
    )


def removal_scores(pairs: DataFrame, by: Sequence[str], field: str = "model_text") -> DataFrame:
    """Development scores: kept and removed literals, both compared in folded words, and
    unchanged answers where no change is wanted."""
    fold = lambda c: T.normalized_text(c)
    p = pairs.withColumns({"__a": fold(field), "__w": fold("expected")})
    kept = F.forall(F.coalesce("must_preserve", F.array().cast("array<string>")), lambda x: F.contains(F.col("__a"), fold(x)))
    gone = F.forall(F.coalesce("must_remove", F.array().cast("array<string>")), lambda x: ~F.contains(F.concat(F.lit(" "), F.col("__a"), F.lit(" ")), F.concat(F.lit(" "), fold(x), F.lit(" "))))
    still = F.array_contains("categories", "no_op")
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(kept).alias("preserved"),
        F.count_if(gone).alias("removed"),
        F.count_if(still).alias("no_op_cases"),
        F.count_if(still & (F.col(field) == F.col("expected"))).alias("no_op_kept"),
    )


# ---- percentiles ----------------------------------------------------------------------


def nearest_rank(c: str, p: float) -> Column:
    """The value at position ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def interpolated(c: str, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def _sorted_at(c: str, position: Column) -> Column:
    """Only for groups of bounded size: the values of a group are sorted in one array."""
    v = F.array_sort(F.collect_list(c))
    return F.try_element_at(v, position.cast("int"))


def floor_rank(c: str, p: float) -> Column:
    """Position int(n p), at least the first."""
    return _sorted_at(c, F.greatest(F.floor(F.count(c) * F.lit(p)), F.lit(1)))


def near_ceil_rank(c: str, p: float) -> Column:
    """Position int(p n + 0.999999)."""
    return _sorted_at(c, F.greatest(F.floor(F.count(c) * F.lit(p) + F.lit(0.999999)), F.lit(1)))


def counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(by, value, m)``: how many rows of each group have each value, written; null is a value."""
    return materialize(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m")), "counted")


def cumulated(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(by, value, m, upto, n)``: the distinct values of each group, how many rows have each, how
    many have it or a smaller one, and all rows of the group. Values are range-partitioned and
    summed within their partition; the sums of the partitions before are added, of which a group
    has as many as partitions it spans. Null values are left out. Rows that are :func:`counted`
    aren't counted again."""
    by = list(by)
    counts = df if "m" in df.columns else df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    counts = counts.where(F.col(value).isNotNull())
    d = counts.repartitionByRange(*by, value).withColumn("__p", F.spark_partition_id())
    d = materialize(d, "ranges")
    part = d.groupBy(*by, "__p").agg(F.sum("m").alias("__s"))
    same = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__s").over(same.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), before.alias("__o"), F.sum("__s").over(same).alias("n"))
    at = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        at = at & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inner = F.sum("m").over(Window.partitionBy(*by, "__p").orderBy(value))
    return d.withColumn("__i", inner).join(part, at).select(*by, value, "m", (F.col("__i") + F.col("__o")).alias("upto"), "n")


def ranked_exact(df: DataFrame, by: Sequence[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Order statistics of groups of any size, by :func:`cumulated`. ``positions`` are 1-based,
    given in terms of ``n``, the rows of the group."""
    c = cumulated(df, by, value)
    out = [F.min(F.when(F.col("upto") >= p, F.col(value))).alias(k) for k, p in positions.items()]
    return c.groupBy(*by).agg(F.first("n").alias("n"), *out)


def nearest_at(p: float) -> Column:
    """The position of the nearest-rank percentile."""
    return F.ceil(F.round(F.col("n") * F.lit(p), 9))


def between(p: float) -> tuple[Column, Column, Column]:
    """The positions on both sides of the interpolated percentile, and the weight of the upper."""
    at = (F.col("n") - 1) * F.lit(p) + 1
    return F.floor(at), F.ceil(at), at - F.floor(at)


def percentiles_exact(df: DataFrame, by: Sequence[str], value: str, nearest: dict[str, float] | None = None, linear: dict[str, float] | None = None) -> DataFrame:
    """``(by, n, ...)``: nearest-rank and interpolated percentiles of groups of any size."""
    at = {k: nearest_at(p) for k, p in (nearest or {}).items()}
    for k, p in (linear or {}).items():
        at |= {f"__lo_{k}": between(p)[0], f"__hi_{k}": between(p)[1]}
    r = ranked_exact(df, by, value, at)
    mid = [(F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * between(p)[2]).alias(k) for k, p in (linear or {}).items()]
    return r.select(*by, "n", *(nearest or {}), *mid)


def _beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two results by one key, null keys included; ``a`` has every group of ``b``."""
    names = {c: f"__k{i}" for i, c in enumerate(by)}
    b = b.withColumnsRenamed(names)
    on = F.lit(True)
    for c, k in names.items():
        on = on & F.col(c).eqNullSafe(F.col(k))
    return a.join(b, on, "left").drop(*names.values())


def timing_summary(rows: DataFrame, by: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Count, extremes, median, nearest-rank p95 and mean for each metric, of groups of any size."""
    by = [*by, metric]
    c = counted(rows, by, value)
    n = F.sum(F.when(F.col(value).isNotNull(), F.col("m")).otherwise(0))
    plain = c.groupBy(*by).agg(n.alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.try_divide(F.sum(F.col(value) * F.col("m")), n).alias("mean"))
    ranked = percentiles_exact(c, by, value, {"p95": 0.95}, {"median": 0.5}).drop("n")
    return _beside(plain, ranked, by)


def flat_timings(results: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row for each numeric leaf of ``timings``, with the columns ``keep``. A batch's texts are
    parsed at once; repeated texts of a batch only once."""
    keep = list(keep)
    kinds = {f.name: f.dataType.simpleString() for f in results.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str, tuple[list[str], list[float]]] = {}
            at, names, values = [], [], []
            for i, t in enumerate(b["timings"]):
                if not isinstance(t, str):
                    continue
                if t not in known:
                    known[t] = udfs.leaves(t)
                k, v = known[t]
                at += [i] * len(k)
                names += k
                values += v
            yield b[keep].iloc[at].assign(metric=names, value=np.array(values, float))

    head = "".join(f"{c} {kinds[c]}, " for c in keep)
    return results.select(*keep, "timings").mapInPandas(run, f"{head}metric string, value double")


# ---- speech -----------------------------------------------------------------------------

SPEECH_KEY = ["engine", "run_id", "case_id", "repeat_index"]


def measured(rows: DataFrame) -> DataFrame:
    """Measured rows, each repeat once: the last delivered."""
    m = rows.where("phase = 'measured'").where(" AND ".join(f"{k} IS NOT NULL" for k in SPEECH_KEY))
    rest = [c for c in rows.columns if c not in SPEECH_KEY and c != "ingested_at"]
    s = F.struct("ingested_at", *rest)
    return m.groupBy(*SPEECH_KEY).agg(F.max(s).alias("r")).select(*SPEECH_KEY, "r.*")


def quality_rows(m: DataFrame) -> DataFrame:
    """One row for each case of a run: the first repeat."""
    return m.groupBy("engine", "run_id", "case_id").agg(F.min_by(F.struct("reference", "hypothesis"), "repeat_index").alias("q")).select("engine", "run_id", "case_id", "q.*")


def word_errors(m: DataFrame) -> DataFrame:
    """Word error counts and rate for each engine: sums over cases, one row of each."""
    e = quality_rows(m).withColumn("w", udfs.wer_counts("reference", "hypothesis")).select("engine", "w.*")
    s = e.groupBy("engine").agg(F.count(F.lit(1)).alias("cases"), *[F.sum(c).cast("bigint").alias(c) for c in ("substitutions", "insertions", "deletions", "reference_words")])
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return s.withColumn("word_errors", errors).withColumn("wer", T.ratio(errors, F.col("reference_words")))


def speech_latency(m: DataFrame) -> DataFrame:
    """Latency and real-time factors of all measured rows for each engine, of any number."""
    v, r = "inference_duration_ms", "real_time_factor"
    m = materialize(m.select("engine", "run_id", "case_id", v, r, "process_pss_kb_after_inference", "thermal_status_after_inference"), "measured")
    plain = m.groupBy("engine").agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("run_id", "case_id").alias("cases"), F.max(v).alias("max_ms"),
        F.max("process_pss_kb_after_inference").alias("peak_pss_kb"), F.max("thermal_status_after_inference").alias("max_thermal"),
    )
    ms = percentiles_exact(m, ["engine"], v, linear={"median_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}).drop("n")
    rtf = percentiles_exact(m, ["engine"], r, linear={"median_rtf": 0.5, "p90_rtf": 0.9}).drop("n")
    return _beside(_beside(plain, ms, ["engine"]), rtf, ["engine"])


def corpus_rtf(m: DataFrame) -> DataFrame:
    """Sum of the cases' median inference time over the sum of their audio time."""
    c = m.groupBy("engine", "run_id", "case_id").agg(F.percentile("inference_duration_ms", F.lit(0.5)).alias("inf"), F.max("audio_duration_ms").alias("audio"))
    return c.groupBy("engine").agg(F.sum("audio").alias("audio_ms"), F.sum("inf").alias("median_inference_ms"), T.ratio(F.sum("inf"), F.sum("audio")).alias("corpus_rtf"))


def instability(m: DataFrame, text: str = "hypothesis") -> DataFrame:
    """Cases whose repeats differ, as written and in words."""
    c = m.groupBy("engine", "run_id", "case_id").agg(F.countDistinct(F.coalesce(text, F.lit("\x00"))).alias("a"), F.countDistinct(T.normalized_text(text)).alias("b"))
    return c.groupBy("engine").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("a") > 1).alias("unstable"), F.count_if(F.col("b") > 1).alias("unstable_words"))


def repeat_completeness(m: DataFrame) -> DataFrame:
    """For each run the cases whose repeats are 0..n-1 with the run's usual n, and the others.
    Counts tell a gap, so no list of repeats is gathered."""
    c = m.groupBy("engine", "run_id", "case_id").agg(F.countDistinct("repeat_index").alias("n"), F.min("repeat_index").alias("lo"), F.max("repeat_index").alias("hi"))
    c = c.withColumn("whole", (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))
    return c.groupBy("engine", "run_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if("whole").alias("whole"), F.min("n").alias("least_repeats"), F.max("n").alias("most_repeats"))


def twos(df: DataFrame, column: str) -> DataFrame:
    """``(a, b)``, a < b: each two of the few values of a column, nulls left out."""
    s = df.agg(F.array_sort(F.collect_set(column)).alias("s"))
    return s.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")


def compare_runs(a: DataFrame, b: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """``(key, status)`` of two runs: ``same``, ``differs``, ``only_left``, ``only_right``."""
    x = a.select(*key, F.col(text).alias("__x"), F.lit(True).alias("__l"))
    y = b.select(*key, F.col(text).alias("__y"), F.lit(True).alias("__r"))
    status = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").when(F.col("__x").eqNullSafe(F.col("__y")), "same").otherwise("differs")
    return x.join(y, list(key), "full_outer").select(*key, status.alias("status"))


def combined_passes(passes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Passes over one text as a whole: tokens weigh their rates; a sum or rate is null where
    any pass lacks its part."""
    n, tokens, rate = F.count(F.lit(1)), F.col("completion_tokens"), F.col("tokens_per_second")
    both = tokens.isNotNull() & (rate > 0)
    whole = F.count_if(both) == n
    return passes.groupBy(*by).agg(
        n.alias("passes"), F.min("first_token_ms").alias("first_token_ms"), F.when(F.count(tokens) == n, F.sum(tokens)).alias("completion_tokens"),
        F.when(whole, T.ratio(F.sum(tokens), F.sum(F.when(both, tokens / rate)))).alias("tokens_per_second"),
    )


def joined_latency(speech: DataFrame, cleanup: DataFrame) -> DataFrame:
    """Stages of one case added up."""
    return speech.join(cleanup, "case_id").select("case_id", (F.col("stt_ms") + F.col("cleanup_ms")).alias("pipeline_ms"), "audio_ms")


def single_value(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Groups in which a field that must be one value is several: ``(by, field, n)``."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f))).alias("v")) for f in fields])
    return df.select(*by, F.inline(parts)).groupBy(*by, "field").agg(F.countDistinct("v").alias("n")).where("n > 1")
