"""Queries over speech benchmarks and event intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import evaluate as E
from tidewater.operators import trace
from tidewater.plans import fragments as S
from tidewater.plans.registry import query

_M = f"WITH {S.MEASURED.strip()}"


_SPOKEN = r"list_filter(string_split(regexp_replace(replace(replace(lower(nfc_normalize(coalesce({0}, ''))), '’', chr(39)), '‘', chr(39)), '[^\p{{L}}\p{{N}}\x27]', ' ', 'g'), ' '), lambda x: x <> '')"


# A cell of the alignment is one number: errors, substitutions, insertions and deletions by their
# weights, so the smallest number is the wanted alignment.
@query(
    "stt_bench",
    sql=f"""WITH RECURSIVE {S.MEASURED.strip()},
q AS (SELECT engine, run_id, case_id, {_SPOKEN.format('reference')} AS rw, {_SPOKEN.format('hypothesis')} AS hw FROM (SELECT *, row_number() OVER (PARTITION BY engine, run_id, case_id ORDER BY repeat_index) AS k FROM measured) WHERE k = 1),
d AS (
  SELECT engine, run_id, case_id, rw, hw, 0 AS i, list_transform(range(0, len(hw) + 1), lambda j: j * 1000001000) AS line FROM q
  UNION ALL
  SELECT engine, run_id, case_id, rw, hw, i, list_transform(range(0, len(c)), lambda j: list_min(list_transform(range(0, j + 1), lambda k: c[k + 1] + (j - k) * 1000001000))) FROM (
    SELECT engine, run_id, case_id, rw, hw, i + 1 AS i,
      list_transform(range(0, len(hw) + 1), lambda j: CASE WHEN j = 0 THEN line[1] + 1000000001 ELSE least(line[j + 1] + 1000000001, line[j] + CASE WHEN hw[j] = rw[i + 1] THEN 0 ELSE 1001000000 END) END) AS c
    FROM d WHERE i < len(rw))
), b AS (SELECT engine, len(rw) AS n, line[len(line)] % 1000000000 AS best FROM d WHERE i = len(rw)),
t AS (SELECT engine, count(*) AS cases, CAST(sum(best // 1000000) AS BIGINT) AS substitutions, CAST(sum(best % 1000000 // 1000) AS BIGINT) AS insertions, CAST(sum(best % 1000) AS BIGINT) AS deletions, CAST(sum(n) AS BIGINT) AS reference_words FROM b GROUP BY engine)
SELECT *, substitutions + insertions + deletions AS word_errors, CASE WHEN reference_words > 0 THEN (substitutions + insertions + deletions) / reference_words END AS wer FROM t""",
)
def stt_word_errors(bench: DataFrame) -> DataFrame:
    """Word error counts and rate for each engine."""
    return E.word_errors(E.measured(bench))


@query(
    "stt_bench",
    sql=f"""{_M} SELECT engine, count(*) AS runs, count(DISTINCT (run_id, case_id)) AS cases, quantile_cont(inference_duration_ms, 0.5) AS median_ms,
  quantile_cont(inference_duration_ms, 0.9) AS p90_ms, quantile_cont(inference_duration_ms, 0.99) AS p99_ms, max(inference_duration_ms) AS max_ms,
  quantile_cont(real_time_factor, 0.5) AS median_rtf, quantile_cont(real_time_factor, 0.9) AS p90_rtf, max(process_pss_kb_after_inference) AS peak_pss_kb,
  max(thermal_status_after_inference) AS max_thermal FROM measured GROUP BY engine""",
)
def stt_latency(bench: DataFrame) -> DataFrame:
    return E.speech_latency(E.measured(bench))


@query(
    "stt_bench",
    sql=f"""{_M}, c AS (SELECT engine, run_id, case_id, quantile_cont(inference_duration_ms, 0.5) AS inf, max(audio_duration_ms) AS audio FROM measured GROUP BY ALL)
SELECT engine, sum(audio) AS audio_ms, sum(inf) AS median_inference_ms, sum(inf) / sum(audio) AS corpus_rtf FROM c GROUP BY engine""",
)
def stt_corpus_rtf(bench: DataFrame) -> DataFrame:
    return E.corpus_rtf(E.measured(bench))


@query(
    "stt_bench",
    sql=f"""{_M}, c AS (SELECT engine, run_id, case_id, count(DISTINCT coalesce(hypothesis, chr(0))) AS a, count(DISTINCT {S.normalized('hypothesis')}) AS b FROM measured GROUP BY ALL)
SELECT engine, count(*) AS cases, count_if(a > 1) AS unstable, count_if(b > 1) AS unstable_words FROM c GROUP BY engine""",
)
def stt_instability(bench: DataFrame) -> DataFrame:
    return E.instability(E.measured(bench))


@query(
    "stt_bench",
    sql=f"""{_M}, c AS (SELECT engine, run_id, case_id, count(DISTINCT repeat_index) AS n, min(repeat_index) AS lo, max(repeat_index) AS hi FROM measured GROUP BY ALL)
SELECT engine, run_id, count(*) AS cases, count_if(lo = 0 AND hi = n - 1) AS whole, min(n) AS least_repeats, max(n) AS most_repeats FROM c GROUP BY engine, run_id""",
)
def stt_repeat_completeness(bench: DataFrame) -> DataFrame:
    return E.repeat_completeness(E.measured(bench))


@query(
    "stt_bench",
    sql=f"""{_M}, q AS (SELECT engine, inference_duration_ms AS v, row_number() OVER (PARTITION BY engine ORDER BY inference_duration_ms) AS r, count(*) OVER (PARTITION BY engine) AS n
  FROM measured WHERE inference_duration_ms IS NOT NULL)
SELECT engine, max(n) AS n, max(CASE WHEN r = ceil(0.9 * n) THEN v END) AS nearest, max(CASE WHEN r = greatest(floor(0.9 * n), 1) THEN v END) AS floored,
  max(CASE WHEN r = floor(0.9 * n + 0.999999) THEN v END) AS near_ceil FROM q GROUP BY engine""",
)
def stt_percentile_flavours(bench: DataFrame) -> DataFrame:
    """The 90th percentile by three rules of position; ranks come from counts of values."""
    m = E.measured(bench)
    n = F.col("n")
    p = {"nearest": F.ceil(n * F.lit(0.9)), "floored": F.greatest(F.floor(n * F.lit(0.9)), F.lit(1)), "near_ceil": F.floor(n * F.lit(0.9) + F.lit(0.999999))}
    return E.ranked_exact(m, ["engine"], "inference_duration_ms", p)


@query(
    "stt_bench",
    sql=f"""{_M}, x AS (SELECT DISTINCT engine, case_id, repeat_index FROM measured), k AS (SELECT a.engine AS a, b.engine AS b FROM (SELECT DISTINCT engine FROM x) a JOIN (SELECT DISTINCT engine FROM x) b ON a.engine < b.engine),
l AS (SELECT k.*, case_id, repeat_index FROM k JOIN x ON x.engine = k.a), r AS (SELECT k.*, case_id, repeat_index FROM k JOIN x ON x.engine = k.b)
SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, CASE WHEN l.case_id IS NULL THEN 'only_right' WHEN r.case_id IS NULL THEN 'only_left' ELSE 'both' END AS status, count(*) AS n
FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b AND l.case_id = r.case_id AND l.repeat_index = r.repeat_index GROUP BY ALL""",
)
def stt_engine_membership(bench: DataFrame) -> DataFrame:
    """Repeats that each two engines have in common, and those of one alone."""
    x = E.measured(bench).select("engine", "case_id", "repeat_index").distinct()
    k = E.twos(x, "engine")
    left, right = (k.join(x, F.col("engine") == F.col(s)).select("a", "b", "case_id", "repeat_index", F.lit("x").alias("t")) for s in ("a", "b"))
    s = E.compare_runs(left, right, ["a", "b", "case_id", "repeat_index"], "t")
    return s.groupBy("a", "b", F.when(F.col("status") == "same", "both").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("stt_bench", sql=f"{_M} SELECT engine, schema_version, count(*) AS n, count(DISTINCT phase) AS phases FROM stt_bench GROUP BY engine, schema_version")
def stt_schema_versions(bench: DataFrame) -> DataFrame:
    """Rows by schema version: a loader takes version 1 only."""
    return bench.groupBy("engine", "schema_version").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("phase").alias("phases"))


# ---- intervals --------------------------------------------------------------------------

_EV = """
e AS (SELECT event_id, user_id, event_type, value, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, CAST(60000 + (event_id % 7) * 60000 AS BIGINT) AS dur FROM e WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts, CAST(30000 + (event_id % 5) * 30000 AS BIGINT) AS dur, coalesce(value, 0) AS v FROM e WHERE event_type <> 'purchase')"""


def _intervals(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = events.where("ts IS NOT NULL AND user_id IS NOT NULL").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    s = e.where("event_type = 'purchase'").select("user_id", "ts", (60000 + (F.col("event_id") % 7) * 60000).cast("bigint").alias("dur"))
    c = e.where("event_type <> 'purchase'").select("user_id", "ts", (30000 + (F.col("event_id") % 5) * 30000).cast("bigint").alias("dur"), F.coalesce("value", F.lit(0)).alias("v"))
    return s, c


@query(
    "events",
    sql=f"""WITH {_EV.strip()}
SELECT user_id, count(*) AS samples, sum(c_v * (least(s_end, c_end) - greatest(s_ts, c_ts)) / c_dur) AS amount FROM (
  SELECT s.user_id, s.ts AS s_ts, s.ts + s.dur AS s_end, c.ts AS c_ts, c.ts + c.dur AS c_end, c.dur AS c_dur, c.v AS c_v
  FROM s JOIN c ON s.user_id = c.user_id AND c.ts < s.ts + s.dur AND c.ts + c.dur > s.ts) GROUP BY user_id""",
)
def event_interval_overlap(events: DataFrame) -> DataFrame:
    """Amounts shared out over the purchases they overlap, by the length of the overlap."""
    s, c = _intervals(events)
    return trace.attributed(trace.overlaps(s, c, 600_000, ("user_id",)), ("user_id",), "r_v", "r_dur")


@query(
    "events",
    sql=f"""WITH {_EV.strip()}, one AS (SELECT ts, dur FROM s ORDER BY dur DESC, ts LIMIT 1)
SELECT c.user_id, count(*) AS samples, sum(c.v) AS total FROM c, one WHERE c.ts BETWEEN one.ts AND one.ts + one.dur GROUP BY c.user_id""",
)
def event_containment(events: DataFrame) -> DataFrame:
    """Samples inside the longest purchase interval."""
    s, c = _intervals(events)
    inside = trace.within_longest(s.withColumn("name", F.lit("purchase")), c, "purchase")
    return inside.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("v").alias("total"))


@query(
    "events",
    sql="""
SELECT event_type, count(value) AS n, min(value) AS least, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most, avg(value) AS mean
FROM events GROUP BY event_type""",
)
def event_value_percentiles(events: DataFrame) -> DataFrame:
    return E.timing_summary(events, [], "event_type", "value")


@query(
    "events",
    sql="""
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL)
SELECT user_id, event_type, value FROM e WHERE r = 1""",
)
def event_first_by_user(events: DataFrame) -> DataFrame:
    """The first event of each user."""
    e = events.where("user_id IS NOT NULL").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type", "value")).alias("m"))
    return e.select("user_id", "m.event_type", "m.value")


@query(
    "events",
    sql="""
SELECT rail, subsystem, samples, joules, joules / 3600 AS watts FROM (
  SELECT event_type AS rail, CASE WHEN event_type LIKE 'p%' THEN 'cpu' ELSE 'other' END AS subsystem, count(*) AS samples, (max(value) - min(value)) / 1e6 AS joules FROM events GROUP BY event_type)""",
)
def event_counter_energy(events: DataFrame) -> DataFrame:
    """The rise of a counter over an hour as energy and power."""
    c = events.select(F.col("event_type").alias("track_id"), F.col("value").alias("energy_since_boot"), F.lit(3600 * 10**9).cast("bigint").alias("slice_dur"))
    rails = events.select(F.col("event_type").alias("track_id")).distinct().withColumn("raw", F.when(F.col("track_id").startswith("p"), "CPU(big)").otherwise("x"))
    e = trace.rail_energy(c, rails)
    return e.select(F.col("track_id").alias("rail"), trace.subsystem(F.col("raw")).alias("subsystem"), "samples", "joules", "watts")


@query("lineitem", "orders", sql="""
SELECT o_orderpriority AS priority, l_returnflag AS flag, CAST(grouping(o_orderpriority, l_returnflag) AS BIGINT) AS level, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY GROUPING SETS ((o_orderpriority, l_returnflag), (o_orderpriority), ())""")  # fmt: skip
def grouping_sets(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Counts per group beside their totals, in one pass."""
    j = lines.select("l_orderkey", "l_returnflag", "l_quantity").join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    p, f = F.col("o_orderpriority").alias("priority"), F.col("l_returnflag").alias("flag")
    g = j.select(p, f, "l_quantity").groupingSets([["priority", "flag"], ["priority"], []], "priority", "flag")
    return g.agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("double").alias("quantity"))


