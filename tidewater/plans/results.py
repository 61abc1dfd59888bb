"""Queries over model results and their cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions import udfs
from tidewater.functions import tokens
from tidewater.operators import evaluate as E
from tidewater.operators import shards
from tidewater.operators.prefix import global_rank
from tidewater.plans import fragments as S
from tidewater.plans.registry import query

_R = ("cleanup_results", "cleanup_cases", "heldout_cases")


def _pairs(results: DataFrame, cases: DataFrame, heldout: DataFrame) -> DataFrame:
    return E.paired(E.latest(results, "result_id", "ingested_at"), E.one_case(cases, heldout))


_CAND, _EXP, _RAW = (S.tidy(f"coalesce({c}, '')") for c in ("model_text", "expected", "raw"))
_SCORED = f"""
WITH {S.PAIRS.strip()},
t AS (SELECT *, {_CAND} AS c, {_EXP} AS e, {_RAW} AS r, coalesce(must_preserve, []) AS mp FROM pairs),
s AS (SELECT *, c = e AS exact, c = '' AS empty, length(c) * 10 > length(r) * 18 AS expanded, len(mp) AS anchors,
  len(list_filter(mp, lambda a: NOT contains(c, a))) AS missed FROM t)"""
_TOTALS = """count(*) AS cases, count_if(exact) AS exact_matches, count_if(exact) / count(*) AS exact_rate,
  sum(anchors - missed) AS anchors_kept, sum(anchors) AS anchors_wanted, CASE WHEN sum(anchors) > 0 THEN sum(anchors - missed) / sum(anchors) END AS anchor_rate,
  count_if(missed = 0) AS cases_kept, count_if(empty) AS empties, count_if(expanded) AS expansions"""


@query(*_R, sql=f"{_SCORED} SELECT prompt_variant, {_TOTALS} FROM s GROUP BY prompt_variant")
def eval_streams(*t: DataFrame) -> DataFrame:
    """Scores of the model's answers for each prompt."""
    return E.score_streams(_pairs(*t), ["prompt_variant"])


@query(*_R, sql=f"{_SCORED.replace('coalesce(model_text', 'coalesce(selected_text')} SELECT model_name, quantization, {_TOTALS} FROM s GROUP BY model_name, quantization")
def eval_selected(*t: DataFrame) -> DataFrame:
    """Scores of the selected texts for each model."""
    return E.score_streams(_pairs(*t), ["model_name", "quantization"], "selected_text")


@query(*_R, sql=f"{_SCORED}, x AS (SELECT *, unnest(list_distinct(categories)) AS category FROM s) SELECT category, {_TOTALS} FROM x GROUP BY category")
def eval_per_category(*t: DataFrame) -> DataFrame:
    """Scores by category; a case counts in each of its own."""
    return E.score_categories(_pairs(*t))


@query(
    *_R,
    sql=f"""{_SCORED} SELECT result_id, case_id, list_filter([CASE WHEN NOT exact THEN 'exact_mismatch' END, CASE WHEN missed > 0 THEN 'missing_preservation_anchor' END,
  CASE WHEN empty THEN 'empty' END, CASE WHEN expanded THEN 'expansion_guard' END], lambda x: x IS NOT NULL) AS reasons FROM s
WHERE NOT exact OR missed > 0 OR empty OR expanded""",
)
def eval_failures(*t: DataFrame) -> DataFrame:
    return E.failures(_pairs(*t))


@query(
    *_R,
    sql=f"""
WITH {S.PAIRS.strip()}
SELECT run_source, prompt_variant, count(*) AS records, count_if(used_fallback) AS fallbacks,
  count_if(used_fallback AND {S.tidy('selected_text')} = {S.tidy('raw')}) AS fallbacks_to_raw, count(finish_reason) AS finish_reported,
  count(hit_output_token_limit) AS cap_reported, count(*) FILTER (WHERE hit_output_token_limit) AS cap_hits,
  CASE WHEN count(hit_output_token_limit) > 0 THEN (count(*) FILTER (WHERE hit_output_token_limit)) / count(hit_output_token_limit) END AS cap_rate
FROM pairs GROUP BY run_source, prompt_variant""",
)
def eval_run_summary(*t: DataFrame) -> DataFrame:
    """Fallbacks and cap hits for each run; rates over the rows that report them."""
    return E.run_summary(_pairs(*t), ["run_source", "prompt_variant"])


@query("cleanup_results", sql=f"WITH {S.LATEST_RESULTS.strip()} SELECT run_source, finish_reason, count(*) AS n FROM latest WHERE finish_reason IS NOT NULL GROUP BY ALL")
def eval_finish_reasons(results: DataFrame) -> DataFrame:
    r = E.latest(results, "result_id", "ingested_at").where("finish_reason IS NOT NULL")
    return r.groupBy("run_source", "finish_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    *_R,
    sql=f"""
WITH {S.LATEST_RESULTS.strip()}, {S.CASES.strip()}, r AS (SELECT case_id, count(*) AS n FROM latest GROUP BY case_id)
SELECT 'unknown' AS kind, case_id, n FROM r WHERE case_id NOT IN (SELECT case_id FROM cases)
UNION ALL SELECT 'missing', case_id, CAST(0 AS BIGINT) FROM cases WHERE case_id NOT IN (SELECT case_id FROM r)
UNION ALL SELECT 'repeated', case_id, max(m) FROM (SELECT case_id, run_source, count(*) AS m FROM latest GROUP BY ALL HAVING count(*) > 1) GROUP BY case_id""",
)
def eval_unmatched(*t: DataFrame) -> DataFrame:
    """Results of unknown cases, cases without a result and cases that a run answered twice."""
    return E.unmatched(E.latest(t[0], "result_id", "ingested_at"), E.one_case(*t[1:]), "run_source")


@query(
    "cleanup_results",
    sql=f"""
WITH {S.LATEST_RESULTS.strip()},
leaf AS (SELECT run_source, replace(substr(j.fullkey, 3), '"', '') AS metric, CAST(j.atom AS DOUBLE) AS v
  FROM latest, json_tree(latest.timings) AS j WHERE j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'DECIMAL'))
SELECT run_source, metric, count(*) AS n, min(v) AS least, quantile_cont(v, 0.5) AS median, quantile_disc(v, 0.95) AS p95, max(v) AS most, avg(v) AS mean
FROM leaf GROUP BY run_source, metric""",
)
def eval_timings(results: DataFrame) -> DataFrame:
    """Every numeric leaf of the timings summed up for each run."""
    r = E.latest(results.select("result_id", "run_source", "timings", "ingested_at"), "result_id", "ingested_at")
    return E.timing_summary(E.flat_timings(r, ["run_source"]), ["run_source"])


@query(*_R)
def eval_guard(*t: DataFrame) -> DataFrame:
    """Reasons of the strict guard against the models' answers, with their literals cut off."""
    p = _pairs(*t).withColumn("why", udfs.fallback_reason("raw", udfs.sanitized("model_text"), "hit_output_token_limit"))
    why = F.coalesce(F.substring_index("why", ": ", 1), F.lit("accepted"))
    return p.groupBy("model_name", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    *_R,
    sql=f"""
WITH {S.PAIRS.strip()}
SELECT model_name, CASE WHEN {S.blank('model_text')} THEN 'Model returned empty text' WHEN hit_output_token_limit THEN 'Model reached the output token limit'
  ELSE 'accepted' END AS reason, count(*) AS n FROM pairs GROUP BY ALL""",
)
def eval_runtime_guard(*t: DataFrame) -> DataFrame:
    """The guard a device runs: blank or capped."""
    why = F.when(T.is_blank("model_text"), "Model returned empty text").when(F.col("hit_output_token_limit"), "Model reached the output token limit").otherwise("accepted")
    return _pairs(*t).groupBy("model_name", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_HAY = f"(' ' || {S.normalized('model_text')} || ' ')"


@query(
    *_R,
    sql=f"""
WITH {S.PAIRS.strip()},
t AS (SELECT prompt_variant, {_HAY} AS a, coalesce(must_preserve, []) AS keep, coalesce(must_remove, []) AS gone, list_contains(categories, 'no_op') AS still, model_text, expected FROM pairs)
SELECT prompt_variant, count(*) AS cases, count_if(len(list_filter(keep, lambda x: NOT contains(substr(a, 2, length(a) - 2), {S.normalized('x')}))) = 0) AS preserved,
  count_if(len(list_filter(gone, lambda x: contains(a, ' ' || {S.normalized('x')} || ' '))) = 0) AS removed, count(*) FILTER (WHERE still) AS no_op_cases,
  count(*) FILTER (WHERE still AND model_text = expected) AS no_op_kept
FROM t GROUP BY prompt_variant""",
)
def eval_removals(*t: DataFrame) -> DataFrame:
    """Kept and removed literals, and no-ops, for each prompt."""
    return E.removal_scores(_pairs(*t), ["prompt_variant"])


@query(
    "cleanup_results",
    sql=f"""
WITH {S.LATEST_RESULTS.strip()},
b AS (SELECT model_name, case_id, prompt_variant, count(DISTINCT coalesce(model_text, chr(1))) AS outputs, count(*) AS runs FROM latest GROUP BY ALL HAVING count(*) > 1)
SELECT model_name, count(*) AS repeated, count_if(outputs > 1) AS unstable FROM b GROUP BY model_name""",
)
def eval_instability(results: DataFrame) -> DataFrame:
    """Repeated questions to a model that got different answers."""
    r = E.latest(results.select("result_id", "model_name", "case_id", "prompt_variant", "model_text", "ingested_at"), "result_id", "ingested_at")
    g = r.groupBy("model_name", "case_id", "prompt_variant").agg(F.countDistinct(F.coalesce("model_text", F.lit("\x01"))).alias("outputs"), F.count(F.lit(1)).alias("runs")).where("runs > 1")
    return g.groupBy("model_name").agg(F.count(F.lit(1)).alias("repeated"), F.count_if(F.col("outputs") > 1).alias("unstable"))


@query(
    "cleanup_results",
    sql=f"""
WITH {S.LATEST_RESULTS.strip()},
c AS (SELECT model_name, prompt_variant, case_id, max_by(model_text, result_id) AS t FROM latest WHERE model_text IS NOT NULL AND case_id IS NOT NULL AND model_name IS NOT NULL GROUP BY ALL),
v AS (SELECT DISTINCT prompt_variant AS p FROM c WHERE prompt_variant IS NOT NULL),
k AS (SELECT x.p AS a, y.p AS b FROM v x JOIN v y ON x.p < y.p),
l AS (SELECT k.*, c.model_name, c.case_id, c.t FROM k JOIN c ON c.prompt_variant = k.a), r AS (SELECT k.*, c.model_name, c.case_id, c.t FROM k JOIN c ON c.prompt_variant = k.b)
SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, coalesce(l.model_name, r.model_name) AS model_name,
  CASE WHEN r.t IS NULL THEN 'only_left' WHEN l.t IS NULL THEN 'only_right' WHEN l.t = r.t THEN 'same' ELSE 'differs' END AS status, count(*) AS n
FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b AND l.model_name = r.model_name AND l.case_id = r.case_id GROUP BY ALL""",
)
def eval_compare_variants(results: DataFrame) -> DataFrame:
    """The answers of every model under each two prompts, case by case."""
    r = E.latest(results.select("result_id", "model_name", "case_id", "prompt_variant", "model_text", "ingested_at"), "result_id", "ingested_at")
    c = r.where("model_text IS NOT NULL AND case_id IS NOT NULL AND model_name IS NOT NULL").groupBy("model_name", "prompt_variant", "case_id").agg(F.max_by("model_text", "result_id").alias("t"))
    k = E.twos(c, "prompt_variant")
    left, right = (k.join(c, F.col("prompt_variant") == F.col(s)).select("a", "b", "model_name", "case_id", "t") for s in ("a", "b"))
    return E.compare_runs(left, right, ["a", "b", "model_name", "case_id"], "t").groupBy("a", "b", "model_name", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cleanup_results",
    sql=f"""
WITH {S.LATEST_RESULTS.strip()}
SELECT model_name, count(*) AS passes, CASE WHEN count(completion_tokens) = count(*) THEN sum(completion_tokens) END AS completion_tokens,
  max(max_output_tokens) AS largest_cap, count(DISTINCT quantization) AS quantizations FROM latest GROUP BY model_name""",
)
def eval_all_or_null(results: DataFrame) -> DataFrame:
    """Sums that are null where any row lacks its part."""
    r = E.latest(results.select("result_id", "model_name", "completion_tokens", "max_output_tokens", "quantization", "ingested_at"), "result_id", "ingested_at")
    n = F.count(F.lit(1))
    return r.groupBy("model_name").agg(n.alias("passes"), F.when(F.count("completion_tokens") == n, F.sum("completion_tokens")).alias("completion_tokens"), F.max("max_output_tokens").alias("largest_cap"), F.countDistinct("quantization").alias("quantizations"))


@query("cleanup_cases")
def case_deterministic_cleanup(cases: DataFrame) -> DataFrame:
    """How many cases the rule-based cleanup solves."""
    c = E.one_case(cases).withColumn("out", udfs.cleanup_text("raw"))
    return c.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("out") == T.tidy("expected")).alias("exact"))


@query("cleanup_cases")
def case_hesitations(cases: DataFrame) -> DataFrame:
    """Hesitations that the conservative pass takes out, and how often."""
    d = cases.where("id IS NOT NULL").groupBy("id").agg(F.min("raw").alias("raw")).withColumn("h", udfs.without_hesitations("raw"))
    return d.select(F.explode("h.removed").alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cleanup_cases",
    sql="""
WITH c AS (SELECT id, any_value(categories) AS categories FROM cleanup_cases GROUP BY id)
SELECT category, count(*) AS cases FROM (SELECT id, unnest(list_distinct(categories)) AS category FROM c) GROUP BY category""",
)
def case_category_counts(cases: DataFrame) -> DataFrame:
    """Cases of each label as written; a case counts in each of its own."""
    c = cases.where("id IS NOT NULL").groupBy("id").agg(F.min("categories").alias("categories"))
    return c.select(F.explode(F.array_distinct("categories")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "cleanup_cases",
    sql="""
WITH c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS source_index FROM (SELECT DISTINCT id FROM cleanup_cases WHERE id IS NOT NULL))
SELECT id AS case_id, CAST(source_index AS INTEGER) AS source_index, CAST(CAST('0x' || substr(sha256(id), 1, 16) AS UBIGINT) % 3 AS INTEGER) AS shard_index FROM c""",
)
def case_shards_merged(cases: DataFrame) -> DataFrame:
    """Cases dealt to three shards and merged again, with all checks."""
    c = cases.where("id IS NOT NULL").select(F.col("id").alias("case_id")).distinct()
    c = global_rank(c, "case_id", out="source_index").withColumn("source_index", F.col("source_index").cast("int"))
    print_ = shards.fingerprint({"cases": "all"}, {"repeats": 1})
    rows = c.withColumns({"shard_index": T.shard_of("case_id", 3), "shard_count": F.lit(3), "evaluation_fingerprint": F.lit(print_)})
    return shards.merged(rows, c, 3).select("case_id", "source_index", "shard_index")


@query("cleanup_cases")
def case_token_caps(cases: DataFrame) -> DataFrame:
    """Tokens of each input and the output cap that follows from them."""
    c = shards.text_free(cases).where("id IS NOT NULL").groupBy("id").agg(F.min("raw").alias("raw"))
    return c.select("id", F.size(tokens.token_ids("raw")).alias("tokens")).withColumn("cap", T.device_cap("tokens"))


@query("cleanup_cases", sql="SELECT count(*) AS records, count_if(raw <> nfc_normalize(raw) OR expected <> nfc_normalize(expected)) AS denormal FROM cleanup_cases")
def case_denormal_texts(cases: DataFrame) -> DataFrame:
    """Records with a text that isn't in NFC."""
    d = udfs.holds_denormal_text(F.to_json(F.struct("raw", "expected")))
    return cases.agg(F.count(F.lit(1)).alias("records"), F.count_if(d).alias("denormal"))
