"""Problem 4: samples that match target category proportions.

Per target an acceptance probability follows from wanted over observed counts; records are
accepted independently by a hash, slightly more than needed. The counts are then corrected
exactly: where too few were accepted the next ones are taken, where too many the last ones are
cut by distributed ranks. Targets that the records cannot satisfy are reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.names import category_key, corpus_key
from tidewater.operators.prefix import take_first, unit_hash
from tidewater.session import materialize

CASES, TRAIN = "cleanup_cases", "train_sotto_lfm"
#: Accepted over wanted: five standard deviations of a binomial and a little.
OVERSAMPLE, SIGMAS = 1.05, 5.0


def memberships(cases: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct ``(table_name, id, category)``: a case once for each of its categories, a
    training record for the corpus named by its source. Null ids, labels and arrays fall out."""
    c = cases.select(F.lit(CASES).alias("table_name"), "id", F.explode("categories").alias("c")).select(
        "table_name", "id", category_key("c").alias("category")
    )
    t = train.select(F.lit(TRAIN).alias("table_name"), "id", corpus_key("source_id").alias("category"))
    return c.union(t).where("id IS NOT NULL AND category IS NOT NULL").distinct()


def plan(members: DataFrame, table_sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: wanted rows, rows there are, and the acceptance probability. Wanted is
    max(``min_rows``, share x fraction x distinct ids), a fraction of a row counts as one."""
    key = F.when(F.col("table_name") == TRAIN, corpus_key("category")).otherwise(category_key("category"))
    t = targets.withColumn("key", key)
    have = members.groupBy("table_name", F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("have"))
    exact = F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_fraction", F.lit(0.0)) * F.coalesce("n_ids", F.lit(0)), 6)
    p = (
        t.join(table_sizes, "table_name", "left")
        .join(have, ["table_name", "key"], "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .withColumn("wanted", F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"), exact))
        .withColumn("quota", F.ceil("wanted").cast("bigint"))
    )
    accepted = F.col("quota") * OVERSAMPLE + SIGMAS * F.sqrt(F.col("quota").cast("double")) + SIGMAS * SIGMAS
    return p.withColumn("p_accept", F.least(F.lit(1.0), accepted / F.greatest(F.col("have"), F.lit(1)))).select(
        "target_set", "table_name", "category", "key", "target_share", "wanted", "quota", "have", "p_accept"
    )


def _plan_of(cases: DataFrame, train: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    members = materialize(memberships(cases, train), "members")
    # Of the whole tables: ids without a category count as well.
    ids = cases.select(F.lit(CASES).alias("table_name"), "id").union(train.select(F.lit(TRAIN).alias("table_name"), "id"))
    sizes = ids.where("id IS NOT NULL").distinct().groupBy("table_name").agg(F.count(F.lit(1)).alias("n_ids"))
    return members, plan(members, sizes, targets)


def unmet_targets(cases: DataFrame, train: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_set, category)`` of the targets with a deficit in the drawn sample. A category
    nobody has is unmet; empty tables make every target with a minimum unmet."""
    return sample_report(cases, train, targets).where("deficit > 0").select("target_set", "category").distinct()


def _drawn(members: DataFrame, p: DataFrame, seed: str) -> DataFrame:
    # One row per target, so its size doesn't follow the records; AQE broadcasts it if small.
    p = p.select("target_set", "table_name", "category", "key", "quota", "have", "p_accept")
    m = members.withColumnRenamed("category", "key")
    u = unit_hash("target_set", "key", "id", salt=seed)
    both = m.join(p, ["table_name", "key"]).withColumn("u", u)
    accepted = materialize(both.where(F.col("u") < F.col("p_accept")), "accepted")
    n = accepted.groupBy("target_set", "category").agg(F.count(F.lit(1)).alias("n"))
    short = p.join(n, ["target_set", "category"], "left").where(F.coalesce("n", F.lit(0)) < F.least("quota", "have"))
    short = materialize(short.select("target_set", "category"), "short")
    if not short.isEmpty():
        # The records with the next hashes make up for it: those of the whole category are ranked.
        more = both.join(short, ["target_set", "category"], "left_semi").withColumn("p_accept", F.lit(1.0))
        accepted = materialize(accepted.join(short, ["target_set", "category"], "left_anti").unionByName(more), "accepted")
    # Ranges of v must be uniform in [0, 1) after acceptance.
    accepted = accepted.withColumn("v", F.col("u") / F.col("p_accept"))
    return take_first(accepted, ["target_set", "category"], "v", "id", "quota").select("target_set", "category", "id")


def draw(cases: DataFrame, train: DataFrame, targets: DataFrame, seed: str = "sample") -> DataFrame:
    """``(target_set, category, id)``: for each target exactly min(quota, have) distinct ids, those
    with the smallest hashes. A case may be drawn for several of its categories. Deterministic
    for a seed, whatever the partitions."""
    return _drawn(*_plan_of(cases, train, targets), seed)


def sample_report(cases: DataFrame, train: DataFrame, targets: DataFrame, seed: str = "sample") -> DataFrame:
    """Per target wanted, available and drawn rows, the deficit, and the share of the sample."""
    members, p = _plan_of(cases, train, targets)
    p = materialize(p, "plan")
    drawn = _drawn(members, p, seed).groupBy("target_set", "category").agg(F.count(F.lit(1)).alias("drawn"))
    full = drawn.groupBy("target_set").agg(F.sum("drawn").alias("of"))
    r = p.join(drawn, ["target_set", "category"], "left").join(full, "target_set", "left")
    d = F.coalesce("drawn", F.lit(0))
    return r.select(
        "target_set", "table_name", "category", "target_share", F.col("quota").alias("wanted"), F.col("have").alias("available"),
        d.alias("drawn"), F.greatest(F.col("quota") - d, F.lit(0)).alias("deficit"), F.try_divide(d, F.col("of")).alias("share_drawn"),
    )
