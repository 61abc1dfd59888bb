"""Problem 5: splits that keep related records together.

Records name origins; origins named together are one component. Components live in a persisted
table ``(entity, component, split)`` that is updated batch by batch: pointer jumping merges
components, existing ones keep their split, new ones fill what the splits lack, and a merge of
components that lie in different splits is quarantined."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.names import origin_entities
from tidewater.operators.components import connected_components
from tidewater.operators.prefix import prefix_sums, unit_hash
from tidewater.session import materialize, shared_dir

COMPONENTS = "entity string, component string, split string"
QUARANTINE = "quarantine"
#: Opens the component of a record that names no origin.
ALONE = "id:"
#: A component of more than this share of all records is placed on its own; there are at most
#: 1 / LARGE of them, which bounds what the driver sees.
LARGE = 0.002


def merge_components(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(entity, component)`` for every entity of ``records (id, entities)`` and of the
    existing table. Component names are the smallest entity of the component."""
    ents = records.where(F.size("entities") > 0)
    ties = ents.where(F.size("entities") > 1).select(
        F.col("entities")[0].alias("src"), F.explode(F.slice("entities", F.lit(2), F.size("entities"))).alias("dst")
    )
    every = ents.select(F.explode("entities").alias("entity"))
    if existing is not None:
        ties = ties.union(existing.where("entity <> component").select(F.col("component").alias("src"), F.col("entity").alias("dst")))
        every = every.union(existing.select("entity"))
    comps = connected_components(ties)
    return every.distinct().join(comps, F.col("entity") == F.col("node"), "left").select(
        "entity", F.coalesce("component", "entity").alias("component")
    )


def record_components(records: DataFrame, existing: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """``(id, component)`` of the records that name an origin; the others have none."""
    first = records.where(F.size("entities") > 0).select("id", F.col("entities")[0].alias("entity"))
    table = merge_components(records, existing) if table is None else table
    return first.join(table.select("entity", "component"), "entity").select("id", "component")


def related_records(train: DataFrame, targets: DataFrame) -> DataFrame:
    """``(first_id, id)``: each member but the smallest of every group of two or more related
    records, by the components that :func:`assign_splits` keeps together. Records with a null or
    unfinished reference belong to no group; a null id is ignored; repeated rows count once. No
    records give no rows."""
    member = assign_splits(train, targets)[0].where(~F.col("component").startswith(ALONE)).select("component", "id")
    member = materialize(member, "members")
    # Partial minima meet in the final aggregate, so a group of any size is one row per map task.
    first = member.groupBy("component").agg(F.min("id").alias("first_id"))
    return member.join(first, "component").where("id <> first_id").select("first_id", "id").distinct()


def split_in_batches(train: DataFrame, targets: DataFrame, batches: int = 2, seed: str = "splits") -> DataFrame:
    """``(id, component, split)`` of all records delivered in several batches (by a hash of the
    origin's text): each batch updates the persisted table of components of the one before."""
    spark = train.sparkSession
    of = F.pmod(F.crc32(F.coalesce("source_ref", F.lit(""))), F.lit(batches))
    table, out = None, None
    for k in range(batches):
        got, table = assign_splits(train.where(of == k), targets, table, seed)
        path = f"{shared_dir(spark)}/tidewater/components-{uuid.uuid4().hex}"
        save_components(table, path)
        table = load_components(spark, path)
        # What was given out stays; a component that grew has its present name.
        got = materialize(got, "batch")
        out = got if out is None else out.union(got)
    now = table.select("entity", F.col("component").alias("now"), F.col("split").alias("last"))
    out = out.withColumnRenamed("component", "entity").join(now, "entity", "left")
    return out.select("id", F.coalesce("now", "entity").alias("component"), F.when(F.col("last") == QUARANTINE, F.col("last")).otherwise(F.col("split")).alias("split"))


def assign_splits(
    train: DataFrame, targets: DataFrame, existing: DataFrame | None = None, seed: str = "splits"
) -> tuple[DataFrame, DataFrame]:
    """``(id, component, split)`` for every record and the updated table of components.

    A record that names no origin is its own component ``id:...``. The few large components
    are placed largest first where most is missing; the others in the order of a hash, cut at
    the exact record counts that are still missing. Targets that are null or not positive are
    left out; shares are taken relative to their sum. Records of components whose earlier
    splits contradict get the split ``quarantine`` and are reported so."""
    spark = train.sparkSession
    shares = {r[0]: float(r[1]) for r in targets.select("split_name", "target_share").collect() if r[0] is not None and r[1] and r[1] > 0}
    if not shares:
        raise ValueError("no split has a positive target share")
    total_share = sum(shares.values())
    records = materialize(origin_entities(train).where("id IS NOT NULL"), "origins")
    comps = merge_components(records, existing)
    if existing is not None:
        old = existing.select("entity", F.col("split").alias("old"))
        comps = comps.join(old, "entity", "left")
    else:
        comps = comps.withColumn("old", F.lit(None).cast("string"))
    comps = materialize(comps, "components")
    fate = comps.groupBy("component").agg(F.min("old").alias("lo"), F.max("old").alias("hi"))
    kept = F.when(F.col("lo") != F.col("hi"), F.lit(QUARANTINE)).otherwise(F.col("lo"))
    fate = fate.select("component", kept.alias("kept"))
    member = (
        records.select("id", F.when(F.size("entities") > 0, F.col("entities")[0]).alias("entity"))
        .join(comps.select("entity", "component"), "entity", "left")
        .select("id", F.coalesce("component", F.concat(F.lit(ALONE), F.col("id"))).alias("component"))
        .distinct()
    )
    member = materialize(member, "members")
    sizes = (
        member.groupBy("component")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(fate, "component", "left")
        .select("component", "n", "kept")
    )
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    taken = {r[0]: r[1] for r in sizes.where("kept IS NOT NULL").groupBy("kept").agg(F.sum("n")).collect()}
    room = total - taken.get(QUARANTINE, 0)
    lacks = {s: room * x / total_share - taken.get(s, 0) for s, x in shares.items()}
    free = sizes.where("kept IS NULL").select("component", "n")
    bar = max(2, total * LARGE)
    placed = []
    for r in sorted(free.where(F.col("n") > bar).collect(), key=lambda r: (-r.n, r.component)):
        s = max(lacks, key=lambda k: (lacks[k], k))
        lacks[s] -= r.n
        placed.append((r.component, s))
    rest = free.where(F.col("n") <= bar).withColumn("u", unit_hash("component", salt=seed))
    rest = materialize(prefix_sums(materialize(rest, "rest"), [], "u", "component", "n"), "rest")
    left = sum(max(0.0, x) for x in lacks.values()) or 1.0
    n_rest = rest.agg(F.sum("n")).first()[0] or 0
    split = F.lit(None).cast("string")
    bound = 0.0
    names = [s for s in sorted(shares) if lacks[s] > 0] or sorted(shares)[:1]
    for s in names:
        bound += n_rest * max(0.0, lacks[s]) / left
        split = F.coalesce(split, F.when(F.col("before") < bound, F.lit(s)))
    rest = rest.select("component", F.coalesce(split, F.lit(names[-1])).alias("split"))
    chosen = (
        sizes.where("kept IS NOT NULL")
        .select("component", F.col("kept").alias("split"))
        .union(spark.createDataFrame(placed, "component string, split string"))
        .union(rest)
    )
    chosen = materialize(chosen, "splits")
    out = member.join(chosen, "component").select("id", "component", "split")
    # Components without a record in this batch keep what they had.
    table = comps.select("entity", "component").join(chosen, "component", "left").join(fate, "component", "left")
    table = table.select("entity", "component", F.coalesce("split", "kept").alias("split"))
    return out, table


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split the records, the share reached and the share wanted."""
    n = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"))
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    t = targets.select(F.col("split_name").alias("split"), "target_share")
    return (
        n.join(t, "split", "full_outer")
        .join(F.broadcast(total))  # one row
        .select(
            "split",
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("components", F.lit(0)).alias("components"),
            "target_share",
            (F.coalesce("records", F.lit(0)) / F.col("total")).alias("share"),
        )
    )


def save_components(table: DataFrame, path: str) -> None:
    """Persist the table of components for the next batch; ``path`` must be new."""
    table.write.mode("errorifexists").parquet(path)


def load_components(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPONENTS).parquet(path)
