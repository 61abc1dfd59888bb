"""Streaming queries, run over all data there is and then stopped; their results are tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import registry
from tidewater.session import shared_dir, ship, table, written
from tidewater.streaming import folds, queries


def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A stream over a table."""
    return spark.readStream.schema(df.schema).parquet(written(df, "stream"))


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a table."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tidewater/run-{uuid.uuid4().hex}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{at}/out").start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{at}/out")
    # Each batch gives the whole result; the last one stays.
    q = w.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{at}/out-{i}")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out-{q.lastProgress['batchId']}")


def _query(f, name: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    registry.QUERIES[name] = run
    if sql:
        registry.SQL[name] = sql


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts said piece by piece: the transcripts and the ends of their utterances."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", F.split("text", "(?<=[.])").alias("p"))
    parts = F.transform("p", lambda x, i: F.struct((2 * i).alias("seq"), F.lit("delta").alias("kind"), x.alias("text")))
    ends = F.transform("p", lambda x, i: F.struct((2 * i + 1).alias("seq"), F.when(x.endswith("."), "eou").otherwise("pause").alias("kind"), F.lit("").alias("text")))
    last = F.array(F.struct((2 * F.size("p")).alias("seq"), F.lit("end").alias("kind"), F.lit("").alias("text")))
    rows = d.select("doc_id", F.inline(F.concat(parts, ends, last)))
    out = _run(folds.folded(_stream(spark, rows), "doc_id", "seq", folds.TRANSCRIPT))
    return out.where("final").select("doc_id", "transcript", F.size("ends").alias("utterances"))


_query(
    transcripts,
    "stream_transcripts",
    "SELECT doc_id, text AS transcript, CAST(length(text) - length(replace(text, '.', '')) AS INTEGER) AS utterances FROM documents WHERE text IS NOT NULL AND text <> ''",
)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    w = _run(queries.windowed(_stream(spark, e), "ts", "100 years", "1 hour", "event_type"), "complete")
    return w.select(F.unix_seconds("window.start").alias("hour"), "event_type", "n", "total")


_query(
    event_windows,
    "stream_event_windows",
    "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, sum(coalesce(value, 0)) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
)


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many actions of each user were undone, an error undoing the last."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    e = e.select("user_id", "event_id", F.when(F.col("event_type") == "error", "undo").otherwise("add").alias("kind"), F.col("event_type").alias("text"))
    h = _run(folds.folded(_stream(spark, e), "user_id", "event_id", folds.history(5)))
    return h.groupBy("user_id").agg(F.count_if(~F.col("undone")).alias("added"), F.count_if("undone").alias("undone"))


_query(
    event_history,
    "stream_history",
    """
WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS undo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (
  SELECT user_id, k, undo, CASE WHEN undo THEN 0 ELSE 1 END AS held, 0 AS undone FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, e.undo, CASE WHEN e.undo THEN greatest(s.held - 1, 0) ELSE least(s.held + 1, 5) END, CASE WHEN e.undo AND s.held > 0 THEN 1 ELSE 0 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1
)
SELECT user_id, count_if(NOT undo) AS added, CAST(sum(undone) AS BIGINT) AS undone FROM s GROUP BY user_id HAVING count_if(NOT undo) + sum(undone) > 0""",
)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level meter over values as chunks of samples, for each user."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND value IS NOT NULL").select("user_id", F.col("event_id").alias("seq"), F.array(*[F.sin(F.col("value") * k) / 2 for k in range(1, 9)]).alias("samples"))
    out = _run(folds.folded(_stream(spark, e), "user_id", "seq", folds.LEVEL))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("level").alias("loudest"))


_query(levels, "stream_levels")



def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing files, one a user: how much each gained since it was last seen."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "event_id", (F.col("event_id") * 3).alias("bytes"), F.lit("running").alias("status"))
    g = _run(folds.folded(_stream(spark, e), "user_id", "event_id", folds.growth()))
    return g.select("user_id", "bytes", "gained")


_query(growth, "stream_growth", "SELECT user_id, event_id * 3 AS bytes, event_id * 3 - coalesce(lag(event_id * 3) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS gained FROM events WHERE user_id IS NOT NULL")


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user, at most one in any 500 units of their number."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", F.col("event_id").alias("at_ms"), F.col("event_type").alias("text"))
    return _run(folds.folded(_stream(spark, e), "user_id", "at_ms", folds.throttled(500))).select("user_id", "at_ms", "text")


_query(
    throttled,
    "stream_throttled",
    """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT user_id, min(event_id) AS at_ms FROM e GROUP BY user_id
  UNION ALL
  SELECT s.user_id, (SELECT min(e.event_id) FROM e WHERE e.user_id = s.user_id AND e.event_id >= s.at_ms + 500) FROM s WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.event_id >= s.at_ms + 500)
)
SELECT s.user_id, s.at_ms, e.event_type AS text FROM s JOIN e ON e.user_id = s.user_id AND e.event_id = s.at_ms""",
)
