"""Streaming aggregates: token budgets over growing files, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON-line files as they arrive in a folder; a line that doesn't parse, such as
    an unfinished last one, is passed over."""
    t = spark.readStream.text(folder)
    v = t.select(F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL")
    return v.select(
        F.expr("try_variant_get(v, '$.case_id', 'string')").alias("case_id"),
        F.coalesce(F.expr("try_variant_get(v, '$.prompt_tokens', 'bigint')"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.expr("try_variant_get(v, '$.completion_tokens', 'bigint')"), F.lit(0)).alias("completion_tokens"),
    )


class Budget:
    """Token usage of a running job; the query stops when a budget is used up."""

    def __init__(self, most: int):
        self.most, self.used, self.records, self.spent = most, 0, 0, False

    def _batch(self, df: DataFrame, _epoch: int) -> None:
        n, p, c = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("prompt_tokens"), F.lit(0)), F.coalesce(F.sum("completion_tokens"), F.lit(0))).first()
        self.records += n
        self.used += p + c
        self.spent = self.used >= self.most

    def watch(self, lines: DataFrame, checkpoint: str) -> StreamingQuery:
        return lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, ts: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts and sums by event time; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    """Runs of rows of a key with gaps below ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
