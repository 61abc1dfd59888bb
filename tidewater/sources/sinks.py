"""Writers. Folders are written by tasks; single reports are small and written by the driver.
All paths may be on any file system the cluster knows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.sample import single_pass
from tidewater.session import file_system


def json_lines(df: DataFrame, path: str) -> int:
    """One object a line, fields in the order of their names; nulls are kept. Fails where the
    folder exists. Gives the number of rows, counted as they are written."""
    seen = Observation()
    d = df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n"))
    d.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def ordered_json_lines(df: DataFrame, path: str, *order: str) -> int:
    """As :func:`json_lines`, the files and their lines in the given order."""
    return json_lines(df.orderBy(*order), path)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, written beside its place and then moved there."""
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} can't be written")


def report(spark: SparkSession, value: dict, path: str) -> None:
    """A small report as JSON with sorted keys."""
    put(spark, path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def require_empty(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    if fs.exists(p) and (not fs.getFileStatus(p).isDirectory() or len(fs.listStatus(p)) > 0):
        raise FileExistsError(f"{path} must be new or empty")
    fs.mkdirs(p)


def routed(df: DataFrame, path: str, by: str = "outcome", key: str = "id") -> None:
    """A folder for each outcome, its files and their lines in the order of the key; ranges of
    the key follow the size of the data, so a frequent outcome is many files."""
    df.repartitionByRange(by, key).sortWithinPartitions(by, key).write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy(by).json(path)


def stream(df: DataFrame, path: str, key: str, seed: str, name: str) -> DataFrame:
    """A training stream: every row once in hash order under a running id; gives the digest of
    each file."""
    out = single_pass(df, key, seed, name)
    out.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.mode("errorifexists").json(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_new(df: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key the folder of JSON lines doesn't hold yet, so a run that broke off
    goes on where it stopped; gives how many were written. Lines that don't parse count as
    not written."""
    spark = df.sparkSession
    fs, p = file_system(spark, path)
    d = df.dropDuplicates([key])
    if fs.exists(p) and len(fs.listStatus(p)) > 0:
        done = spark.read.text(path).select(F.expr(f"try_variant_get(try_parse_json(value), '$.{key}', 'string')").alias("__done"))
        d = d.join(done.where("__done IS NOT NULL").distinct(), F.col(key).cast("string") == F.col("__done"), "left_anti")
    seen = Observation()
    d.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def show_table(df: DataFrame, columns: Sequence[str], rows: int = 1000) -> str:
    """A table of a small result, tab-separated. A longer one ends with a line that says so."""
    got = df.select(*columns).limit(rows + 1).collect()
    text = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    more = [f"... more than {rows} rows"] if len(got) > rows else []
    return "\n".join(["\t".join(columns), *["\t".join(text(v) for v in r) for r in got[:rows]], *more])
