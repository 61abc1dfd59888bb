"""What every operator needs of the session: code on the executors, durable cuts, sizes."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewater")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWATER_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers
    can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    # The file is fetched by the executors from the driver, so a driver-local folder will do.
    path = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), "tidewater.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tidewater", os.path.relpath(full, root)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only where that
    is unset on a single machine (tests) is a temporary folder used; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _written:
        _written[key] = []
    if not hasattr(shared_dir, "own"):
        own = tempfile.mkdtemp(prefix="tidewater-shared-")
        atexit.register(shutil.rmtree, own, True)
        shared_dir.own = "file://" + own
    return shared_dir.own


def _drop(spark: SparkSession, paths: list[str]) -> None:
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session is gone already
        pass


def written(df: DataFrame, name: str = "cut") -> str:
    """Write ``df`` as Parquet into the shared folder; gives the path. The files go when the
    driver ends or with :func:`drop_written`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    key = spark.sparkContext.applicationId
    if key not in _written:
        _written[key] = []
    if not _written[key]:
        atexit.register(_drop, spark, _written[key])
    _written[key].append(path)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written into the shared folder and read back. This cuts the lineage and survives
    the loss of executors."""
    # The columns are known: no job is needed to read them from a file.
    path = written(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`materialize` gave and nothing reads any more."""
    for t in tables:
        kept = _written[t.sparkSession.sparkContext.applicationId]
        kept.remove(t.written_at)
        _drop(t.sparkSession, [t.written_at])


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what nothing refers to any more: it does so when the
    driver collects its garbage, which a driver with little to do puts off while disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(spark: SparkSession) -> None:
    """Remove what was written so far, in a long session; results that read it must be done."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    _drop(spark, paths)
    paths.clear()


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API: any store the cluster knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
