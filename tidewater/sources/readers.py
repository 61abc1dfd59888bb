"""Readers: JSON lines, nested JSON, Parquet, tables with a late header, archives, manifests.

Every reader keeps where a row came from: ``path`` and ``locator``."""

from __future__ import annotations

import io
import os
import re
import tarfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.functions import udfs


class SourceError(ValueError):
    """A source doesn't keep its contract."""


def path_matches(path: str, patterns: Sequence[str]) -> bool:
    """Whether a path matches a pattern as a path, from its right end, or as a whole name."""
    return any(re.search(g, path) for p in patterns for g in (_as_path(p), _as_name(p)))


def _glob(pattern: str, any_: str, one: str) -> str:
    """A pattern of ``*``, ``?`` and ``[...]`` as a regular expression that Java knows as well."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += any_
        elif c == "?":
            out += one
        elif close > 0:
            inner = pattern[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def _as_name(pattern: str) -> str:
    return rf"(?s)\A{_glob(pattern, '.*', '.')}$"


def _as_path(pattern: str) -> str:
    parts = [_glob(x, "[^/]*", "[^/]") for x in pattern.strip("/").split("/") if x]
    return rf"(?s){'^/' if pattern.startswith('/') else '(?:^|/)'}{'/'.join(parts)}$"


def matches(column: str, patterns: Sequence[str]) -> Column:
    """As :func:`path_matches`, as an expression; null paths match nothing."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.col(column).rlike(_as_path(p)) | F.col(column).rlike(_as_name(p))
    return F.coalesce(out, F.lit(False))


def matching(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose path matches one of the patterns, by the rules of path and of name matching."""
    return df.where(matches(column, patterns))


def candidates(df: DataFrame, column: str, holdout: Sequence[str], include: Sequence[str]) -> DataFrame:
    """Rows of candidate paths: those that ``include`` admits and ``holdout`` doesn't; a path that
    both name is held out."""
    return df.where(~matches(column, holdout) & matches(column, include))


def path_problems(df: DataFrame, ref: str, holdout: Sequence[str], include: Sequence[str]) -> DataFrame:
    """Adds ``problem`` to rows with a reference ``source:path:locator``: ``malformed``, ``held_out``
    or ``outside``; null where the path is a candidate's."""
    parts = F.split(F.coalesce(F.col(ref), F.lit("")), ":", 3)
    d = df.withColumn("__path", F.get(parts, F.lit(1)))
    problem = F.when(F.size(parts) < 3, "malformed").when(matches("__path", holdout), "held_out").when(~matches("__path", include), "outside")
    return d.withColumn("problem", problem).drop("__path")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, locator, text)``, the locator being the 1-based line of the file. Files are read in
    blocks like any text; the lines of the blocks before are counted and added, so a large file
    is many tasks and any store will do."""
    d = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), F.regexp_replace("value", "\r+$", "").alias("text")
    )
    # The rows of a block follow each other within one task.
    block = d.groupBy("path", "__b").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("path").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select(F.col("path").alias("__p"), F.col("__b").alias("__q"), (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first") + 1).alias("__o"))
    j = d.join(block, (F.col("path") == F.col("__p")) & (F.col("__b") == F.col("__q")))
    return j.select("path", (F.col("__m") + F.col("__o")).alias("locator"), "text")


def json_lines(spark: SparkSession, path: str, blank: str = "skip") -> DataFrame:
    """``(path, locator, text, value, problem)``; ``value`` is a variant. ``problem`` is null or
    ``malformed``, ``not_object`` or, unless blanks are skipped, ``blank``."""
    d = lines(spark, path)
    if blank == "skip":
        d = d.where(F.trim("text") != "")
    d = d.withColumn("value", F.expr("try_parse_json(text)"))
    kind = F.expr("schema_of_variant(value)")
    problem = F.when(F.trim("text") == "", "blank").when(F.col("value").isNull(), "malformed").when(~kind.startswith("OBJECT"), "not_object")
    return d.withColumn("problem", problem)


def strict_json_lines(spark: SparkSession, path: str, schema: StructType | str, blank: str = "skip") -> DataFrame:
    """The rows of a file all of whose lines are objects; fails otherwise, with the first bad
    line. Values are cast by the schema; numbers don't pass as texts."""
    d = json_lines(spark, path, blank)
    bad = d.where("problem IS NOT NULL").orderBy("path", "locator").limit(1).collect()
    if bad:
        raise SourceError(f"{bad[0].path}:{bad[0].locator}: {bad[0].problem}")
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    cols = [F.expr(f"try_variant_get(value, '$.{f.name}', '{f.dataType.simpleString()}')").alias(f.name) for f in s.fields]
    wrong = F.array_compact(F.array(*[F.when((F.expr(f"schema_of_variant(variant_get(value, '$.{f.name}'))") != "STRING"), F.lit(f.name)) for f in s.fields if f.dataType.simpleString() == "string"], F.lit(None)))
    d = d.withColumn("__wrong", F.filter(wrong, lambda x: x.isNotNull()))
    odd = d.where(F.size("__wrong") > 0).orderBy("path", "locator").limit(1).collect()
    if odd:
        raise SourceError(f"{odd[0].path}:{odd[0].locator}: {odd[0]['__wrong'][0]} isn't a text")
    return d.select("path", F.col("locator").cast("string").alias("locator"), *cols)


def last_line(spark: SparkSession, path: str) -> DataFrame:
    """The last parsable record of each file; an unfinished last line is passed over."""
    d = json_lines(spark, path).where("problem IS NULL")
    return d.groupBy("path").agg(F.max_by("text", "locator").alias("text"), F.max("locator").alias("locator"))


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    """``(path, locator, value)``: every object at every depth, the locator being the path of
    keys that leads to it, from ``root``."""
    udfs.register(spark)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")).alias("d")
    w = whole.lateralJoin(udfs.walk_json(F.col("d.doc").outer()).alias("w"))
    return w.select("d.path", F.col("w.path").alias("locator"), F.col("w.value").alias("value"))


def keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """``(path, locator, value)``: the objects of a top-level object by key, or of a top-level array
    by position. Only the top level is walked."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.expr("try_parse_json(value)").alias("doc")).where("doc IS NOT NULL").alias("d")
    w = whole.lateralJoin(spark.tvf.variant_explode(F.col("d.doc").outer()).alias("w"))
    w = w.where(F.expr("schema_of_variant(w.value)").startswith("OBJECT"))
    return w.select("d.path", F.coalesce(F.col("w.key"), F.col("w.pos").cast("string")).alias("locator"), F.to_json("w.value").alias("value"))


def parquet(spark: SparkSession, path: str, columns: Sequence[str], first: int = 0) -> DataFrame:
    """The named columns only, with file and row (counted from ``first``) as locator; fails where
    a column is missing."""
    d = spark.read.parquet(path)
    missing = sorted(set(columns) - set(d.columns))
    if missing:
        raise SourceError(f"{path}: missing columns {', '.join(missing)}")
    return d.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.row_index") + first).cast("string").alias("locator"), *columns)


def versioned(spark: SparkSession, path: str, schema: StructType | str, version: int, field: str = "schema_version") -> DataFrame:
    """Strict JSON lines of one schema version; fails where a row has another or none."""
    d = strict_json_lines(spark, path, schema)
    odd = d.where(~F.col(field).eqNullSafe(F.lit(version))).orderBy("path", "locator").limit(1).collect()
    if odd:
        raise SourceError(f"{odd[0].path}:{odd[0].locator}: {field} {odd[0][field]} isn't {version}")
    return d


def listed(spark: SparkSession, path: str, allowed: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Only the named fields of the records of an allowed file: all that may leave it."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name not in allowed:
        raise SourceError(f"{name} isn't one of {', '.join(sorted(allowed))}")
    return strict_json_lines(spark, path, ", ".join(f"{f} string" for f in fields)).select(*fields)


def checked(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """The rows of a source all of whose rules hold; fails with the first key that breaks one. A
    rule says what is wrong. Keys may not repeat."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).cast("string").alias("k"), F.lit("repeated").alias("rule"))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    bad = df.select(F.col(key).cast("string").alias("k"), F.explode(broken).alias("rule")).union(twice).orderBy("k", "rule").limit(1).collect()
    if bad:
        raise SourceError(f"{bad[0].k}: {bad[0].rule}")
    return df


def field_problems(d: DataFrame, strings: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """``(path, locator, problem)``: every problem of :func:`json_lines`, and of its objects every
    text field that is missing, no text or blank and every list field that is no list."""
    kind = lambda f: F.expr(f"schema_of_variant(variant_get(value, '$.{f}'))")
    text = lambda f: F.expr(f"try_variant_get(value, '$.{f}', 'string')")
    there = lambda f: F.expr(f"variant_get(value, '$.{f}')").isNotNull()
    wrong = [F.when(~there(f), F.lit(f"{f}:missing")).when(kind(f) != "STRING", F.lit(f"{f}:no_text")).when(F.trim(text(f)) == "", F.lit(f"{f}:blank")) for f in strings]
    wrong += [F.when(~there(f), F.lit(f"{f}:missing")).when(~kind(f).startswith("ARRAY"), F.lit(f"{f}:no_list")) for f in lists]
    found = F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.array_compact(F.array(*wrong)))
    return d.select("path", "locator", F.explode(found).alias("problem"))


def workbook(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """Rows of a worksheet as ``(path, locator, cells)``; the header names the cells of a map."""
    from tidewater.sources.datasources import WorkbookSource

    spark.dataSource.register(WorkbookSource)
    return spark.read.format("tidewater_xlsx").option("path", path).option("sheet", sheet).load()


def late_header_csv(spark: SparkSession, path: str, first_column: str) -> DataFrame:
    """A table printed below other output: the header is the line that opens with the given
    column. Only the few lines up to it are looked at by the driver."""
    head = spark.read.text(path).where(F.col("value").rlike(rf'^"?{first_column}"?,')).limit(1).collect()
    if not head:
        raise SourceError(f"{path}: no header with {first_column}")
    names = pd.read_csv(io.StringIO(head[0].value)).columns
    n = lines(spark, path)
    start = n.where(F.col("text") == head[0].value).agg(F.min("locator")).first()[0]
    body = n.where(F.col("locator") > start).where(F.trim("text") != "")
    fields = ", ".join(f"`{c}` string" for c in names)
    return body.select("locator", F.from_csv("text", fields).alias("r")).select("locator", "r.*")


def archive(spark: SparkSession, path: str, include: Sequence[str], most_bytes: int = 1 << 28) -> DataFrame:
    """``(archive, path, bytes, sha256, content)``: the members of tar archives whose path below
    the top folder matches; unsafe paths, links and members beyond ``most_bytes`` fail."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                out = []
                with tarfile.open(fileobj=io.BytesIO(content)) as t:
                    for m in t:
                        inner = m.name.split("/", 1)[1] if "/" in m.name else m.name
                        if not m.isfile() or not path_matches(inner, include):
                            continue
                        if inner.startswith("/") or ".." in inner.split("/") or m.size > most_bytes:
                            raise SourceError(f"{name}: unsafe member {m.name}")
                        c = t.extractfile(m).read()
                        out.append((name, inner, len(c), hashlib.sha256(c).hexdigest(), c))
                yield pd.DataFrame(out, columns=["archive", "path", "bytes", "sha256", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, path string, bytes bigint, sha256 string, content binary")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".jsonl": lambda s, p: json_lines(s, p).where("problem IS NULL").select("path", F.col("locator").cast("string").alias("locator"), F.col("text").alias("value")),
    ".json": nested_json,
    ".parquet": lambda s, p: s.read.parquet(p).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").cast("string").alias("locator"), F.to_json(F.struct("*")).alias("value")),
}


def any_rows(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """``(path, locator, value)`` of a file, by its suffix; the value is JSON text. ``columns`` is
    the contract of the source: a table must have them, records without them fall out."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in READERS:
        raise SourceError(f"{path}: no reader for {suffix or 'files without a suffix'}")
    if suffix == ".parquet" and columns:
        return parquet(spark, path, columns).select("path", "locator", F.to_json(F.struct(*columns)).alias("value"))
    d = READERS[suffix](spark, path)
    for c in columns:
        d = d.where(F.expr(f"variant_get(try_parse_json(value), '$.{c}')").isNotNull())
    return d


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def data_manifest(spark: SparkSession, path: str, split: str = "split") -> DataFrame:
    """``(path, bytes, sha256, records, splits)`` of files of JSON lines: how many records each has
    and how many of each split."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("__path"), F.expr(f"try_variant_get(try_parse_json(value), '$.{split}', 'string')").alias("s"))
    n = d.groupBy("__path", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("__path")
    n = n.agg(F.sum("n").alias("records"), F.array_sort(F.collect_list(F.struct(F.coalesce("s", F.lit("")).alias("split"), "n"))).alias("splits"))
    local = lambda c: F.regexp_replace(c, "^file:/+", "/")
    m = manifest(spark, path)
    return m.join(n, local(F.col("path")) == local(F.col("__path")), "left").drop("__path").withColumn("records", F.coalesce("records", F.lit(0)))


def manifest_changes(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``(path, change)``: files that are missing, unexpected or altered."""
    a = recorded.select("path", F.struct("bytes", "sha256").alias("a"))
    b = found.select("path", F.struct("bytes", "sha256").alias("b"))
    change: Column = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "altered")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")
