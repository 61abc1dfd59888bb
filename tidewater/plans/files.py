"""Queries over files: tables are written by the sinks into the shared folder and read back by
the readers, whole."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import curate, shards
from tidewater.plans import fragments as S
from tidewater.plans import registry
from tidewater.plans.streams import _run
from tidewater.session import shared_dir, ship, table
from tidewater.sources import audio, datasources, readers, sinks
from tidewater.streaming import folds, queries


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewater/{uuid.uuid4().hex}/{name}"


def _query(name: str, *tables: str, sql: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, *[table(spark, sf_dir, t) for t in tables])

        registry.QUERIES[name], registry.SQL[name] = run, sql
        return f

    return add


def _get(path: str, kind: str = "string", of: str = "value") -> F.Column:
    return F.expr(f"try_variant_get({of}, '$.{path}', '{kind}')")


_TRAIN = "SELECT id, source_id, source_ref, raw, expected FROM train_sotto_lfm"


@_query("file_json_lines", "train_sotto_lfm", sql=f"SELECT id, sha256(raw) AS raw, n, true AS counted FROM ({_TRAIN}), (SELECT count(*) AS n FROM train_sotto_lfm)")
def json_lines(spark: SparkSession, train: DataFrame) -> DataFrame:
    """Records written as JSON lines, counted as they are written, and read with their lines."""
    path = _place(spark, "train.jsonl")
    n = sinks.json_lines(train, path)
    d = readers.json_lines(spark, path).where("problem IS NULL")
    return d.select(_get("id").alias("id"), F.sha2(_get("raw"), 256).alias("raw"), F.lit(n).cast("bigint").alias("n"), (F.col("locator") >= 1).alias("counted"))


@_query("file_line_numbers", "train_sotto_lfm", sql="SELECT id, row_number() OVER (ORDER BY id) AS place FROM train_sotto_lfm")
def line_numbers(spark: SparkSession, train: DataFrame) -> DataFrame:
    """Records written in order; file and line give the place back."""
    path = _place(spark, "ordered")
    sinks.ordered_json_lines(train.select("id"), path, "id")
    d = readers.json_lines(spark, path).select("path", "locator", _get("id").alias("id"))
    n = d.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    # One row a file; the files' names follow the order.
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(n.select("path", before.alias("before")), "path").select("id", (F.col("locator") + F.col("before")).alias("place"))


@_query("file_problems", "documents", sql="""
SELECT CASE doc_id % 7 WHEN 1 THEN 'malformed' WHEN 2 THEN 'not_object' WHEN 3 THEN 'blank' WHEN 4 THEN 'text:missing' WHEN 5 THEN 'text:no_text' WHEN 6 THEN 'text:blank' END AS problem, count(*) AS lines
FROM documents WHERE doc_id % 7 > 0 GROUP BY 1""")  # fmt: skip
def problems(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every problem of every line, none of which stops the reading."""
    i = F.col("doc_id") % 7
    line = F.when(i == 1, '{"doc_id": 1, "te').when(i == 2, "[1, 2]").when(i == 3, "").when(i == 4, '{"doc_id": 1}').when(i == 5, '{"text": 5}').when(i == 6, '{"text": " "}').otherwise('{"text": "x"}')
    path = _place(spark, "dirty")
    docs.select(line.alias("value")).write.text(path)
    return readers.field_problems(readers.json_lines(spark, path, blank="keep"), ["text"]).groupBy("problem").agg(F.count(F.lit(1)).alias("lines"))


@_query("file_strict_versions", "stt_bench", sql="SELECT engine, count(*) AS n, sum(repeat_index) AS repeats FROM stt_bench WHERE schema_version = 1 AND engine IS NOT NULL GROUP BY engine")
def strict_versions(spark: SparkSession, bench: DataFrame) -> DataFrame:
    """Rows of one schema version, typed; another version would stop the reading."""
    path = _place(spark, "bench.jsonl")
    sinks.json_lines(bench.where("schema_version = 1 AND engine IS NOT NULL").select("schema_version", "engine", "repeat_index"), path)
    d = readers.versioned(spark, path, "schema_version int, engine string, repeat_index int", 1)
    return d.groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.sum("repeat_index").alias("repeats"))


@_query("file_shard_lines", "cleanup_cases", sql="SELECT DISTINCT id, raw FROM cleanup_cases WHERE id IS NOT NULL AND raw IS NOT NULL")
def shard_lines(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """A shard's records: no line may be blank."""
    path = _place(spark, "shard.jsonl")
    sinks.json_lines(cases.where("id IS NOT NULL AND raw IS NOT NULL").select("id", "raw").distinct(), path)
    return readers.strict_json_lines(spark, path, "id string, raw string", blank="keep").select("id", "raw")


@_query("file_nested_json", "nation", sql=f"SELECT 'root/' || r_name || '/nations/' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS locator, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_json(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Objects at every depth of a document, each with the keys that lead to it."""
    region = table(spark, nation.inputFiles()[0].rsplit("/", 1)[0], "region")
    j = nation.join(region, nation.n_regionkey == region.r_regionkey)
    by: dict = {}
    for r in j.select("r_name", "n_nationkey", "n_name").orderBy("n_nationkey").collect():  # 25 rows at any scale
        by.setdefault(r.r_name, {"nations": []})["nations"].append({"name": r.n_name})
    path = _place(spark, "nations.json")
    sinks.report(spark, by, path)
    return readers.nested_json(spark, path).where(F.col("locator").contains("/nations/")).select("locator", F.get_json_object("value", "$.name").alias("name"))


@_query("file_keyed_json", "nation", sql="SELECT n_name AS locator, CAST(n_nationkey AS BIGINT) AS k FROM nation")
def keyed_json(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Members of a top-level object by key."""
    path = _place(spark, "keyed.json")
    sinks.report(spark, {r.n_name: {"k": r.n_nationkey} for r in nation.select("n_name", "n_nationkey").collect()}, path)  # 25 rows
    return readers.keyed_json(spark, path).select("locator", F.get_json_object("value", "$.k").cast("bigint").alias("k"))


@_query("file_parquet_rows", "documents", sql="SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place FROM documents")
def parquet_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Two columns of a table with the row's place in its file, from one."""
    path = _place(spark, "docs.parquet")
    # One file, as places are those within a file; its rows are narrow.
    docs.select("doc_id", "lang", "n_chars").orderBy("doc_id").coalesce(1).write.parquet(path)
    return readers.parquet(spark, path, ["doc_id", "lang"], first=1).select("doc_id", "lang", F.col("locator").cast("bigint").alias("place"))


@_query("file_any_rows", "train_sotto_lfm", sql="SELECT suffix, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, unnest(['.jsonl', '.parquet']) AS suffix FROM train_sotto_lfm WHERE raw IS NOT NULL AND expected IS NOT NULL) GROUP BY suffix")
def any_rows(spark: SparkSession, train: DataFrame) -> DataFrame:
    """Records of two kinds of files by their suffix, under one contract of columns."""
    d = train.where("raw IS NOT NULL AND expected IS NOT NULL").select("id", "raw", "expected")
    places = {x: _place(spark, f"train{x}") for x in (".jsonl", ".parquet")}
    sinks.json_lines(d, places[".jsonl"])
    d.write.parquet(places[".parquet"])
    got = [readers.any_rows(spark, p, ["id", "raw", "expected"]).select(F.lit(x).alias("suffix"), F.get_json_object("value", "$.id").alias("id")) for x, p in places.items()]
    return got[0].union(got[1]).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def _workbook(rows: list[tuple]) -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    pkg = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    cell = lambda c, r, v: f'<c r="{c}{r}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i}">' + "".join(cell("AB"[k], i, v) for k, v in enumerate(r)) + "</row>" for i, r in enumerate([("key", "name"), *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="nations" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {pkg}><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@_query("file_workbook", "nation", sql="SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, 'nations:' || row_number() OVER (ORDER BY n_nationkey) + 1 AS locator FROM nation")
def workbook(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A worksheet's rows by the names of its header."""
    path = _place(spark, "nations.xlsx")
    sinks.put(spark, path, _workbook([(r[0], r[1]) for r in nation.select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]))  # 25 rows
    d = readers.workbook(spark, path, "nations")
    return d.select(F.col("cells")["key"].cast("bigint").alias("k"), F.col("cells")["name"].alias("name"), "locator")


@_query("file_pages", "nation", sql="SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS locator, n_name AS name FROM nation")
def pages(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Rows of a service that gives ten at a time."""
    rows = [r.n_name for r in nation.select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25 rows
    place = _place(spark, "page")
    for at in range(0, len(rows), 10):
        sinks.put(spark, f"{place}-{at}.json", json.dumps({"rows": [{"name": x} for x in rows[at : at + 10]]}).encode())
    spark.dataSource.register(datasources.PagedSource)
    url = place if place.startswith("file:") else f"file://{place}"
    d = spark.read.format("tidewater_pages").option("url", url + "-{offset}.json").option("rows", len(rows)).option("page", 10).load()
    return d.select("locator", F.get_json_object("value", "$.name").alias("name"))


@_query("file_archive", "nation", sql="SELECT 'data/' || n_nationkey || '.json' AS path, CAST(strlen('{\"name\": \"' || n_name || '\"}') AS BIGINT) AS bytes, sha256('{\"name\": \"' || n_name || '\"}') AS sha256 FROM nation")
def archive(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """The members of an archive that a pattern admits, with their digests."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for r in nation.select("n_nationkey", "n_name").collect():  # 25 rows
            for name, body in ((f"top/data/{r[0]}.json", json.dumps({"name": r[1]})), (f"top/notes/{r[0]}.md", "no")):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body.encode()))
    path = _place(spark, "a.tar.gz")
    sinks.put(spark, path, out.getvalue())
    return readers.archive(spark, path, ["data/*.json"]).select("path", "bytes", "sha256")


@_query("file_wav", "nation", sql="""
SELECT n_nationkey AS k, CAST(8000 + 100 * n_nationkey AS BIGINT) AS frames, (8000 + 100 * n_nationkey) / 16000 AS seconds, (1000 + 10 * n_nationkey) / 32768 AS peak, (1000 + 10 * n_nationkey) / 32768 AS rms,
  (8000 + 100 * n_nationkey) * (1000 + 10 * n_nationkey) AS total FROM nation""")  # fmt: skip
def wav(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Length and level of audio files that pass the gates, and their samples."""
    place = _place(spark, "wav")
    for (k,) in nation.select("n_nationkey").collect():  # 25 rows
        data = struct.pack("<h", 1000 + 10 * k) * (8000 + 100 * k)
        form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
        body = b"WAVE" + form + b"data" + struct.pack("<I", len(data)) + data
        sinks.put(spark, f"{place}/{k}.wav", b"RIFF" + struct.pack("<I", len(body)) + body)
    key = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("int").alias("k")
    stats = audio.usable(audio.wav_stats(spark, place)).select(key, "frames", "seconds", "peak", "rms")
    whole = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stats.join(audio.wav_samples(spark, place).select(key, F.round(whole * 32768).alias("total")), "k")


@_query("file_late_header", "nation", sql="SELECT CAST(n_nationkey AS VARCHAR) AS rail, n_name AS name FROM nation")
def late_header(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A table below other output."""
    rows = nation.select("n_nationkey", "n_name").collect()  # 25 rows
    path = _place(spark, "out.csv")
    sinks.put(spark, path, ("loading trace\n\nrail,name\n" + "".join(f'{r[0]},"{r[1]}"\n' for r in rows)).encode())
    return readers.late_header_csv(spark, path, "rail").select("rail", "name")


@_query("file_last_lines", "events", sql="SELECT event_type, max(event_id) AS event_id FROM events GROUP BY event_type")
def last_lines(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The last whole record of growing files, a file for each type."""
    path = _place(spark, "growing")
    e = events.select("event_type", "event_id")
    cut = events.select("event_type").distinct().select("event_type", F.lit(None).cast("bigint").alias("event_id"))
    e = e.union(cut).repartition("event_type").sortWithinPartitions("event_type", F.col("event_id").asc_nulls_last())
    line = F.when(F.col("event_id").isNull(), '{"event_id": 12').otherwise(F.to_json(F.struct("event_id")))
    e.select("event_type", line.alias("value")).write.partitionBy("event_type").text(path)
    d = readers.last_line(spark, f"{path}/*/*.txt")
    kind = F.regexp_extract("path", "event_type=([^/]+)/", 1)
    return d.select(F.url_decode(kind).alias("event_type"), F.get_json_object("text", "$.event_id").cast("bigint").alias("event_id"))


@_query("file_result_stream", "cleanup_results", sql="SELECT case_id, count(*) AS records, CAST(sum(coalesce(max_output_tokens, 0)) AS BIGINT) AS prompt, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion FROM cleanup_results WHERE case_id IS NOT NULL GROUP BY case_id")
def result_stream(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Token usage of result lines as they arrive; unfinished lines are passed over."""
    path = _place(spark, "lines")
    r = results.where("case_id IS NOT NULL").select("case_id", F.col("max_output_tokens").alias("prompt_tokens"), "completion_tokens")
    lines = r.select(F.to_json(F.struct("*")).alias("value"))
    lines.union(spark.createDataFrame([('{"case_id": "x", "completion_to',)], "value string")).write.text(path)
    s = _run(queries.result_lines(spark, path))
    return s.groupBy("case_id").agg(F.count(F.lit(1)).alias("records"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))


@_query("file_token_budget", "cleanup_results", sql="SELECT count(*) AS records, CAST(sum(coalesce(max_output_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS used, sum(coalesce(completion_tokens, 0)) > 10 AS spent FROM cleanup_results WHERE case_id IS NOT NULL")
def token_budget(spark: SparkSession, results: DataFrame) -> DataFrame:
    """The usage of a running job against its budget."""
    path = _place(spark, "lines")
    r = results.where("case_id IS NOT NULL").select("case_id", F.col("max_output_tokens").alias("prompt_tokens"), "completion_tokens")
    r.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    b = queries.Budget(10)
    q = b.watch(queries.result_lines(spark, path), _place(spark, "checkpoint"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.createDataFrame([(b.records, b.used, b.spent)], "records bigint, used bigint, spent boolean")


@_query("file_event_stream", "cleanup_results", sql=f"WITH {S.LATEST_RESULTS.strip()} SELECT result_id, model_text AS text, finish_reason, CAST(completion_tokens AS BIGINT) AS tokens FROM latest WHERE model_text IS NOT NULL AND finish_reason IS NOT NULL AND model_text <> ''")
def event_stream(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Answers told in server-sent events that arrive in pieces of seventeen characters."""
    from tidewater.operators.evaluate import latest
    from tidewater.plans.streams import _stream

    r = latest(results, "result_id", "ingested_at").where("model_text IS NOT NULL AND finish_reason IS NOT NULL AND model_text <> ''")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("model_text").alias("content")).alias("delta"), F.col("finish_reason"))).alias("choices")))
    usage = F.to_json(F.struct(F.struct("completion_tokens").alias("usage")))
    body = F.concat(F.lit("data: "), delta, F.lit("\r\n\r\ndata: "), usage, F.lit("\n\ndata: [DONE]\n\n"))
    d = r.select("result_id", body.alias("body")).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("body") - 1) / 17).cast("int"))))
    rows = d.select("result_id", F.col("k").cast("bigint").alias("at_ms"), F.substr("body", F.col("k") * 17 + 1, F.lit(17)).alias("chunk"), (F.col("k") == F.floor((F.char_length("body") - 1) / 17)).alias("last"))
    out = _run(folds.folded(_stream(spark, rows), "result_id", "at_ms", folds.RESPONSE))
    return out.select("result_id", "text", "finish_reason", F.col("completion_tokens").alias("tokens"))


@_query("file_listed_fields", "cleanup_cases", sql="SELECT DISTINCT id, raw FROM cleanup_cases WHERE id IS NOT NULL AND raw IS NOT NULL")
def listed_fields(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """Only the listed fields of a listed file."""
    path = _place(spark, "cases.jsonl")
    sinks.json_lines(cases.where("id IS NOT NULL AND raw IS NOT NULL").select("id", "raw", "expected", "spoken").distinct(), path)
    return readers.listed(spark, path, ["cases.jsonl"], ["id", "raw"]).distinct()


@_query("file_candidate_paths", "train_sotto_lfm", sql=r"""
WITH t AS (SELECT source_ref, split_part(source_ref, ':', 2) AS path FROM train_sotto_lfm WHERE source_ref IS NOT NULL)
SELECT path, count(*) AS records FROM t WHERE NOT regexp_matches(path, '(^|/)[^/]*test[^/]*$') AND (regexp_matches(path, '(^|/)[^/]*\.parquet$') OR regexp_matches(path, '(^|/)[^/]*\.jsonl?$')) GROUP BY path""")  # fmt: skip
def candidate_paths(spark: SparkSession, train: DataFrame) -> DataFrame:
    """Records of candidate files; what a pattern holds out wins over what another admits."""
    t = train.where("source_ref IS NOT NULL").select(F.coalesce(F.get(F.split("source_ref", ":"), F.lit(1)), F.lit("")).alias("path"))
    return readers.candidates(t, "path", ["*test*"], ["*.parquet", "*.json", "*.jsonl"]).groupBy("path").agg(F.count(F.lit(1)).alias("records"))


@_query("file_path_problems", "train_sotto_lfm", sql=r"""
WITH t AS (SELECT coalesce(source_ref, '') AS r FROM train_sotto_lfm), p AS (SELECT r, split_part(r, ':', 2) AS path, len(string_split(r, ':')) AS n FROM t)
SELECT CASE WHEN n < 3 THEN 'malformed' WHEN regexp_matches(path, '(^|/)[^/]*test[^/]*$') THEN 'held_out' WHEN NOT regexp_matches(path, '(^|/)[^/]*\.parquet$') THEN 'outside' END AS problem, count(*) AS records FROM p GROUP BY 1""")  # fmt: skip
def path_problems(spark: SparkSession, train: DataFrame) -> DataFrame:
    """References that no rule admits, and why."""
    return readers.path_problems(train, "source_ref", ["*test*"], ["*.parquet"]).groupBy("problem").agg(F.count(F.lit(1)).alias("records"))


@_query("file_case_loader", "cleanup_cases", sql=f"SELECT DISTINCT id, raw, expected FROM cleanup_cases WHERE id IS NOT NULL AND NOT {S.blank('raw')} AND NOT {S.blank('expected')}")
def case_loader(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """Evaluation cases with all checks: types, blanks, repeated ids."""
    path = _place(spark, "cases.jsonl")
    sinks.json_lines(cases.where(F.col("id").isNotNull() & ~curate.blank("raw") & ~curate.blank("expected")).select("id", "raw", "expected").distinct(), path)
    d = readers.strict_json_lines(spark, path, "id string, raw string, expected string")
    return readers.checked(d, {"blank raw": curate.blank("raw"), "blank expected": curate.blank("expected")}).select("id", "raw", "expected")


@_query("file_runs", "cleanup_results", sql=f"""
WITH {S.LATEST_RESULTS.strip()}
SELECT 'mine:' || coalesce(prompt_variant, 'default') AS run_label, count(*) AS n FROM latest GROUP BY 1""")  # fmt: skip
def labelled_runs(spark: SparkSession, results: DataFrame) -> DataFrame:
    """A result file under a label, a run for each of its prompts."""
    from tidewater.operators.evaluate import latest

    path = _place(spark, "r.jsonl")
    sinks.json_lines(latest(results, "result_id", "ingested_at").select("result_id", "prompt_variant", "run_source"), path)
    return shards.run_specs(spark, [f"mine={path}"]).groupBy("run_label").agg(F.count(F.lit(1)).alias("n"))


@_query("file_routed", "train_sotto_lfm", sql="SELECT CASE WHEN expected IS NULL THEN 'rejected' WHEN raw = expected THEN 'quarantine' ELSE 'candidate' END AS outcome, count(*) AS n, true AS ordered FROM train_sotto_lfm GROUP BY 1")
def routed(spark: SparkSession, train: DataFrame) -> DataFrame:
    """A folder for each outcome, each file in the order of the ids."""
    path = _place(spark, "routed")
    outcome = F.when(F.col("expected").isNull(), "rejected").when(F.col("raw") == F.col("expected"), "quarantine").otherwise("candidate")
    sinks.routed(train.select("id", "raw", outcome.alias("outcome")), path)
    d = readers.json_lines(spark, f"{path}/*/*.json").select("path", "locator", _get("id").alias("id"))
    w = Window.partitionBy("path").orderBy("locator")
    d = d.withColumn("up", F.coalesce(F.col("id") > F.lag("id").over(w), F.lit(True)))
    return d.groupBy(F.regexp_extract("path", "outcome=([^/]+)/", 1).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("up").alias("ordered"))


_UNIT = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT)"


@_query("file_stream", "train_sotto_lfm", sql=f"SELECT id, 'row-' || lpad(CAST(row_number() OVER (ORDER BY {_UNIT.format(chr(39) + '7' + chr(39) + ' || chr(31) || id')}, id) AS VARCHAR), 9, '0') AS stream_id FROM train_sotto_lfm WHERE id IS NOT NULL")
def stream(spark: SparkSession, train: DataFrame) -> DataFrame:
    """The training stream: hash order, running ids, a digest for each file."""
    path = _place(spark, "stream")
    files = sinks.stream(train.where("id IS NOT NULL").select("id"), path, "id", "7", "row")
    if files.where("length(sha256) <> 64").count():
        raise ValueError("a file without a digest")
    return readers.json_lines(spark, path).select(_get("id").alias("id"), _get("stream_id").alias("stream_id"))


@_query("file_resumed", "cleanup_cases", sql="SELECT count(DISTINCT id) AS first, CAST(0 AS BIGINT) AS second, count(DISTINCT id) AS held FROM cleanup_cases WHERE id IS NOT NULL")
def resumed(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """Appending what isn't there yet: the second run finds nothing to do."""
    path = _place(spark, "appended")
    d = cases.where("id IS NOT NULL").select("id", "raw")
    first, second = sinks.append_new(d, path), sinks.append_new(d, path)
    return readers.json_lines(spark, path).agg(F.lit(first).cast("bigint").alias("first"), F.lit(second).cast("bigint").alias("second"), F.count(F.lit(1)).alias("held"))


@_query("file_manifest", "train_sotto_lfm", sql="SELECT count(*) AS records, count(*) FILTER (WHERE raw = expected) AS held, CAST(0 AS BIGINT) AS changes FROM train_sotto_lfm")
def manifest(spark: SparkSession, train: DataFrame) -> DataFrame:
    """Digests, records and splits of files; nothing has changed since."""
    path = _place(spark, "data")
    split = F.when(F.col("raw") == F.col("expected"), "held").otherwise("train")
    sinks.json_lines(train.select("id", split.alias("split")), path)
    glob = f"{path}/*.json"
    m = readers.data_manifest(spark, glob)
    changes = readers.manifest_changes(m, readers.manifest(spark, glob)).count()
    held = F.aggregate(F.filter("splits", lambda x: x["split"] == "held"), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return m.agg(F.sum("records").alias("records"), F.sum(held).alias("held"), F.lit(changes).cast("bigint").alias("changes"))


@_query("file_manifest_changes", "nation", sql="SELECT unnest(['altered', 'missing', 'unexpected']) AS change, CAST(1 AS BIGINT) AS files")
def manifest_changes(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A file that was altered, one that is gone, one that nobody expected."""
    place = _place(spark, "files")
    for name in ("a", "b", "c"):
        sinks.put(spark, f"{place}/{name}.txt", name.encode())
    from tidewater.session import file_system, materialize

    before = materialize(readers.manifest(spark, f"{place}/*.txt"), "manifest")
    sinks.put(spark, f"{place}/a.txt", b"other")
    sinks.put(spark, f"{place}/d.txt", b"d")
    fs, p = file_system(spark, f"{place}/b.txt")
    fs.delete(p, False)
    return readers.manifest_changes(before, readers.manifest(spark, f"{place}/*.txt")).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


@_query("file_report", "nation", sql="SELECT count(*) AS nations, true AS refused FROM nation")
def report(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A report beside its place and then moved there; a folder that holds something is refused."""
    place = _place(spark, "reports")
    sinks.require_empty(spark, place)
    sinks.report(spark, {"nations": nation.count()}, f"{place}/r.json")
    try:
        sinks.require_empty(spark, place)
        refused = False
    except FileExistsError:
        refused = True
    d = readers.nested_json(spark, f"{place}/r.json")
    return d.select(F.get_json_object("value", "$.nations").cast("bigint").alias("nations"), F.lit(refused).alias("refused"))


@_query("file_table_text", "region", sql="SELECT string_agg(r_regionkey || chr(9) || r_name, chr(10) ORDER BY r_regionkey) AS body FROM region")
def table_text(spark: SparkSession, region: DataFrame) -> DataFrame:
    """A small result as a table of text."""
    body = sinks.show_table(region.orderBy("r_regionkey"), ["r_regionkey", "r_name"]).split("\n", 1)[1]
    return spark.createDataFrame([(body,)], "body string")


@_query("file_token_caps", "cleanup_cases", sql="SELECT id, len(regexp_extract_all(raw, '[^\\s\\p{Z}]+')) AS n, CAST(greatest(900, ceil(len(regexp_extract_all(raw, '[^\\s\\p{Z}]+')) * 1.5)) AS INTEGER) AS cap FROM (SELECT id, min(raw) AS raw FROM cleanup_cases WHERE id IS NOT NULL AND raw IS NOT NULL GROUP BY id)")
def token_caps(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """Words of each input and the output budget that follows from them."""
    c = shards.text_free(cases.where("id IS NOT NULL AND raw IS NOT NULL"), ("id", "raw")).groupBy("id").agg(F.min("raw").alias("raw"))
    n = F.size(F.regexp_extract_all("raw", F.lit(r"[^\s\p{Z}]+"), F.lit(0)))
    return c.select("id", n.cast("bigint").alias("n")).withColumn("cap", T.token_cap("n"))
