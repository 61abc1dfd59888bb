import io
import json
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.sources import audio, datasources, readers, sinks


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "n": 1}\n\n[1]\nnot json\n{"id": 5}\n')
    got = [(r.locator, r.problem) for r in readers.json_lines(spark, str(p)).orderBy("locator").collect()]
    assert got == [(1, None), (3, "not_object"), (4, "malformed"), (5, None)]
    assert [r.problem for r in readers.json_lines(spark, str(p), blank="keep").orderBy("locator").collect()][1] == "blank"
    with pytest.raises(readers.SourceError, match="3: not_object"):
        readers.strict_json_lines(spark, str(p), "id string")
    assert readers.last_line(spark, str(p)).first().locator == 5


def test_lines_of_a_file_in_blocks(spark, tmp_path):
    """A file of several blocks keeps its line numbers; carriage returns go."""
    body = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(body).encode())
    (tmp_path / "b.txt").write_text("one\ntwo\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.locator, r.text) for r in got if r.path.endswith("a.txt")} == {(i + 1, t) for i, t in enumerate(body)}
    assert sorted((r.locator, r.text) for r in got if r.path.endswith("b.txt")) == [(1, "one"), (2, "two")]


def test_contracts(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "schema_version": 1, "t": " "}\n{"id": "y", "schema_version": 2}\n5\n')
    assert {(r.locator, r.problem) for r in readers.field_problems(readers.json_lines(spark, str(p)), ["id", "t"], ["l"]).collect()} == {(1, "t:blank"), (1, "l:missing"), (2, "t:missing"), (2, "l:missing"), (3, "not_object")}
    p.write_text('{"id": "x", "schema_version": 1, "z": 1}\n{"id": "y", "schema_version": 2}\n')
    with pytest.raises(readers.SourceError, match="schema_version 2 isn't 1"):
        readers.versioned(spark, str(p), "id string, schema_version int", 1)
    with pytest.raises(readers.SourceError, match="isn't one of"):
        readers.listed(spark, str(p), ["b.jsonl"], ["id"])
    assert readers.listed(spark, str(p), ["a.jsonl"], ["id"]).columns == ["id"]
    assert readers.any_rows(spark, str(p), ["z"]).count() == 1
    d = spark.createDataFrame([("a", ""), ("b", "x")], "id string, raw string")
    with pytest.raises(readers.SourceError, match="a: blank"):
        readers.checked(d, {"blank": F.col("raw") == ""})
    with pytest.raises(readers.SourceError, match="b: repeated"):
        readers.checked(d.union(d.where("id = 'b'")), {})
    paths = spark.createDataFrame([("s:data/train-1.json:3",), ("s:data/hold/x.json:1",), ("s:z",), (None,)], "ref string")
    assert [r.problem for r in readers.path_problems(paths, "ref", ["hold/*"], ["data/*"]).collect()] == [None, "held_out", "malformed", "malformed"]


def test_strict_types(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "n": 1}\n{"id": "y"}\n')
    assert [tuple(r)[1:] for r in readers.strict_json_lines(spark, str(p), "id string, n bigint").orderBy("id").collect()] == [("1", "x", 1), ("2", "y", None)]
    p.write_text('{"id": 7}\n')
    with pytest.raises(readers.SourceError, match="id isn't a text"):
        readers.strict_json_lines(spark, str(p), "id string")


def test_nested_and_keyed_json(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"q1": {"raw": "a", "more": [{"x": 1}]}, "q2": {"raw": "b"}}))
    assert [r.locator for r in readers.nested_json(spark, str(p)).orderBy("locator").collect()] == ["root", "root/q1", "root/q1/more/0", "root/q2"]
    assert [(r.locator, json.loads(r.value)["raw"]) for r in readers.keyed_json(spark, str(p)).orderBy("locator").collect()] == [("q1", "a"), ("q2", "b")]
    assert readers.any_rows(spark, str(p)).count() == 4
    with pytest.raises(readers.SourceError):
        readers.any_rows(spark, "x.csv")


def test_parquet_contract(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0)], "x int, y string, z double").coalesce(1).write.parquet(str(tmp_path / "t"))
    assert readers.parquet(spark, str(tmp_path / "t"), ["y"]).select("locator", "y").first() == ("0", "a")
    with pytest.raises(readers.SourceError, match="missing columns q"):
        readers.parquet(spark, str(tmp_path / "t"), ["q"])


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    pkg = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {pkg}><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Raw</t></si><si><r><t>he</t></r><r><t>llo</t></r></si></sst>")
        z.writestr(
            "xl/worksheets/s.xml",
            f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Out</t></is></c></row>'
            '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>4.5</v></c></row><row r="3"><c r="C3"><v>1</v></c></row></sheetData></worksheet>',
        )


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    rows = readers.workbook(spark, str(tmp_path / "b.xlsx"), "S").orderBy("locator").collect()
    assert [(r.locator, r.cells) for r in rows] == [("S:2", {"Raw": "hello", "Out": "4.5"}), ("S:3", {"Raw": None, "Out": "1"})]


def test_archive_and_manifest(spark, tmp_path):
    p = tmp_path / "a.tar.gz"
    with tarfile.open(p, "w:gz") as t:
        for name, body in (("top/data/x.json", b"{}"), ("top/readme.md", b"hi")):
            i = tarfile.TarInfo(name)
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
    got = readers.archive(spark, str(p), ["data/*.json"]).collect()
    assert [(r.path, r.bytes) for r in got] == [("data/x.json", 2)]
    m = readers.manifest(spark, str(tmp_path))
    assert readers.manifest_changes(m, m).count() == 0
    other = m.withColumn("sha256", F.lit("0"))
    assert readers.manifest_changes(m, other).first().change == "altered"
    assert readers.path_matches("data/a/x.json", ["*.json"]) and not readers.path_matches("a.txt", ["*.json"])


def test_late_header(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text("loading...\n\nname,watts\ncpu,1.5\ngpu,2\n")
    assert [(r.name, r.watts) for r in readers.late_header_csv(spark, str(p), "name").orderBy("locator").collect()] == [("cpu", "1.5"), ("gpu", "2")]


def test_pages(spark, tmp_path):
    for at in (0, 2, 4):
        (tmp_path / f"p{at}.json").write_text(json.dumps({"rows": [{"i": at}, {"i": at + 1}]}))
    spark.dataSource.register(datasources.PagedSource)
    d = spark.read.format("tidewater_pages").option("url", f"file://{tmp_path}/p{{offset}}.json").option("rows", 5).option("page", 2).load()
    assert [(r.locator, json.loads(r.value)["i"]) for r in d.orderBy("locator").collect()] == [(i, i) for i in range(5)]


def wav(samples, rate=16000):
    data = struct.pack(f"<{len(samples)}h", *samples)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\x00"
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + form + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([0, 16384, -32768, 32767] * 2000))
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxx")
    r = {x.path[-5:]: x for x in audio.wav_stats(spark, str(tmp_path)).collect()}
    a = r["a.wav"]
    assert (a.sample_rate, a.frames, a.seconds, a.peak, a.clipping) == (16000, 8000, 0.5, 1.0, 0.5)
    assert r["b.wav"].problem and audio.usable(audio.wav_stats(spark, str(tmp_path)), most_clipping=0.6).count() == 1
    assert audio.wav_samples(spark, str(tmp_path / "a.wav")).first().samples[:2] == [0.0, 0.5]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 2, "x"), ("a", None, "y")], "id string, n int, outcome string")
    sinks.ordered_json_lines(d.coalesce(1), str(tmp_path / "o"), "id")
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.splitlines() == ['{"id":"a","n":null,"outcome":"y"}', '{"id":"b","n":2,"outcome":"x"}']
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.json_lines(d, str(tmp_path / "o"))
    sinks.routed(d, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).where("outcome = 'x'").count() == 1
    files = sinks.stream(d, str(tmp_path / "s"), "id", "1", "row").collect()
    assert all(len(f.sha256) == 64 for f in files)
    assert sorted(r.stream_id for r in spark.read.json(str(tmp_path / "s")).collect()) == ["row-000000001", "row-000000002"]
    sinks.report(spark, {"b": 1, "a": 2}, str(tmp_path / "rep.json"))
    assert json.loads((tmp_path / "rep.json").read_text()) == {"a": 2, "b": 1}
    with pytest.raises(FileExistsError):
        sinks.require_empty(spark, str(tmp_path))
    sinks.require_empty(spark, str(tmp_path / "new"))
    assert sinks.append_new(d, str(tmp_path / "new")) == 2 and sinks.append_new(d.union(spark.createDataFrame([("c", 1, "x")], d.schema)), str(tmp_path / "new")) == 1
    assert sinks.json_lines(d, str(tmp_path / "n")) == 2 and sinks.show_table(d.orderBy("id"), ["id"], 1) == "id\na\n... more than 1 rows"
    assert readers.data_manifest(spark, str(tmp_path / "new"), "outcome").agg(F.sum("records")).first()[0] == 3
    assert sinks.show_table(d.orderBy("id"), ["id", "n"]) == "id\tn\na\t-\nb\t2"
