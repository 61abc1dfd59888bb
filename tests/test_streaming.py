import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tidewater.streaming import folds, queries


def run(spark, tmp_path, schema, batches, key, order, fold):
    """Feed the batches one by one and give all outputs."""
    src = tmp_path / "in"
    src.mkdir()
    name = "q" + uuid.uuid4().hex
    d = spark.readStream.schema(schema).json(str(src))
    q = folds.folded(d, key, order, fold).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, b in enumerate(batches):
            (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in b))
            q.processAllAvailable()
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_transcript(spark, tmp_path):
    rows = [
        [{"id": "a", "seq": 2, "kind": "eou", "text": ""}, {"id": "a", "seq": 1, "kind": "delta", "text": "Hello"}, {"id": "b", "seq": 1, "kind": "delta", "text": "x"}],
        [{"id": "a", "seq": 3, "kind": "delta", "text": " there"}, {"id": "b", "seq": 2, "kind": "cancel", "text": None}],
        [{"id": "a", "seq": 4, "kind": "eou", "text": None}, {"id": "a", "seq": 5, "kind": "eou", "text": None}, {"id": "a", "seq": 6, "kind": "end", "text": None}, {"id": "b", "seq": 3, "kind": "delta", "text": "new"}],
    ]
    out = run(spark, tmp_path, "id string, seq long, kind string, text string", rows, "id", "seq", folds.TRANSCRIPT)
    assert [x for x in out if x[0] == "a"] == [("a", "Hello", [], False), ("a", "Hello there", [5], False), ("a", "Hello there", [5, 11], True)]
    assert [x[1] for x in out if x[0] == "b"] == ["x", "new"]


def test_levels(spark, tmp_path):
    loud = [0.8 * math.sin(i) for i in range(400)]
    rows = [[{"id": "m", "seq": 1, "samples": loud}], [{"id": "m", "seq": 2, "samples": [0.0] * 400}, {"id": "m", "seq": 3, "samples": []}]]
    out = run(spark, tmp_path, "id string, seq long, samples array<double>", rows, "id", "seq", folds.LEVEL)
    want, s = [], (0.0, 0.0, 0.0)
    for chunk in (loud, [0.0] * 400, []):
        s = folds.level(s, chunk)
        want.append(s[2])
    assert [x[2] for x in out] == pytest.approx(want) and want[0] > want[1] > 0 and want[2] == want[1]
    assert folds.level((0.0, 0.0, 0.02), [0.0] * 10)[2] == 0.0


def test_response(spark, tmp_path):
    body = ': hi\r\ndata: {"choices": [{"delta": {"content": "He"}}]}\n\ndata: {"choices": [{"delta": {"content": "y"}, "finish_reason": "stop"}]}\n\ndata: {"choices": [], "usage": {"completion_tokens": 2}}\n\ndata: [DONE]\n'
    rows = [[{"id": "r", "at_ms": i, "chunk": body[k : k + 9], "last": k + 9 >= len(body)}] for i, k in enumerate(range(0, len(body), 9))]
    out = run(spark, tmp_path, "id string, at_ms long, chunk string, last boolean", [sum(rows[:7], []), sum(rows[7:], [])], "id", "at_ms", folds.RESPONSE)
    assert len(out) == 1 and out[0][1:4] == ("Hey", "stop", 2) and out[0][4] > 0


def test_sse_framing():
    rest, fields, done = folds.sse_payloads("", [], "data: a\ndata:  b\n\ndata\n\nda")
    assert done == ["a\nb", ""] and rest == "da"
    assert folds.sse_payloads(rest, fields, "ta:c", True)[2] == ["c"]


def test_history_rate_growth():
    f = folds.history(2)
    row = lambda **k: type("R", (), k)
    s = f.start
    for t in "abc":
        s, _ = f.step(s, row(kind="add", text=t))
    assert s == (["c", "b"],)
    s, out = f.step(s, row(kind="undo", text=None))
    assert out == [("c", True)] and s == (["b"],)
    t = folds.throttled(50)
    s, kept = t.start, []
    for ms in (0, 10, 49, 50, 90, 130):
        s, o = t.step(s, row(at_ms=ms, text="x"))
        kept += [x[0] for x in o]
    assert kept == [0, 50, 130]
    g = folds.growth()
    s, a = g.step(g.start, row(bytes=10, status="running"))
    s, b = g.step(s, row(bytes=25, status="completed"))
    assert a == [(10, 10, "running")] and b == [(25, 15, "completed")] and s is None


def test_budget(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    b = queries.Budget(25)
    q = b.watch(queries.result_lines(spark, str(src)), str(tmp_path / "cp"))
    try:
        (src / "a.jsonl").write_text('{"case_id": "x", "prompt_tokens": 10, "completion_tokens": 5}\n{"case_id": "y", "prom')
        q.processAllAvailable()
        assert (b.records, b.used, b.spent) == (1, 15, False)
        (src / "b.jsonl").write_text('{"case_id": "z", "completion_tokens": 12}\n')
        q.processAllAvailable()
        assert (b.used, b.spent) == (27, True)
    finally:
        q.stop()


def test_windows(spark, tmp_path):
    spark.createDataFrame([(1, "2026-01-01 00:00:10", 1.0), (1, "2026-01-01 00:00:50", 2.0), (2, "2026-01-01 00:02:10", 4.0)], "k int, t string, value double").select("k", F.to_timestamp("t").alias("ts"), "value").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("k int, ts timestamp, value double").parquet(str(tmp_path / "e"))
    q = queries.windowed(s, "ts", "1 minute", "1 minute", "k").writeStream.format("memory").queryName("w1").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n, r.total) for r in spark.table("w1").collect()) == [(1, 2, 3.0), (2, 1, 4.0)]
