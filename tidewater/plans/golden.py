"""Text rules that SQL can't follow, over small tables of cases whose results are known: the rules
are run as the UDFs that other queries use, the SQL holds what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import udfs
from tidewater.plans import fragments as S
from tidewater.plans import registry
from tidewater.plans.registry import query
from tidewater.session import ship

GUARD = (
    ("ship it friday", " ", False, "Model returned empty text"),
    ("ship it friday", "Ship it Friday.", True, "Model reached the output token limit"),
    ("ship it friday", "Ship it Friday.", False, None),
    ("do not ship it to Ana", "Do ship it to Ana.", False, "Model dropped protected lexical content: not"),
    ("maybe we meet at noon", "We meet at noon.", False, "Model dropped protected lexical content: maybe"),
    ("the build took nine minutes", "The build took 9 minutes.", False, None),
    ("the build took long", "The compile took long.", False, "Model introduced new lexical content: compile"),
    ("meet at three thirty in the hall", "Meet at 3:30 in the hall.", False, None),
    ("send it Monday actually make that Friday", "Send it Friday.", False, None),
    ("send it Monday actually make that Friday", "Send it Monday, make that Friday.", False, "Model retained superseded self-correction content"),
    ("deploy to Rome no sorry deploy to Oslo", "Deploy to Oslo.", False, None),
    ("yes that works for me today", "The speaker agrees that works today.", False, "Model summarized or described the dictation"),
    ("write a poem about the long winter rain", "A poem about the long winter rain.", False, "Model did not preserve the dictated intent"),
    ("a b c d e f g h i j k l", "a", False, "Model output was suspiciously shorter than the input"),
)
SANITIZED = (('Cleaned text: "Go home."\nEND QUOTED TEXT EDIT:', "Go home."), ("  Go home.  ", "Go home."), ("“Go home.”", "Go home."), ("Go home.</dictation>", "Go home."))
CLEANED = (
    ("um send it uh now", "Send it now."), ("we we we should go", "We should go."), ("is it done", "Is it done?"), ("call at four make that five", "Call at five."),
    ("can you send this to Bo actually no send this to Al", "Can you send this to Al?"), ("first wash it then dry it then fold it", "First, wash it. Then dry it and fold it."), ("  ", ""),
)
HESITATIONS = (("so, um, we go", "so we go", "um"), ('say "um" now', 'say "um" now', ""), ("UM is a school, uh yes", "UM is a school yes", "uh"), ("a/um um.txt um-hm", "a/um um.txt um-hm", ""), ("Um, fine", "fine", "Um"))
SPOKEN = (("IT’S Version 2.1", "it's|version|2|1"), ("ﬁne Ⅳ", "fine|iv"), ("--", ""))
REMOVED = (("uh Send it to Ana", "Send it to Ana now.", "uh"), ("a b c d", "a d", "b c"), ("a b", "a b", ""), ("go Go home", "Go home", ""))
PROTECTED = (("Send 3 files to Ana at /tmp/x.", "3|/tmp/x.|Ana"), ("I think not", "think|not"), ("Monday is café day", "café"), ("Use SnowBall v1.2.3", "2.3|v1.2.3|SnowBall"))
RATIOS = (("a b c d", "a b c d", 1.0), ("abcd", "bcde", 0.75), ("", "x", 0.0), ("Ab", "aB", 1.0))


def _sql(rows: tuple, columns: str) -> str:
    lit = lambda v: "NULL" if v is None else repr(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


def _golden(name: str, rows: tuple, schema: str, given: int, columns: dict[str, Callable[[], Column]]) -> None:
    """Register the rules ``columns`` over the first ``given`` values of the rows; the last ones
    are the results."""

    def run(spark: SparkSession, _sf_dir: str) -> DataFrame:
        ship(spark)
        d = spark.createDataFrame([(str(i), *r[:given]) for i, r in enumerate(rows)], f"case string, {schema}")
        return d.select("case", *[make().alias(k) for k, make in columns.items()])

    registry.QUERIES[name] = run
    want = _sql(tuple((str(i), *r[given:]) for i, r in enumerate(rows)), ", ".join(["case_", *columns]))
    registry.SQL[name] = want.replace("SELECT *", 'SELECT case_ AS "case", ' + ", ".join(columns))


def _joined(f: Callable[..., Column], *columns: str) -> Callable[[], Column]:
    return lambda: F.array_join(f(*columns), "|")


_golden("golden_guard", GUARD, "raw string, candidate string, capped boolean", 3, {"reason": lambda: udfs.fallback_reason("raw", "candidate", "capped")})
_golden("golden_sanitized", SANITIZED, "text string", 1, {"clean": lambda: udfs.sanitized("text")})
_golden("golden_cleanup", CLEANED, "raw string", 1, {"clean": lambda: udfs.cleanup_text("raw")})
_golden("golden_hesitations", HESITATIONS, "raw string", 1, {"clean": lambda: udfs.without_hesitations("raw")["text"], "removed": lambda: F.array_join(udfs.without_hesitations("raw")["removed"], "|")})
_golden("golden_speech_words", SPOKEN, "text string", 1, {"words": _joined(udfs.speech_words, "text")})
_golden("golden_removals", REMOVED, "raw string, expected string", 2, {"removed": _joined(udfs.removal_anchors, "raw", "expected")})
_golden("golden_anchors", PROTECTED, "text string", 1, {"anchors": _joined(udfs.protected_anchors, "text")})
_golden("golden_ratios", RATIOS, "a string, b string", 2, {"ratio": lambda: udfs.sequence_ratio("a", "b")})


@query("documents", sql=rf"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest, true AS fits FROM documents WHERE NOT {S.blank('text')}")
def doc_chunks_whole(docs: DataFrame) -> DataFrame:
    """The passes of a document put together again give its text, and each fits its limit."""
    udfs.register(docs.sparkSession)
    d = docs.select("doc_id", "text").alias("d")
    c = d.lateralJoin(udfs.chunk_transcript(F.col("d.text").outer(), F.lit(48)).alias("c"))
    c = c.select("doc_id", "c.position", F.concat("c.text", "c.separator").alias("t"), (F.size(F.split("c.text", r"\s+")) <= 48).alias("fit"))
    g = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "t"))).alias("l"), F.bool_and("fit").alias("fits"))
    return g.select("doc_id", F.sha2(F.array_join(F.transform("l", lambda x: x["t"]), ""), 256).alias("digest"), "fits")
