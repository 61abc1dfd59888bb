"""Problem 3: broken prompt and response pairs.

Ordered rules for emptiness, missing ends, refusals, copies of the prompt and other languages
or scripts look at every result beside its case; each triggered defect is given."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import pair_rules as rules
from tidewater.llm.truncation import LOOKED_AT, _squeezed, known_cases, suspects
from tidewater.operators.skew import salted_join
from tidewater.session import materialize

PAIR = "result_id bigint, run_source string, defects array<string>"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, list[str]] = {}
    for b in batches:
        out = []
        for key in zip(b["model_text"], b["expected"], b["raw"], b["suspect"]):
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                text, expected, raw, suspect = key
                known[key] = rules.defects(text, expected, raw, check_end=bool(suspect))
            out.append(known[key])
        yield pd.DataFrame({"result_id": b["result_id"], "run_source": b["run_source"], "defects": out})


def defective_pairs(results: DataFrame, *cases: DataFrame) -> DataFrame:
    """``(result_id, run_source, defects)`` for each result with a defect, in the order of the
    rules; the last two, ``copied_prefix`` and ``unclosed`` (a bracket or quotation mark that
    stays open though the case leaves none open), don't make a result unusable. Results of
    unknown cases can be empty, refusals or unclosed only; re-delivered results count once."""
    s = suspects(results.where("result_id IS NOT NULL").select(*LOOKED_AT)).select("result_id", "case_id", "run_source", "model_text", "suspect")
    s = materialize(s.dropDuplicates(["result_id"]), "answers")
    # A null case meets nothing, so its results needn't gather in one partition of the join.
    j = salted_join(s.where("case_id IS NOT NULL"), known_cases(*cases), "case_id", "result_id", "left")
    none = F.lit(None).cast("string")
    j = j.unionByName(s.where("case_id IS NULL").withColumns({"raw": none, "expected": none}))
    # An answer with the letters and digits of the wanted text can only leave a bracket open.
    same = F.coalesce((_squeezed("model_text") == _squeezed("expected")) & (_squeezed("model_text") != ""), F.lit(False))
    odd = j.where(~same | F.col("model_text").rlike(r"[(\[{“«„]"))
    d = odd.select("result_id", "run_source", "model_text", "expected", "raw", "suspect").mapInPandas(_judge, PAIR)
    return d.where(F.size("defects") > 0)


def first_defects(results: DataFrame, *cases: DataFrame) -> DataFrame:
    """``(result_id, defect)``: the first defect of each unusable result."""
    d = defective_pairs(results, *cases).select("result_id", F.col("defects")[0].alias("defect"))
    return d.where(~F.col("defect").isin(*rules.SLIGHT))


def defect_report(results: DataFrame, *cases: DataFrame) -> DataFrame:
    """Results per source and defect, each triggered defect counted."""
    d = defective_pairs(results, *cases)
    return d.select("run_source", F.explode("defects").alias("defect")).groupBy("run_source", "defect").agg(F.count(F.lit(1)).alias("results"))
