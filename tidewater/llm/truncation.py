"""Problem 1: text cut off by field limits.

Per source, histograms of the lengths of a column (characters, bytes, characters before a cut
mark, tokens left of the limit) are tested for spikes at their maximum; texts at a spike or
without terminal punctuation are suspects. Length alone can't tell a cut from an answer that
happens to be as long, nor find texts torn in transfer, so suspects are then checked against
the text they should give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.wordcut import words
from tidewater.llm.answers import CLOSERS, CUT_MARKS, TERMINAL, cut_short
from tidewater.operators.skew import salted_join
from tidewater.session import materialize

#: A spike has at least this many values, this share of its source's, and this many times
#: what the NEAR lengths before it have on average.
LEAST, SHARE, TIMES, NEAR = 5, 0.005, 6.0, 24
#: Of the values of a source, at most this share is longer than a spike "at the maximum".
BEYOND = 0.02
#: So many spikes may be broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_SPIKES = 50_000

LOOKED_AT = ("result_id", "case_id", "run_source", "model_text", "finish_reason", "completion_tokens", "max_output_tokens", "hit_output_token_limit")
_ESCAPED = "".join("\\" + c if not c.isalnum() else c for c in CLOSERS)
ENDS_WELL = rf"[{TERMINAL}][{_ESCAPED}]*$"
CUT = rf"\s*(?:{CUT_MARKS})\s*$"


def measures(text: str = "model_text") -> F.Column:
    """An array of (measure, value) of a row; null values are left out later."""
    t = F.col(text)
    bare = F.regexp_replace(t, CUT, "")
    of = {
        "chars": F.char_length(t),
        "bytes": F.octet_length(t),
        "chars_before_mark": F.when(F.char_length(bare) < F.char_length(t), F.char_length(bare)),
        "tokens_over_limit": F.col("completion_tokens") - F.col("max_output_tokens"),
    }
    return F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("int").alias("value")) for k, v in of.items()])


def length_spikes(results: DataFrame, source: str = "run_source", text: str = "model_text") -> DataFrame:
    """``(source, measure, value, n, usual)``: the lengths at which texts of a source pile up at
    the end of their distribution. Null sources are a source, null texts have no length."""
    h = (
        results.where(F.col(text).isNotNull() & (F.char_length(text) > 0))
        .select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.inline(measures(text)))
        .where("value IS NOT NULL")
        .groupBy("source", "measure", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("source", "measure").orderBy("value")
    whole = Window.partitionBy("source", "measure")
    h = (
        h.withColumn("before", F.coalesce(F.sum("n").over(w.rangeBetween(-NEAR, -1)), F.lit(0)) / F.lit(NEAR))
        .withColumn("longer", F.coalesce(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
        .withColumn("all", F.sum("n").over(whole))
    )
    big = (F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("all")) & (F.col("n") >= TIMES * F.col("before"))
    last = F.col("longer") <= F.greatest(F.lit(1.0), BEYOND * F.col("all"))
    # Of the texts with a cut mark all lengths count as the end; tokens below the limit don't.
    met = (F.col("measure") != "tokens_over_limit") | (F.col("value") >= 0)
    return h.where(big & met & (last | F.col("measure").isin("chars_before_mark"))).select("source", "measure", "value", "n", F.col("before").alias("usual"))


def suspects(results: DataFrame, source: str = "run_source", text: str = "model_text") -> DataFrame:
    """``results`` with ``at_spike`` and ``suspect``: at a spike, or not ended by terminal
    punctuation, or ended by a cut mark, or said to have met its limit."""
    s = materialize(length_spikes(results, source, text).select("source", "measure", "value"), "spikes")
    lists = s.groupBy("source").agg(F.collect_set(F.struct("measure", "value")).alias("__spikes"))
    if s.count() <= BROADCAST_SPIKES:
        lists = F.broadcast(lists)
    t = F.col(text)
    r = results.withColumn("__source", F.coalesce(F.col(source), F.lit(""))).join(lists.withColumnRenamed("source", "__source"), "__source", "left")
    at = F.coalesce(F.size(F.array_intersect(measures(text), "__spikes")) > 0, F.lit(False))
    well = F.coalesce(t.rlike(ENDS_WELL) & ~t.rlike(CUT), F.lit(False))
    said = F.col("completion_tokens") >= F.col("max_output_tokens")
    said = F.coalesce(said, F.lit(False)) | F.coalesce(F.col("hit_output_token_limit"), F.lit(False)) | F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    return r.withColumn("at_spike", at).withColumn("suspect", t.isNotNull() & (F.col("at_spike") | ~well | said)).drop("__source", "__spikes")


def known_cases(*tables: DataFrame) -> DataFrame:
    """``(case_id, raw, expected)``, one row for each id of the given tables of cases."""
    every = None
    for t in tables:
        t = t.select(F.col("id").alias("case_id"), "raw", "expected")
        every = t if every is None else every.union(t)
    return every.where("case_id IS NOT NULL").groupBy("case_id").agg(F.min(F.struct("raw", "expected")).alias("c")).select("case_id", "c.raw", "c.expected")


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, str | None] = {}
    for b in batches:
        out = []
        for text, raw, expected in zip(b.pop("model_text"), b.pop("raw"), b.pop("expected")):
            key = (text, raw, expected)
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                known[key] = cut_short(text, words(expected), words(raw)) if text else None
            out.append(known[key])
        yield b.assign(cut=out)


def _squeezed(c: str) -> F.Column:
    return F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", "")


def cut_results(results: DataFrame, *cases: DataFrame) -> DataFrame:
    """``(result_id, run_source, at_spike, cut)`` of the results whose end is missing; ``cut``
    is ``word`` or ``words``. Results of unknown cases, empty ones and those that give another
    text than their case's are left out; re-delivered results count once."""
    s = suspects(results.where("result_id IS NOT NULL").select(*LOOKED_AT)).where("suspect")
    # Written, as it is counted for hot cases before it is joined.
    s = materialize(s.select("result_id", "case_id", "run_source", "model_text", "at_spike").dropDuplicates(["result_id"]), "suspects")
    j = salted_join(s, known_cases(*cases), "case_id", "result_id", "inner")
    # An answer with the letters and digits of the wanted text is whole.
    j = j.where(~F.coalesce((_squeezed("model_text") == _squeezed("expected")) & ~F.col("model_text").rlike(r"[&\\\\%<\uFFFD]"), F.lit(False)))
    out = "result_id bigint, run_source string, at_spike boolean, cut string"
    c = j.select("result_id", "run_source", "at_spike", "model_text", "raw", "expected").mapInPandas(_check, out)
    return c.where("cut IS NOT NULL")


def truncation_report(results: DataFrame, *cases: DataFrame) -> DataFrame:
    """Per source: results, truncated ones and their rate; what spikes alone give (results at a
    spike length without terminal punctuation), how many of these are truncated and which share
    of the truncated they find; and how many results the limit flag names, and rightly."""
    cut = cut_results(results, *cases).select("result_id", F.lit(True).alias("cut"))
    spike = suspects(results.where("result_id IS NOT NULL").select(*LOOKED_AT))
    by_spike = F.col("at_spike") & ~F.coalesce(F.col("model_text").rlike(ENDS_WELL), F.lit(False))
    one = spike.groupBy("result_id").agg(
        F.first("run_source").alias("run_source"), F.bool_or("hit_output_token_limit").alias("flag"), F.bool_or(by_spike).alias("by_spike")
    )
    j = one.join(cut, "result_id", "left")
    is_cut, n = F.col("cut").isNotNull(), F.count(F.lit(1))
    return j.groupBy("run_source").agg(
        n.alias("results"),
        F.count_if(is_cut).alias("truncated"),
        (F.count_if(is_cut) / n).alias("rate"),
        F.count_if("by_spike").alias("by_spike_alone"),
        F.count_if(F.col("by_spike") & is_cut).alias("truncated_at_spike"),
        F.try_divide(F.count_if(F.col("by_spike") & is_cut), F.count_if(is_cut)).alias("spike_recall"),
        F.try_divide(F.count_if(F.col("by_spike") & is_cut), F.count_if("by_spike")).alias("spike_precision"),
        F.count_if(F.col("flag")).alias("flagged"),
        F.count_if(F.col("flag") & is_cut).alias("flagged_truncated"),
    )
