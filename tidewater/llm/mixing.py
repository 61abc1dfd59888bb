"""Problem 8: mix sources to target weights, measured in tokens.

Every document gets a hash-random key; within a source the keys are range-sorted and token
counts summed up by distributed prefix sums; each source is cut at its exact budget. A source
smaller than its budget is repeated, at most ``max_repeats`` times."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.prefix import prefix_sums, unit_hash
from tidewater.session import materialize

#: A public byte-level BPE vocabulary; any file of the same form will do.
TOKENIZER = os.environ.get("TIDEWATER_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


#: In place of a tokenizer: sizes are counted in bytes.
BYTES = "bytes"


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens)``; a null or empty text has no tokens. Whole texts are
    encoded, special-token strings as ordinary text. The vocabulary is sent from the driver to
    the executors. ``bytes`` for a tokenizer counts bytes instead."""
    if tokenizer == BYTES:
        return docs.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("tokens"))
    if not os.path.exists(tokenizer):
        raise FileNotFoundError(f"no tokenizer at {tokenizer}; set TIDEWATER_TOKENIZER or pass its path")
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(SparkFiles.get(name))
        t.encode_special_tokens = True
        t.no_truncation()
        for b in batches:
            texts = b.pop("text").fillna("").tolist()
            n: list[int] = []
            # Small batches: the encodings of very long texts take memory.
            for i in range(0, len(texts), 64):
                n += [len(e) for e in t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
            yield b.assign(tokens=n)

    return docs.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: its size in tokens, the mix's total, the budget, the number of whole
    rounds through the source and the tokens of the last, partial one. Sources are compared
    exactly; a source without documents has size 0."""
    t = targets.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    total = t.groupBy("mix_id").agg((F.sum("size") * F.first("budget_ratio")).alias("total"))
    t = t.join(total, "mix_id").withColumn("budget", F.col("target_share") * F.col("total"))
    room = F.least(F.col("budget"), (F.col("max_repeats") * F.col("size")).cast("double"))
    t = t.withColumn("room", room).withColumn("rounds", F.coalesce(F.floor(F.try_divide(F.col("room"), F.col("size"))), F.lit(0)).cast("int"))
    return t.withColumn("rest", F.greatest(F.col("room") - F.col("rounds") * F.col("size"), F.lit(0.0)))


def _sized(docs: DataFrame, targets: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    counted = materialize(token_counts(docs, tokenizer), "tokens")
    sizes = counted.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("size"))
    return counted, budgets(sizes, targets)


def short_sources(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(mix_id, source)``: sources whose documents, all of them cut in as often as allowed,
    don't reach their budget in the mix."""
    return mix_report(docs, targets, tokenizer).where("falls_short").select("mix_id", "source").distinct()


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: str = "mix") -> DataFrame:
    """``(mix_id, source, doc_id, repeats, tokens)``: each document of a mix with how often it
    is used. Whole rounds take every document; of the last round those whose prefix sum stays
    within the rest. Documents of other or null sources are in no mix."""
    return _cut(*_sized(docs, targets, tokenizer), seed)


def _cut(counted: DataFrame, b: DataFrame, seed: str) -> DataFrame:
    # One row per target, which doesn't grow with the documents.
    b = b.select("mix_id", "source", "rounds", "rest")
    d = counted.where("doc_id IS NOT NULL").join(b, "source").withColumn("u", unit_hash("mix_id", "doc_id", salt=seed))
    d = prefix_sums(materialize(d, "mixed"), ["mix_id", "source"], "u", "doc_id", "tokens")
    extra = (F.col("before") + F.col("tokens") <= F.col("rest")) & (F.col("rest") > 0)
    d = d.withColumn("repeats", F.col("rounds") + extra.cast("int"))
    return d.where("repeats > 0").select("mix_id", "source", "doc_id", "repeats", "tokens")


def mix_report(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: str = "mix") -> DataFrame:
    """Per mix and source the tokens wanted and reached and both shares."""
    counted, b = _sized(docs, targets, tokenizer)
    b = materialize(b, "budgets")
    got = _cut(counted, b, seed).groupBy("mix_id", "source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("reached"), F.max("repeats").alias("most_repeats"))
    full = got.groupBy("mix_id").agg(F.sum("reached").alias("of"))
    r = F.coalesce("reached", F.lit(0))
    return b.join(got, ["mix_id", "source"], "left").join(full, "mix_id", "left").select(
        "mix_id", "source", "target_share", F.col("size").alias("source_tokens"), F.col("budget").alias("wanted_tokens"), r.alias("reached_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.try_divide(r, F.col("of")).alias("share_reached"),
        # All there is was used to the full and the budget isn't reached.
        ((r >= F.col("max_repeats") * F.col("size")) & (r < F.col("budget"))).alias("falls_short"),
    )
