"""Folds over ordered rows: packing and batching. What a row starts depends on the rows before
it, so a fold runs over one shard in order; shards are independent and bounded by their number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(df: DataFrame, shard: str, order: str, step, out: str) -> DataFrame:
    """Run ``step`` over each shard's rows in order, as a stream: nothing but the fold's state is
    held. ``step(state, row) -> (state, values)``."""
    names = [x.strip().split(" ")[0] for x in out.split(",")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for b in batches:
            vals = []
            for row in b.itertuples(index=False):
                s = getattr(row, shard)
                if s != at:
                    at, state = s, None
                state, v = step(state, row)
                vals.append(v)
            for i, n in enumerate(names):
                b[n] = [v[i] for v in vals]
            yield b

    d = df.repartition(shard).sortWithinPartitions(shard, order)
    return d.mapInPandas(run, f"{kinds}, {out}")


def packed(df: DataFrame, length: str, most: int, shard: str = "shard", order: str = "ordinal") -> DataFrame:
    """Adds ``pack``, ``segment`` (position in the pack) and ``start`` (tokens before): rows fill
    a pack until the next doesn't fit; none is cut. A row longer than a pack fails; a null length
    counts as 0."""

    def step(s, row):
        n = getattr(row, length)
        n = 0 if n is None or n != n else int(n)
        if n > most:
            raise ValueError("a row is longer than a pack")
        pack, seg, used = s or (0, 0, 0)
        if used and used + n > most:
            pack, seg, used = pack + 1, 0, 0
        return (pack, seg + 1, used + n), (pack, seg, used)

    return _fold(df, shard, order, step, "pack bigint, segment int, start bigint")


def packing_report(p: DataFrame, length: str, most: int) -> DataFrame:
    one = p.groupBy("shard", "pack").agg(F.count(F.lit(1)).alias("rows"), F.sum(length).alias("tokens"))
    return one.agg(
        F.count(F.lit(1)).alias("packs"), F.sum("rows").alias("examples"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count(F.lit(1)) * most)).alias("utilization"),
    )


def batched(df: DataFrame, length: str, cap: str, most_rows: int, most_tokens: int, shard: str = "shard", order: str = "ordinal") -> DataFrame:
    """Adds ``batch``: rows of one cap, at most ``most_rows``, padded to the longest within
    ``most_tokens``."""

    def step(s, row):
        n, c = int(getattr(row, length)), getattr(row, cap)
        batch, rows, longest, has = s or (0, 0, 0, c)
        if rows and (c != has or rows >= most_rows or max(longest, n) * (rows + 1) > most_tokens):
            batch, rows, longest = batch + 1, 0, 0
        return (batch, rows + 1, max(longest, n), c), (batch,)

    return _fold(df, shard, order, step, "batch bigint")
