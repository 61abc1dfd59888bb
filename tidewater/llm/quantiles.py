"""Problem 6: percentiles of very large numeric columns.

A summary holds sorted buffers of K values; a buffer of level l stands for K * 2^l values. Two
buffers of one level collapse into one of the next: their values are merged and every second
one is kept, by turns the odd and the even ones. A collapse moves no rank by more than the
weight of the collapsed values, so the sum of these weights bounds the error of every
percentile. Summaries merge in a tree of fixed fan-in, whatever the pieces were: partitions,
days or earlier merges."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize

#: Values in a buffer. The error is at most levels / (2 K) of the count: 0.2 % at 16 levels,
#: that is at 270 million values of a group.
K = 4096
#: Summaries merged at once.
FAN_IN = 32
PERCENTILES = (0.5, 0.9, 0.95, 0.99)
#: Values of one group that a task collects before it summarises them, and groups it holds.
CHUNK, GROUPS = 16 * K, 2000

STATE = "n bigint, error bigint, lo double, hi double, levels array<int>, vals array<double>"


class Summary:
    def __init__(self, k: int = K):
        self.k, self.n, self.error = k, 0, 0
        self.lo, self.hi = math.inf, -math.inf
        self.loose = np.empty(0)  # fewer than k values of weight 1
        self.full: dict[int, list[np.ndarray]] = {}
        self.turn: dict[int, int] = {}

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.lo, self.hi = min(self.lo, float(values.min())), max(self.hi, float(values.max()))
        self._loose(values)
        self._collapse()

    def _loose(self, values: np.ndarray) -> None:
        # In the order of the values, not of their arrival.
        v = np.sort(np.concatenate((self.loose, values)))
        cut = len(v) // self.k * self.k
        for i in range(0, cut, self.k):
            self.full.setdefault(0, []).append(np.sort(v[i : i + self.k]))
        self.loose = v[cut:]

    def _collapse(self) -> None:
        level = 0
        while self.full and level <= max(self.full):
            at = self.full.get(level, [])
            while len(at) > 1:
                both = np.sort(np.concatenate((at.pop(0), at.pop(0))), kind="stable")
                odd = self.turn[level] = 1 - self.turn.get(level, 1)
                self.full.setdefault(level + 1, []).append(both[odd::2])
                self.error += 1 << level
            level += 1

    def merge(self, other: Summary) -> None:
        self.n += other.n
        self.error += other.error
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        for level, buffers in other.full.items():
            self.full.setdefault(level, []).extend(buffers)
        self._loose(other.loose)
        self._collapse()

    def bound(self) -> int:
        """No reported value's rank is further from the wanted one than this."""
        top = max((lv for lv, b in self.full.items() if b), default=0)
        return self.error + (1 << top) - 1 if self.error else 0

    def percentiles(self, ps: Sequence[float]) -> list[float | None]:
        """By nearest rank; exact while nothing was collapsed. The smallest and the largest
        value are exact always."""
        if not self.n:
            return [None] * len(ps)
        v = [self.loose] + [b for bs in self.full.values() for b in bs]
        w = [np.ones(len(self.loose), np.int64)] + [np.full(self.k, 1 << lv, np.int64) for lv, bs in self.full.items() for _ in bs]
        v, w = np.concatenate(v), np.concatenate(w)
        order = np.argsort(v, kind="stable")
        v, cum = v[order], np.cumsum(w[order])
        out = []
        for p in ps:
            rank = min(max(1, math.ceil(round(p * self.n, 9))), self.n)
            x = float(v[np.searchsorted(cum, rank)])
            out.append(self.lo if rank == 1 else self.hi if rank == self.n else x)
        return out

    def state(self) -> dict:
        lv = sorted(k for k, b in self.full.items() if b)
        levels = [x for x in lv for _ in self.full[x]]
        vals = [self.loose] + [b for x in lv for b in self.full[x]]
        return {"n": self.n, "error": self.error, "lo": self.lo, "hi": self.hi, "levels": levels, "vals": np.concatenate(vals)}

    @classmethod
    def of(cls, row, k: int = K) -> Summary:
        s = cls(k)
        s.n, s.error, s.lo, s.hi = int(row.n), int(row.error), float(row.lo), float(row.hi)
        vals, levels = np.asarray(row.vals, float), np.asarray(row.levels, int)
        loose = len(vals) - k * len(levels)
        s.loose = vals[:loose]
        for i, x in enumerate(levels):
            s.full.setdefault(int(x), []).append(vals[loose + i * k : loose + (i + 1) * k])
        return s


def numeric_leaves(text: str | None) -> dict[str, float]:
    """Dotted paths of the finite numbers in a JSON object, of any depth; positions in arrays
    count as names. Text that is null or no JSON has none; booleans and nulls are no numbers."""
    if not text:
        return {}
    try:
        todo = [("", json.loads(text))]
    except (ValueError, RecursionError):
        return {}
    out: dict[str, float] = {}
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in enumerate(x)]
        elif path and isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x):
            out[path] = float(x)
    return out


def leaves(rows: DataFrame, group: str, json_col: str, piece: str) -> DataFrame:
    """``(grp, piece, metric, value)``, one row for each numeric leaf."""

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g, p, m, v = [], [], [], []
            for grp, day, text in zip(b["grp"], b["piece"], b["j"]):
                for k, x in numeric_leaves(text).items():
                    g.append(grp)
                    p.append(day)
                    m.append(k)
                    v.append(x)
            yield pd.DataFrame({"grp": g, "piece": p, "metric": m, "value": np.array(v, float)})

    r = rows.select(F.col(group).cast("string").alias("grp"), F.col(piece).cast("string").alias("piece"), F.col(json_col).alias("j"))
    return r.mapInPandas(flat, "grp string, piece string, metric string, value double")


def _start(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        done: dict[tuple, Summary] = {}

        def out() -> pd.DataFrame:
            for key, parts in held.items():
                done.setdefault(key, Summary(k)).add(np.concatenate(parts))
            keys = list(done)
            states = [done[x].state() for x in keys]
            held.clear()
            done.clear()
            return pd.DataFrame({"grp": [x[0] for x in keys], "metric": [x[1] for x in keys], "piece": [x[2] for x in keys], **{c: [s[c] for s in states] for c in ("n", "error", "lo", "hi", "levels", "vals")}})

        waiting = 0
        for b in batches:
            b = b[b["value"].notna()]
            for key, x in b.groupby(["grp", "metric", "piece"], dropna=False, sort=False)["value"]:
                key = tuple(None if isinstance(c, float) else c for c in key)
                held.setdefault(key, []).append(x.to_numpy(float))
                waiting += len(x)
            if waiting > CHUNK:
                for key, parts in held.items():
                    done.setdefault(key, Summary(k)).add(np.concatenate(parts))
                held.clear()
                waiting = 0
            if len(held) + len(done) > GROUPS:
                yield out()
                waiting = 0
        if held or done:
            yield out()

    return run


def _merge(keys: Sequence[str], k: int):
    """Merges runs of rows with equal keys; one summary is held at a time."""
    cols = ("n", "error", "lo", "hi", "levels", "vals")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            t = pd.DataFrame([x for x, _ in out], columns=list(keys), dtype=object)
            for c in cols:
                t[c] = [st[c] for _, st in out]
            out.clear()
            return t

        for b in batches:
            ks = list(zip(*[b[c] for c in keys]))
            for x, row in zip(ks, b[list(cols)].itertuples(index=False)):
                if held is not None and x == key:
                    held.merge(Summary.of(row, k))
                    continue
                if held is not None:
                    out.append((key, held.state()))
                key, held = x, Summary.of(row, k)
                if len(out) >= 200:
                    yield frame()
        if held is not None:
            out.append((key, held.state()))
            yield frame()

    return run


def merge_summaries(parts: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """One summary per key. Summaries of one key are merged FAN_IN at a time in as many rounds
    as it takes, so no task merges more than about twice that many of a key, and the order
    within a key is that of the contents, wherever the summaries lay."""
    keys = list(keys)
    kinds = dict(parts.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in keys)
    most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    p = parts.select(*keys, "n", "error", "lo", "hi", "levels", "vals")
    order = ("n", "error", "lo", "hi", "vals")
    while most > 2 * FAN_IN:
        buckets = math.ceil(most / FAN_IN)
        p = p.withColumn("bucket", F.pmod(F.xxhash64("n", "lo", "hi", "vals"), F.lit(buckets)).cast("int"))
        p = p.repartition(*keys, "bucket").sortWithinPartitions(*keys, "bucket", *order)
        p = p.mapInPandas(_merge([*keys, "bucket"], k), f"{head}, bucket int, {STATE}").drop("bucket")
        most = buckets
    p = p.repartition(*keys).sortWithinPartitions(*keys, *order)
    return p.mapInPandas(_merge(keys, k), f"{head}, {STATE}")


def summarise(values: DataFrame, k: int = K) -> DataFrame:
    """``(grp, metric, piece, ...)``: the summary of each piece of each group. ``values`` as from
    :func:`leaves`; null values are left out, null groups and pieces are kept as such."""
    parts = materialize(values.mapInPandas(_start(k), f"grp string, metric string, piece string, {STATE}"), "summaries")
    return merge_summaries(parts, ["grp", "metric", "piece"], k)


def percentiles(summaries: DataFrame, keys: Sequence[str] = ("grp", "metric"), k: int = K, ps: Sequence[float] = PERCENTILES) -> DataFrame:
    """Merge the summaries of all pieces and give n, the percentiles and ``rank_error``: no
    value's rank is off by more than this share of n."""
    keys = list(keys)
    names = [f"p{round(100 * p)}" for p in ps]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [Summary.of(r, k) for r in b.itertuples()]
            q = [x.percentiles(ps) for x in s]
            out = {c: b[c] for c in keys} | {"n": [x.n for x in s]} | {c: [x[i] for x in q] for i, c in enumerate(names)}
            yield pd.DataFrame(out | {"rank_error": [x.bound() / x.n if x.n else 0.0 for x in s]})

    merged = merge_summaries(summaries, keys, k)
    kinds = dict(summaries.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in keys)
    return merged.mapInPandas(run, f"{head}, n bigint, {', '.join(f'{c} double' for c in names)}, rank_error double")


def result_leaves(results: DataFrame) -> DataFrame:
    """The timing leaves of all results, each ``result_id`` once, by day of ``finished_at``."""
    day = F.date_format(F.to_date("finished_at"), "yyyy-MM-dd")
    one = results.where("result_id IS NOT NULL").select("result_id", F.struct("prompt_variant", "timings", day.alias("day")).alias("r"))
    one = one.groupBy("result_id").agg(F.min("r").alias("r")).select("r.*")
    return leaves(one, "prompt_variant", "timings", "day")


def timing_percentiles(results: DataFrame, k: int = K) -> DataFrame:
    """``(prompt_variant, metric, n, p50, p90, p95, p99, rank_error)``; a null variant is a
    group. An empty table gives no rows."""
    return percentiles(materialize(summarise(result_leaves(results), k), "days"), k=k).withColumnRenamed("grp", "prompt_variant")


def percentile_check(results: DataFrame, k: int = 64) -> DataFrame:
    """``(prompt_variant, metric, n, collapsed, within)``: with buffers of only ``k`` values, whether
    anything was collapsed and whether all percentiles lie within the ``rank_error`` they state,
    by exact counts of the values below them."""
    got = materialize(timing_percentiles(results, k), "percentiles")
    ps = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{round(100 * p)}").alias("x")) for p in PERCENTILES])
    asked = got.select(F.col("prompt_variant").alias("g"), F.col("metric").alias("m"), "n", "rank_error", F.inline(ps))
    v = result_leaves(results).groupBy("grp", "metric", "value").agg(F.count(F.lit(1)).alias("c"))
    # Four rows a group on one side.
    j = v.join(asked, F.col("grp").eqNullSafe(F.col("g")) & (F.col("metric") == F.col("m")))
    r = j.groupBy("g", "m", "p").agg(
        F.first("n").alias("n"), F.first("rank_error").alias("e"), F.sum(F.when(F.col("value") < F.col("x"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("x"), F.col("c")).otherwise(0)).alias("upto")
    )
    rank = F.ceil(F.round(F.col("p") * F.col("n"), 9))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return r.groupBy(F.col("g").alias("prompt_variant"), F.col("m").alias("metric")).agg(F.first("n").alias("n"), F.bool_or(F.col("e") > 0).alias("collapsed"), F.bool_and(off <= F.col("e") * F.col("n") + 1e-6).alias("within"))
