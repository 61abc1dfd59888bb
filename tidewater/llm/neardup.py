"""Problem 2: near-duplicate records with small edits.

A record is the set of its distinct words. Its fingerprint has one parity bit per hashed word
class, so two fingerprints differ in at most as many bits as the sets in words, and a Jaccard
threshold is a Hamming budget that loses no pair. The binary trie self-join runs on these
fingerprints. As a trie over a whole collection would visit nearly all pairs of its upper
nodes at budgets of this size, its top is a word that two similar sets must share among their
rarest words (prefix filter): as many signatures as a set has rarest words. Subtrees of one
word are joined on their own, and the subtree of a hot word is cut into tiles. Every surviving
pair is checked exactly. Equal sets are one class and are joined once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.wordcut import words
from tidewater.llm.trie import DEPTH, SIGNED, Budget, signature_join
from tidewater.operators.components import connected_components
from tidewater.session import materialize

BITS = 128
#: Word frequencies are counted in this many hashed classes; that bounds what is broadcast
#: (8 bytes each). A class that holds a frequent word only makes signatures more specific.
CLASSES = 1 << 18
MIN_WORDS, NUM, DEN = 8, 7, 10


class _Hasher(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w) & 0x7FFFFFFFFFFFFFFF
        return h


def word_sets(records: DataFrame, id_col: str, text_cols: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, key, words)``: the sorted word hashes of each record with enough distinct words;
    ``key`` identifies the set. Null texts have no words; records with a null id fall out."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = _Hasher()
        for b in batches:
            ids, keys, sets = [], [], []
            for i, *texts in zip(b["__id"], *[b[f"__t{k}"] for k in range(len(text_cols))]):
                s: set[str] = set()
                for t in texts:
                    if isinstance(t, str):
                        s.update(words(t))
                if len(s) >= min_words:
                    a = np.array(sorted([h[w] for w in s]), dtype=np.int64)
                    ids.append(i)
                    sets.append(a)
                    keys.append(xxhash.xxh3_64_intdigest(a.tobytes()) - (1 << 63))
            yield pd.DataFrame({"id": ids, "key": np.array(keys, np.int64), "words": sets})

    kind = dict(records.dtypes)[id_col]
    r = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), *[F.col(c).cast("string").alias(f"__t{k}") for k, c in enumerate(text_cols)]
    )
    return r.mapInPandas(cut, f"id {kind}, key bigint, words array<bigint>")


def class_counts(classes: DataFrame, n: int = CLASSES) -> np.ndarray:
    """How often the words of each hashed class occur, over all sets; ``n`` numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(n, np.int64)
        for b in batches:
            if len(b):
                c += np.bincount(np.concatenate(b["words"].to_numpy()) % n, minlength=n)
        k = np.flatnonzero(c)
        yield pd.DataFrame({"k": k, "n": c[k]})

    total = classes.select("words").mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n, np.int64)
    out[total["k"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    return out


def fingerprints(flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS/16) parity fingerprints of the sets given as flat words and their rows."""
    bit = (flat.view(np.uint64) >> np.uint64(20)).astype(np.int64) % BITS
    odd = np.bincount(row * BITS + bit, minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint16)


def prefix_lengths(s: int, num: int, den: int) -> tuple[int, int]:
    """Of a set of s words, how many of its rarest must be looked at to share a word with any
    similar set: where that set is as large or larger, and where it is smaller."""
    least = lambda t: -(-num * (s + t) // (den + num))
    return min(s, s - least(s) + 1), min(s, s - least(-(-num * s // den)) + 1)


def _signatures(counts_ref, budget: Budget):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = counts_ref.value
        for b in batches:
            if not len(b):
                continue
            sets = b["words"].to_numpy()
            n = np.array([len(x) for x in sets], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            flat = np.concatenate(sets).astype(np.int64)
            halves = fingerprints(flat, row, len(n)).view(np.int64)
            seen = counts[flat % len(counts)]
            order = np.lexsort((flat, seen, row))
            flat, seen = flat[order], seen[order]
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            # With the words that may be the second or third shared one. A word that one set alone
            # has joins nothing.
            i = np.flatnonzero((pos < (budget.prefixes(n)[1] + DEPTH - 1)[row]) & (seen > 1))
            at = np.searchsorted(row[i], np.arange(len(n) + 1)).tolist()

            def packed(x: np.ndarray) -> list[bytes]:
                whole, k = x.tobytes(), x.itemsize
                return [whole[k * p : k * q] for p, q in zip(at, at[1:])]

            out = {"key": b["key"], "size": n.astype(np.int32), "p0": halves[:, 0], "p1": halves[:, 1]}
            yield pd.DataFrame(out | {"sigs": packed(flat[i]), "pos": packed(pos[i].astype(np.int32)), "seen": packed(np.minimum(seen[i], 2**31 - 1).astype(np.int32))})

    return emit


def class_pairs(classes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """``(a, b)`` with a < b: keys of all classes ``(key, words)`` of different sets whose
    Jaccard similarity is at least num/den."""
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(class_counts(classes))
    budget = Budget(num, den)
    near = signature_join(classes.select("key", "words").mapInPandas(_signatures(counts, budget), SIGNED), budget)
    left = classes.select(F.col("key").alias("a"), F.col("words").alias("wa"))
    right = classes.select(F.col("key").alias("b"), F.col("words").alias("wb"))
    both = near.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(den * shared >= num * (F.size("wa") + F.size("wb") - shared)).select("a", "b")


def _classes(records: DataFrame, id_col: str, text_cols: list[str], min_words: int) -> tuple[DataFrame, DataFrame]:
    sets = materialize(word_sets(records, id_col, text_cols, min_words), "sets")
    classes = materialize(sets.groupBy("key").agg(F.first("words").alias("words")), "classes")
    return sets.select("id", "key").distinct(), classes


def near_pairs(records: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("raw", "expected"), min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, for all pairs of records with at least ``min_words``
    distinct words in each and a Jaccard similarity of at least num/den, equal sets included.
    Empty and null texts have no words and pair with nothing; a repeated id counts once."""
    member, classes = _classes(records, id_col, list(text_cols), min_words)
    member = materialize(member, "members")
    pairs = class_pairs(classes, num, den)
    twins = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"))
    pairs = pairs.union(twins)
    x = member.select(F.col("key").alias("a"), F.col("id").alias("x"))
    y = member.select(F.col("key").alias("b"), F.col("id").alias("y"))
    # An id that came with two texts isn't its own partner.
    out = pairs.join(x, "a").join(y, "b").where("x <> y AND (a <> b OR x < y)")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_groups(records: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("raw", "expected"), min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``(id, group_id, copies, links)`` for every record with a partner: the smallest id of its
    group, how many records have exactly its words, and how many other classes it is similar
    to. Copies are not expanded into pairs."""
    member, classes = _classes(records, id_col, list(text_cols), min_words)
    member = materialize(member, "members")
    pairs = materialize(class_pairs(classes, num, den), "pairs")
    comps = connected_components(pairs, "a", "b").withColumnRenamed("node", "key")
    links = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    size = member.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    about = (
        size.join(comps, "key", "left")
        .join(links, "key", "left")
        .where("component IS NOT NULL OR copies > 1")
        .select("key", "copies", "least", F.coalesce("component", "key").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    about = materialize(about, "about")
    first = about.groupBy("component").agg(F.min("least").alias("group_id"))
    return member.join(about, "key").join(first, "component").select("id", "group_id", "copies", "links")
