"""Problem 7: evaluation texts leaking into training text.

Items and documents are cut into words and canonicalised: numbers, codes and units, and in a
second form names as well, become typed placeholders. Windows of template words are joined by
hash. A pair of windows of one template is an exact passage where all words agree, and a
re-parameterised question where the placeholders differ but repeat in the same places and, over
all windows of the document and the item, one value always stands for the same other one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.wordcut import WORD, words
from tidewater.session import materialize

WINDOW = 8
#: Words of a template that must not be placeholders for a re-parameterised hit.
LITERALS = 5
#: Distinct templates of items that are broadcast (8 bytes each); beyond it the windows of the
#: documents are joined by a shuffle instead.
BROADCAST_WINDOWS = 1_000_000

# Units of measure, money and time of the four languages.
UNITS = frozenset(
    "euro euros dollar dollars dólares pesos cents cent pounds francs "
    "seconds second minutes minute hours hour days day weeks week milliseconds "
    "sekunden minuten stunden tage wochen segundos minutos horas días semanas secondes heures jours semaines "
    "kilobytes megabytes gigabytes meters metres kilometers grams kilos liters litres percent prozent".split()
)

_P = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def _h(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


NUMBER, CODE, NAME, UNIT = (_h(f"<{k}>") for k in ("number", "code", "name", "unit"))


class Canonical:
    """Hashes of words and of their templates: (word, plain template, template with names). The
    plain template depends on the word alone, so an exact passage always meets in it, however a
    document writes it. A name is told by its capital inside a sentence."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, bool], tuple[int, int, int]] = {}

    def word(self, w: str, capital: bool) -> tuple[int, int, int]:
        got = self.known.get((w, capital))
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            h = _h(w)
            if w.isdigit():
                t = NUMBER
            elif any(c.isdigit() for c in w):
                t = CODE
            elif w in UNITS:
                t = UNIT
            else:
                t = h
            got = self.known[w, capital] = (h, t, NAME if capital and t == h else t)
        return got

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(3, words) hashes and the number of the text of each word."""
        out: list[tuple[int, int, int]] = []
        n = []
        for t in texts:
            ws = words(t)
            out += [self.word(w, c) for w, c in zip(ws, capitals(t, ws))]
            n.append(len(ws))
        return np.array(out, np.uint64).reshape(-1, 3).T, np.repeat(np.arange(len(texts)), n)


def capitals(text: str | None, ws: list[str]) -> list[bool]:
    """Whether each word is written with a capital and doesn't open a sentence. All False
    where the words of the raw text can't be matched to the folded ones."""
    if not ws:
        return []
    out: list[bool] = []
    end = 0
    assert text is not None
    for m in WORD.finditer(text):
        between = text[end : m.start()]
        opens = end == 0 or any(c in ".!?\n:" for c in between)
        out.append(m.group()[0].isupper() and not opens)
        end = m.end()
    return out if len(out) == len(ws) else [False] * len(ws)


def windows(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window of one text: where it starts, and (3, windows) hashes of its words, of its
    plain template and of its template with names."""
    n = hashes.shape[1] - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty((3, 0), np.uint64), np.empty((3, 0), np.uint64)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    out = np.zeros((3, len(at)), np.uint64)
    for k in range(WINDOW):
        out += hashes[:, at + k] * _P[k]
    out[2] ^= np.uint64(0x5851F42D4C957F2D)  # the two kinds of templates don't meet
    return at, out, hashes


def slots(hashes: np.ndarray, at: np.ndarray, kind: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of windows and a kind of template (1 plain, 2 with names): a hash of which placeholders
    hold equal values, 0 where the template has too few words of its own, and those values."""
    full, tmpl = hashes[0], hashes[kind]
    filled = np.stack([tmpl[at + k] != full[at + k] for k in range(WINDOW)], 1)
    vals = np.stack([full[at + k] for k in range(WINDOW)], 1)
    first = np.full(filled.shape, 255, np.uint64)
    for k in range(WINDOW - 1, -1, -1):
        for j in range(k, -1, -1):
            same = filled[:, k] & filled[:, j] & (vals[:, k] == vals[:, j])
            first[same, k] = j
    out = np.ones(len(at), np.uint64)
    for k in range(WINDOW):
        out = out * np.uint64(1099511628211) + first[:, k]
    out[WINDOW - filled.sum(1) < LITERALS] = 0
    return out, [v[f].view(np.int64) for v, f in zip(vals, filled)]


HIT = "tmpl bigint, full bigint, same bigint, vals array<bigint>"


def _rows(ids: np.ndarray, name: str, hashes: np.ndarray, row: np.ndarray, keep=None) -> Iterator[pd.DataFrame]:
    """Both templates of the windows, those in ``keep`` if it is given."""
    at, w, _ = windows(hashes, row)
    for kind in (1, 2):
        t = w[kind].view(np.int64)
        hit = np.ones(len(t), bool)
        if keep is not None:
            hit = np.zeros(len(t), bool) if not len(keep) else keep[np.minimum(np.searchsorted(keep, t), len(keep) - 1)] == t
        if kind == 2:  # a window without a name has one template only
            hit &= w[2] ^ np.uint64(0x5851F42D4C957F2D) != w[1]
        if hit.any():
            same, vals = slots(hashes, at[hit], kind)
            yield pd.DataFrame({name: ids[row[at[hit]]], "tmpl": t[hit], "full": w[0][hit].view(np.int64), "same": same.view(np.int64), "vals": vals})


def item_windows(items: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """``(item_id, tmpl, full, same, vals)`` of all windows of the items' texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Canonical()
        for b in batches:
            yield from _rows(b["item_id"].to_numpy(), "item_id", *c.texts(b["text"].tolist()))

    texts = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item_id"), F.explode(F.array(*text_cols)).alias("text")
    )
    return texts.where("text IS NOT NULL").distinct().mapInPandas(cut, f"item_id string, {HIT}").distinct()


def template_hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, item_id, exact, f, pairs)``: windows of documents and of items that have one
    template and either the same words or equal places of equal placeholders; ``pairs`` are
    the values that stand for each other, nothing for an exact one."""
    spark = docs.sparkSession
    filter_by = None
    if known.select("tmpl").distinct().count() <= BROADCAST_WINDOWS:
        t = known.select("tmpl").distinct().toPandas()["tmpl"].to_numpy(np.int64)
        filter_by = spark.sparkContext.broadcast(np.sort(t))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Canonical()
        keep = filter_by.value if filter_by is not None else None
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(), b["text"].tolist()
            for i in range(0, len(ids), 500):
                yield from _rows(ids[i : i + 500], "doc_id", *c.texts(texts[i : i + 500]), keep)

    hits = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    hits = hits.mapInPandas(scan, f"doc_id bigint, {HIT}").withColumnsRenamed({"full": "f", "same": "s", "vals": "v"})
    exact = F.col("f") == F.col("full")
    both = hits.join(known, "tmpl").where(exact | ((F.col("s") == F.col("same")) & (F.col("s") != 0)))
    pairs = F.when(exact, F.array().cast("array<struct<i:bigint,d:bigint>>")).otherwise(F.arrays_zip(F.col("vals").alias("i"), F.col("v").alias("d")))
    return both.select("doc_id", "item_id", exact.alias("exact"), "f", pairs.alias("pairs"))


def leaks(docs: DataFrame, items: DataFrame, text_cols: tuple[str, ...] = ("spoken", "raw", "expected"), item_id: str = "id") -> DataFrame:
    """``(doc_id, item_id, kind, windows)``: documents that contain a passage of eight words of
    an item, with the number of windows met. ``exact``: the words agree; ``reparameterised``:
    only templates agree, and every value of the item's placeholders stands for one value of the
    document's and the other way round. Null or short texts hold no passage; repeated documents
    or items count once; null ids fall out."""
    known = materialize(item_windows(items, item_id, list(text_cols)), "windows")
    hits = materialize(template_hits(docs, known).distinct(), "hits")
    by = ["doc_id", "item_id"]
    both = hits.groupBy(*by).agg(F.bool_or("exact").alias("exact"), F.countDistinct("f").alias("windows"))
    pairs = hits.select(*by, F.inline("pairs")).distinct()
    # A value that stands for two others counts twice on one side.
    clash = pairs.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("n")).union(pairs.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n")))
    clash = clash.where("n > 1").select(*by).distinct().withColumn("clash", F.lit(True))
    both = both.join(clash, by, "left").where("exact OR clash IS NULL")
    return both.select(*by, F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("kind"), "windows")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of the exact passages."""
    return leaks(docs, items).where("kind = 'exact'").select("doc_id", "item_id")


def leak_report(docs: DataFrame, items: DataFrame, text_cols: tuple[str, ...] = ("spoken", "raw", "expected"), item_id: str = "id") -> DataFrame:
    """Every item with the documents that hold it; ``testable`` is false for an item all of whose
    texts are shorter than a passage, which so can't be found."""
    n = leaks(docs, items, text_cols, item_id).groupBy("item_id").agg(
        F.count_if(F.col("kind") == "exact").alias("exact_documents"),
        F.count_if(F.col("kind") != "exact").alias("reparameterised_documents"),
    )
    long = item_windows(items, item_id, list(text_cols)).select("item_id").distinct().withColumn("testable", F.lit(True))
    every = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(n, "item_id", "left").join(long, "item_id", "left").select(
        "item_id", zero("exact_documents"), zero("reparameterised_documents"), F.coalesce("testable", F.lit(False)).alias("testable")
    )
