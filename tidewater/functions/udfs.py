"""Arrow-batched UDFs and UDTFs, and their registration for SQL."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType

from tidewater.functions import cleanup, guard, pytext

TEXTS = ArrayType(StringType())
WER = StructType().add("substitutions", IntegerType()).add("insertions", IntegerType()).add("deletions", IntegerType()).add("reference_words", IntegerType())
HESITATIONS = StructType().add("text", StringType()).add("removed", TEXTS)
CHUNK = StructType().add("position", IntegerType()).add("text", StringType()).add("separator", StringType())
OBJECT = StructType().add("path", StringType()).add("value", StringType())
LEAF = StructType().add("metric", StringType()).add("value", DoubleType())


def _each(f, *cols: pd.Series) -> pd.Series:
    """Null where any argument is null. Repeated arguments of a batch are computed once."""
    known: dict = {}
    out = []
    for args in zip(*cols):
        if any(a is None or a is pd.NA or a != a for a in args):
            out.append(None)
            continue
        if args not in known:
            known[args] = f(*args)
        out.append(known[args])
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return _each(pytext.nfc, s)


@F.pandas_udf(TEXTS)
def nfc_words(s: pd.Series) -> pd.Series:
    return _each(pytext.nfc_words, s)


@F.pandas_udf(TEXTS)
def speech_words(s: pd.Series) -> pd.Series:
    return _each(pytext.speech_words, s)


@F.pandas_udf(TEXTS)
def name_anchors(s: pd.Series) -> pd.Series:
    return _each(pytext.names, s)


@F.pandas_udf(TEXTS)
def protected_anchors(s: pd.Series) -> pd.Series:
    return _each(pytext.protected_anchors, s)


@F.pandas_udf(TEXTS)
def removal_anchors(raw: pd.Series, expected: pd.Series) -> pd.Series:
    return _each(pytext.removals, raw, expected)


@F.pandas_udf(TEXTS)
def lexical_additions(raw: pd.Series, expected: pd.Series) -> pd.Series:
    return _each(pytext.additions, raw, expected)


FEATURES = StructType()
for _name in ("raw_words", "expected_words", "raw_anchors", "expected_anchors", "expected_names", "added"):
    FEATURES = FEATURES.add(_name, TEXTS)


@F.pandas_udf(FEATURES)
def pair_features(raw: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Words, literals, names and added words of pairs in one pass; each is null where a text it
    needs is null. Repeated texts of a batch are cut once."""
    has = lambda x: isinstance(x, str)
    one: dict[str, tuple] = {}
    both: dict[tuple[str, str], list[str]] = {}
    rows = []
    for r, e in zip(raw, expected):
        for t in (r, e):
            if has(t) and t not in one:
                one[t] = (pytext.nfc_words(t), pytext.protected_anchors(t), pytext.names(t))
        if has(r) and has(e) and (r, e) not in both:
            both[r, e] = pytext.additions(r, e)
        a, b = (one[t] if has(t) else (None, None, None) for t in (r, e))
        rows.append((a[0], b[0], a[1], b[1], b[2], both.get((r, e))))
    return pd.DataFrame(rows, columns=FEATURES.names)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(pytext.sequence_ratio, a, b).astype(float)


@F.pandas_udf(WER)
def wer_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Null texts have no words."""
    rows, known = [], {}
    for r, h in zip(reference, hypothesis):
        if (r, h) not in known:
            a, b = pytext.speech_words(r or ""), pytext.speech_words(h or "")
            known[r, h] = (*pytext.edit_counts(a, b), len(a))
        rows.append(known[r, h])
    return pd.DataFrame(rows, columns=["substitutions", "insertions", "deletions", "reference_words"])


@F.pandas_udf(StringType())
def fallback_reason(raw: pd.Series, candidate: pd.Series, hit_limit: pd.Series) -> pd.Series:
    """The strict guard; a null candidate is empty, an unknown limit isn't hit."""
    return pd.Series([guard.fallback_reason(r or "", c or "", h is True or (h == h and bool(h))) for r, c, h in zip(raw, candidate, hit_limit)], dtype=object)


@F.pandas_udf(StringType())
def sanitized(s: pd.Series) -> pd.Series:
    return _each(guard.sanitize, s)


@F.pandas_udf(StringType())
def cleanup_text(s: pd.Series) -> pd.Series:
    return _each(cleanup.cleanup_text, s)


@F.pandas_udf(HESITATIONS)
def without_hesitations(s: pd.Series) -> pd.DataFrame:
    rows = [cleanup.without_hesitations(x) if x is not None else (None, None) for x in s]
    return pd.DataFrame(rows, columns=["text", "removed"])


def _denormal(x) -> bool:
    """Whether any text in a nested value isn't in NFC."""
    if isinstance(x, str):
        return not unicodedata.is_normalized("NFC", x)
    if isinstance(x, dict):
        return any(_denormal(k) or _denormal(v) for k, v in x.items())
    return isinstance(x, list) and any(map(_denormal, x))


@F.pandas_udf(BooleanType())
def holds_denormal_text(s: pd.Series) -> pd.Series:
    """Of JSON text; what isn't JSON is looked at as a text."""

    def one(t: str) -> bool:
        try:
            return _denormal(json.loads(t))
        except ValueError:
            return _denormal(t)

    return _each(one, s)


class _Chunks:
    def eval(self, text, most, preferred=None):
        if text is None:
            return
        for i, (t, sep) in enumerate(cleanup.chunks(text, most, lambda x: len(x.split()), list(preferred or []))):
            yield i, t, sep


class _Walk:
    def eval(self, text):
        """Every object of a JSON text at any depth, with the path that leads to it."""
        if text is None:
            return
        try:
            todo = [("root", json.loads(text))]
        except ValueError:
            return
        while todo:
            key, x = todo.pop()
            if isinstance(x, dict):
                yield key, json.dumps(x, ensure_ascii=False, sort_keys=True)
                todo += [(f"{key}/{k}", v) for k, v in reversed(x.items())]
            elif isinstance(x, list):
                todo += [(f"{key}/{i}", v) for i, v in reversed(list(enumerate(x)))]


def leaves(text: str) -> tuple[list[str], list[float]]:
    """Numeric leaves of a JSON object: dotted paths and values, in the order of the names."""
    names: list[str] = []
    values: list[float] = []
    try:
        todo = [("", json.loads(text))]
    except ValueError:
        return names, values
    while todo:
        key, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{key}.{k}" if key else k, v) for k, v in sorted(x.items(), reverse=True)]
        elif isinstance(x, (int, float)) and not isinstance(x, bool) and key:
            names.append(key)
            values.append(float(x))
    return names, values


class _Leaves:
    def eval(self, text):
        """As :func:`leaves`, a row for each."""
        yield from zip(*leaves(text)) if text is not None else ()


chunk_transcript = F.udtf(_Chunks, returnType=CHUNK, useArrow=True)
walk_json = F.udtf(_Walk, returnType=OBJECT, useArrow=True)
json_leaves = F.udtf(_Leaves, returnType=LEAF, useArrow=True)

UDFS = {
    f.__name__: f
    for f in (nfc, nfc_words, speech_words, name_anchors, protected_anchors, removal_anchors, lexical_additions, sequence_ratio, wer_counts, fallback_reason, sanitized, cleanup_text, without_hesitations, holds_denormal_text)
}
UDTFS = {"chunk_transcript": chunk_transcript, "walk_json": walk_json, "json_leaves": json_leaves}


def register(spark: SparkSession) -> None:
    """Make all of them callable from SQL."""
    from tidewater.session import ship

    ship(spark)
    for name, f in UDFS.items():
        spark.udf.register(name, f)
    for name, f in UDTFS.items():
        spark.udtf.register(name, f)
