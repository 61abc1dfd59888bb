"""Synthetic pairs from frames and word lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions import udfs


@dataclass(frozen=True)
class Frame:
    """A pair with ``{name}`` where a word of a list goes; the same words on both sides."""

    raw: str
    expected: str
    categories: tuple[str, ...] = ()
    risks: tuple[str, ...] = ()


def picked(lists: Mapping[str, Sequence[str]], strides: Mapping[str, int], family: Column, variant: Column, seed: int) -> dict[str, Column]:
    """The word of each list for a family and a variant: position family * stride (+ variant
    for lists named in the plural with ``*``) + seed, around the list."""
    out = {}
    for name, words in lists.items():
        at = family * strides.get(name, 1) + seed
        key = name.rstrip("*")
        if name.endswith("*"):
            at = at + variant
        out[key] = F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))
    return out


def filled(template: str, words: Mapping[str, Column]) -> Column:
    c = F.lit(template)
    for name, w in words.items():
        c = F.replace(c, F.lit("{" + name + "}"), w)
    return c


def pairs(spark: SparkSession, kind: str, frames: Sequence[Frame], families: int, lists: Mapping[str, Sequence[str]], strides: Mapping[str, int], seed: int, version: str = "v1") -> DataFrame:
    """Families x frames records. Any record whose target adds a word fails, when it is read."""
    d = spark.range(families).withColumnRenamed("id", "family")
    d = d.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(len(frames) - 1))))
    words = picked(lists, strides, F.col("family"), F.col("variant"), seed)
    at = lambda values: F.element_at(F.array(*values), F.col("variant") + 1)
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    d = d.withColumns(
        {
            "raw": at([filled(f.raw, words) for f in frames]),
            "expected": at([filled(f.expected, words) for f in frames]),
            "categories": at([lit(f.categories) for f in frames]),
            "risk_tags": at([lit(f.risks) for f in frames]),
        }
    )
    d = d.withColumn("added", udfs.lexical_additions("raw", "expected"))
    fine = F.assert_true(F.size("added") == 0, F.concat(F.lit("the target adds words: "), F.array_join("added", " ")))
    ref = F.format_string(f"supplement-{version}:{kind}:family-%04d", "family")
    ident = F.concat_ws(":", F.lit(version), F.lit(kind), F.col("family"), F.col("variant"), F.concat("raw", F.lit("\x00"), "expected"))
    return d.where(fine.isNull()).select(
        F.concat(F.lit(f"supp-{kind}-"), T.stable_hash(ident, 20)).alias("id"), "raw", "expected", "categories", "risk_tags",
        udfs.protected_anchors("expected").alias("must_preserve"), udfs.removal_anchors("raw", "expected").alias("must_remove"),
        F.concat(ref, F.format_string(":variant-%02d", "variant")).alias("source_ref"), ref.alias("family_id"),
    )
