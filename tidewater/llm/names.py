"""Categories, corpora and origins, however unevenly they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of origin a locator can name, with their short forms.
KINDS = {"contributor": "contributor", "ctb": "contributor", "speaker": "speaker", "spk": "speaker", "paragraph": "paragraph", "par": "paragraph"}

_KIND = "|".join(KINDS)
_GAP = r"(?:%[0-9a-f]{2}|[\s\-_#=.])*"
ORIGIN = rf"(?<![a-z])(?:{_KIND}){_GAP}[0-9]+"


def category_key(c: Column | str) -> Column:
    """Letter case, outer blanks, and blank, hyphen or underscore make no difference; a blank
    or null label is null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s ]+|[\s ]+$", ""), r"[\s _\-]+", "_")
    return F.when(k != "", k)


def corpus_key(c: Column | str) -> Column:
    """As :func:`category_key`, and without a mirror or version suffix."""
    k = category_key(c)
    return F.regexp_replace(k, r"(?:[_.]?(?:mirror|v(?:ersion)?_?[0-9]+(?:[._][0-9]+)*))+$", "")


def origins(ref: Column | str) -> Column:
    """The origins named by the locator, the third part of a reference, as distinct
    ``kind:number`` texts in order of appearance; an empty array where it names none."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    locator = F.lower(F.regexp_extract(ref, r"(?s)^[^:]*:[^:]*:(.*)$", 1))
    found = F.regexp_extract_all(locator, F.lit(ORIGIN), F.lit(0))

    def canonical(x: Column) -> Column:
        word = F.regexp_extract(x, r"^[a-z]+", 0)
        kind = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in KINDS.items()])
        number = F.regexp_extract(F.regexp_extract(x, r"[0-9]+$", 0), r"^0*([0-9]+)$", 1)
        return F.concat_ws(":", kind, number)

    return F.coalesce(F.array_distinct(F.transform(found, canonical)), F.array().cast("array<string>"))


def origin_entities(train: DataFrame) -> DataFrame:
    """``(id, corpus, entities)`` of training records; an entity is ``corpus/kind:number``, as
    each corpus numbers its own."""
    corpus = F.coalesce(corpus_key("source_id"), F.lit(""))
    return train.select("id", corpus.alias("corpus"), origins("source_ref").alias("o")).select(
        "id", "corpus", F.transform("o", lambda x: F.concat_ws("/", F.col("corpus"), x)).alias("entities")
    )
