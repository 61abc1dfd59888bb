"""Queries over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions import udfs
from tidewater.operators import dedup, sample
from tidewater.plans import fragments as S
from tidewater.plans.registry import query

_NORM = S.normalized("nfc_normalize(text)")


@query(
    "documents",
    sql=f"""
WITH n AS (SELECT doc_id, source, lang, {_NORM} AS norm FROM documents WHERE text IS NOT NULL),
g AS (SELECT norm, count(*) AS copies FROM n GROUP BY norm)
SELECT source, lang, count(*) AS docs, count_if(copies > 1) AS duplicated, count(DISTINCT norm) AS distinct_texts
FROM n JOIN g USING (norm) GROUP BY source, lang""",
)
def doc_normalized_exact_dups(docs: DataFrame) -> DataFrame:
    """Exact duplicates after Unicode form, case, spacing and punctuation are evened out."""
    n = docs.where("text IS NOT NULL").select("source", "lang", udfs.nfc("text").alias("t"))
    n = n.select("source", "lang", F.sha2(T.normalized_text("t"), 256).alias("norm"))
    # Copies of one text are counted per source and language before they meet.
    part = n.groupBy("norm", "source", "lang").agg(F.count(F.lit(1)).alias("m"))
    g = part.groupBy("norm").agg(F.sum("m").alias("copies"))
    j = part.join(g, "norm")
    return j.groupBy("source", "lang").agg(
        F.sum("m").alias("docs"), F.sum(F.when(F.col("copies") > 1, F.col("m")).otherwise(0)).alias("duplicated"), F.count(F.lit(1)).alias("distinct_texts")
    )


@query(
    "documents",
    sql=f"""
WITH t AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
g AS (SELECT doc_id, unnest({S.ngrams('w', 3)}) AS gram FROM t)
SELECT gram, count(*) AS docs FROM g GROUP BY gram HAVING count(*) >= 5""",
)
def doc_word_ngram_counts(docs: DataFrame) -> DataFrame:
    """Word 3-grams and in how many documents they occur, from five on."""
    g = docs.select(T.lexical_tokens("text").alias("w")).select(F.explode(T.word_ngrams("w", 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 5")


@query("documents", sql=f"SELECT doc_id, CAST({S.hash64('CAST(doc_id AS VARCHAR)')} % 16 AS INTEGER) AS shard FROM documents")
def shard_assignment(docs: DataFrame) -> DataFrame:
    return sample.sharded(docs, "doc_id", 16).select("doc_id", "shard")


@query("documents", sql="SELECT doc_id, length(text) AS length FROM documents WHERE text IS NOT NULL ORDER BY length(text) DESC, doc_id LIMIT 20")
def top_longest_docs(docs: DataFrame) -> DataFrame:
    """The twenty longest texts, ties by id."""
    return docs.where("text IS NOT NULL").select("doc_id", F.char_length("text").alias("length")).orderBy(F.desc("length"), "doc_id").limit(20)


@query(
    "documents",
    sql="""
SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:pool:' || CAST(doc_id AS VARCHAR))) AS place FROM documents
) WHERE place <= 25""",
)
def quota_pool(docs: DataFrame) -> DataFrame:
    """A pool of at most 25 documents of each source, chosen by hash."""
    return sample.top_by_hash(docs.select("doc_id", "source"), "source", "doc_id", 25, "7:pool:")


@query(
    "documents",
    sql=f"""
WITH c AS (SELECT source, length(coalesce(text, '')) AS n FROM documents)
SELECT source, CASE WHEN n = 0 THEN 'empty' WHEN n <= 128 THEN '1-128' WHEN n <= 256 THEN '129-256' WHEN n <= 512 THEN '257-512'
  WHEN n <= 1024 THEN '513-1024' ELSE '1025-' END AS bucket, count(*) AS docs, sum(n) AS chars, max(n) AS longest FROM c GROUP BY ALL""",
)
def doc_length_histogram(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.char_length("text"), F.lit(0))
    b = F.when(n == 0, "empty").when(n <= 128, "1-128").when(n <= 256, "129-256").when(n <= 512, "257-512").when(n <= 1024, "513-1024").otherwise("1025-")
    return docs.select("source", n.cast("bigint").alias("n"), b.alias("bucket")).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


@query(
    "documents", "heldout_cases",
    sql=f"""
WITH f AS (SELECT DISTINCT {S.overlap('s')} AS norm FROM (SELECT raw AS s FROM heldout_cases UNION ALL SELECT expected FROM heldout_cases) WHERE s IS NOT NULL)
SELECT DISTINCT doc_id FROM documents WHERE {S.overlap('text')} IN (SELECT norm FROM f WHERE norm <> '')""",
)
def bench_contamination_exact(docs: DataFrame, heldout: DataFrame) -> DataFrame:
    """Documents that equal a frozen text after folding."""
    return dedup.overlapping_exact(docs, "doc_id", ("text",), dedup.frozen_surfaces(heldout))


@query(
    "documents", "heldout_cases",
    sql=f"""
WITH d AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
dg AS (SELECT doc_id, unnest({S.ngrams('w', 3)}) AS gram FROM d),
h AS (SELECT id, {S.words('expected')} AS w FROM heldout_cases UNION ALL SELECT id, {S.words('raw')} FROM heldout_cases),
hg AS (SELECT DISTINCT id, unnest({S.ngrams('w', 3)}) AS gram FROM h)
SELECT doc_id, id AS item, count(*) AS shared FROM dg JOIN hg USING (gram) GROUP BY doc_id, id HAVING count(*) >= 5""",
)
def bench_contamination_ngram(docs: DataFrame, heldout: DataFrame) -> DataFrame:
    """Documents and frozen texts that share five word 3-grams or more (an inverted index)."""
    gram = lambda c: F.explode(T.word_ngrams("w", 3)).alias("gram")
    d = docs.select("doc_id", T.lexical_tokens("text").alias("w")).select("doc_id", gram("w"))
    h = dedup.frozen_surfaces(heldout).select("item", T.lexical_tokens("surface").alias("w")).select("item", gram("w")).distinct()
    return d.join(h, "gram").groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 5")


@query(
    "documents",
    sql=f"""
WITH n AS (SELECT doc_id, {S.normalized('text')} AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS component FROM n WHERE norm <> '' GROUP BY norm)
SELECT doc_id, coalesce(component, doc_id) AS component FROM n LEFT JOIN g USING (norm)""",
)
def doc_exact_components(docs: DataFrame) -> DataFrame:
    """Documents of equal folded text under their smallest id."""
    n = docs.select("doc_id", F.sha2(T.normalized_text("text"), 256).alias("norm"), (T.normalized_text("text") == "").alias("blank"))
    g = n.where("NOT blank").groupBy("norm").agg(F.min("doc_id").alias("component"))
    return n.join(g, "norm", "left").select("doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("component")).alias("component"))


@query(
    "documents",
    sql=f"""
WITH RECURSIVE k AS (SELECT doc_id AS key, text AS t FROM documents WHERE doc_id IS NOT NULL),{S.NEAR_WHOLE}
SELECT key AS doc_id, component FROM comp""",
)
def doc_near_components(docs: DataFrame) -> DataFrame:
    """Documents that are equal or near each other, as components."""
    return dedup.text_groups(docs, "doc_id", "text", candidate=None).select(F.col("key").alias("doc_id"), "component")


@query(
    "documents",
    sql=f"""
WITH n AS (SELECT doc_id, {S.normalized('text')} AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS component FROM n WHERE norm <> '' GROUP BY norm), c AS (SELECT doc_id, coalesce(component, doc_id) AS component FROM n LEFT JOIN g USING (norm)),
d AS (SELECT component, count(*) AS n, bit_xor(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)) AS x FROM c GROUP BY component),
s AS (SELECT component, CASE WHEN {S.hash64("'23:' || n || ':' || x")} < CAST(1844674407370955264 AS UBIGINT) THEN 'dev' ELSE 'train' END AS split FROM d)
SELECT doc_id, component, split FROM c JOIN s USING (component)""",
)
def doc_component_split(docs: DataFrame) -> DataFrame:
    """Components of equal documents, a tenth of them for development."""
    g = doc_exact_components(docs).withColumnRenamed("doc_id", "key")
    return sample.component_split(g, 0.1, "23").select(F.col("key").alias("doc_id"), "component", "split")


@query(
    "documents",
    sql=f"""
SELECT doc_id, count(DISTINCT g) AS grams FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(length(n) - 3, 2)), lambda i: substr(n, i, 5))) AS g
FROM (SELECT doc_id, {S.normalized('text')} AS n FROM documents) WHERE n <> '') GROUP BY doc_id""",
)
def doc_char_ngram_sizes(docs: DataFrame) -> DataFrame:
    """Distinct character 5-grams of each document that has words."""
    d = docs.select("doc_id", T.normalized_text("text").alias("n")).where("n <> ''")
    return d.select("doc_id", F.size(T.char_ngrams("n", 5)).cast("bigint").alias("grams"))


@query(
    "documents",
    sql="""
SELECT source, lang, count(*) AS docs, count(DISTINCT speaker_id) AS speakers, CAST(grouping(source, lang) AS BIGINT) AS level
FROM documents GROUP BY ROLLUP (source, lang)""",
)
def quality_by_source_rollup(docs: DataFrame) -> DataFrame:
    """Documents and speakers by source and language, with subtotals."""
    return docs.rollup("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("speaker_id").alias("speakers"), F.grouping_id().cast("bigint").alias("level"))


@query(
    "documents",
    sql=r"""
SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS ascii_words,
  length(coalesce(text, '')) AS points, CAST(length(coalesce(text, '')) + len(regexp_extract_all(coalesce(text, ''), '[\x{10000}-\x{10FFFF}]')) AS INTEGER) AS utf16,
  sha256(coalesce(text, '')) AS digest, md5(coalesce(text, '')) AS md5, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 8) AS BIGINT) AS seed
FROM documents""",
)
def doc_fingerprints(docs: DataFrame) -> DataFrame:
    """Lengths and digests of the texts."""
    t = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.size(T.ascii_words(t)).cast("bigint").alias("ascii_words"), F.char_length(t).cast("bigint").alias("points"), T.utf16_length(t).alias("utf16"),
        F.sha2(t, 256).alias("digest"), F.md5(t).alias("md5"), T.seed32(t).alias("seed"),
    )


@query("documents")
def doc_chunks(docs: DataFrame) -> DataFrame:
    """Documents cut into passes of at most 48 words at sentence ends."""
    udfs.register(docs.sparkSession)
    d = docs.where("text IS NOT NULL").select("doc_id", "text").alias("d")
    c = d.lateralJoin(udfs.chunk_transcript(F.col("d.text").outer(), F.lit(48)).alias("c"))
    return c.select("doc_id", "c.position", F.size(F.split("c.text", r"\s+")).alias("words"), "c.separator")


@query(
    "documents", "heldout_cases",
    sql=f"""
WITH f AS (SELECT DISTINCT lower({S.tidy('nfc_normalize(s)')}) AS s FROM (SELECT raw AS s FROM heldout_cases UNION ALL SELECT expected FROM heldout_cases) WHERE s IS NOT NULL AND trim(s) <> '')
SELECT count(*) AS kept FROM documents WHERE text IS NULL OR lower({S.tidy('nfc_normalize(text)')}) NOT IN (SELECT s FROM f)""",
)
def doc_without_frozen(docs: DataFrame, heldout: DataFrame) -> DataFrame:
    """How many documents are left when frozen surfaces are forbidden."""
    return dedup.without_forbidden(docs.select("doc_id", "text"), "text", dedup.frozen_surfaces(heldout)).agg(F.count(F.lit(1)).alias("kept"))
