"""Queries over the training stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import lexicon as L
from tidewater.functions import text as T
from tidewater.operators import curate as C
from tidewater.operators import dedup, folds, sample
from tidewater.plans import classify_sql as K
from tidewater.plans import fragments as S
from tidewater.plans.registry import query
from tidewater.session import materialize

_CORPUS = r"regexp_replace(regexp_replace(lower(trim(source_id)), '[\s_\-]+', '_', 'g'), '_(mirror|v[0-9]+)$', '')"


def _unit(text: str) -> str:
    """The order of ``unit_hash`` over a text expression, salt and separators included."""
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


_USABLE = f"NOT {S.blank('raw')} AND NOT {S.blank('expected')}"
#: Records of the pairs in shards, in the order of a hash, with the words of both their texts.
_SHARDED = f"""
x AS (SELECT id, len({S.words('raw')}) + len({S.words('expected')}) AS n, CAST({S.hash64('id')} % 16 AS INTEGER) AS shard, substr(sha256(id), 1, 32) AS o FROM train_sotto_lfm WHERE {_USABLE}),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o) AS k, CAST(greatest(900, ceil(n * 1.5)) AS INTEGER) AS cap FROM x)"""


def _corpus() -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim("source_id")), r"[\s_\-]+", "_"), r"_(mirror|v[0-9]+)$", "")


def _pairs(train: DataFrame) -> DataFrame:
    """Rows with two texts; the corpus under one name."""
    return train.where(~C.blank("raw") & ~C.blank("expected")).withColumn("source_id", _corpus())


@query("train_sotto_lfm", sql=f"SELECT {_CORPUS} AS corpus, count(*) AS n, count(*) / (SELECT count(*) FROM train_sotto_lfm) AS share FROM train_sotto_lfm GROUP BY 1")
def train_shares(train: DataFrame) -> DataFrame:
    """Records and share of each corpus."""
    return sample.shares(train.select(_corpus().alias("corpus")), "corpus")


@query(
    "train_sotto_lfm",
    sql=f"""
SELECT {_CORPUS} AS corpus, count(*) AS n, count_if({S.blank('raw')} OR {S.blank('expected')}) AS unusable,
  count_if(raw = expected) AS unchanged FROM train_sotto_lfm GROUP BY 1""",
)
def train_accounting(train: DataFrame) -> DataFrame:
    """Usable and unusable rows of each corpus."""
    return train.groupBy(_corpus().alias("corpus")).agg(F.count(F.lit(1)).alias("n"), F.count_if(C.blank("raw") | C.blank("expected")).alias("unusable"), F.count_if(F.col("raw") == F.col("expected")).alias("unchanged"))


@query(
    "train_sotto_lfm",
    sql=f"""
WITH t AS (SELECT id, {S.words('raw')} AS r, {S.words('expected')} AS e FROM train_sotto_lfm WHERE expected IS NOT NULL AND raw IS NOT NULL),
rc AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(r) AS w FROM t) GROUP BY ALL), ec AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(e) AS w FROM t) GROUP BY ALL)
SELECT ec.w AS word, count(*) AS records, sum(ec.n - coalesce(rc.n, 0)) AS added FROM ec LEFT JOIN rc USING (id, w) WHERE ec.n > coalesce(rc.n, 0) GROUP BY ec.w""",
)
def pair_lexical_additions(train: DataFrame) -> DataFrame:
    """Words of the target beyond those of the input, as a difference of multisets."""
    t = train.where("raw IS NOT NULL AND expected IS NOT NULL")
    side = lambda c, s: t.select("id", F.explode(T.lexical_tokens(c)).alias("w"), F.lit(s).alias("s"))
    # Both sides in one aggregate: a record's counts of a word meet without a join.
    n = side("raw", -1).union(side("expected", 1)).groupBy("id", "w").agg(F.sum("s").cast("bigint").alias("extra")).where("extra > 0")
    return n.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("records"), F.sum("extra").alias("added"))


_PREDICATES = {k: L.PATTERNS[k] for k in ("high_stakes", "adversarial", "technical", "correction", "grammar_cue", "asr_cue", "spoken_list", "discourse", "command", "version", "identifier", "money", "date_numeric", "date_word", "date_may")}


def _sq(p: str) -> str:
    return p.replace("'", "''")


@query(
    "train_sotto_lfm",
    sql="SELECT predicate, count_if(hit) AS hits FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS predicate, regexp_matches(coalesce(raw, ''), '{_sq(p)}') AS hit FROM train_sotto_lfm" for k, p in _PREDICATES.items())
    + ") GROUP BY predicate",
)
def risk_predicate_counts(train: DataFrame) -> DataFrame:
    """How often each predicate of the classifier holds; one scan for all of them."""
    hits = F.array(*[F.struct(F.lit(k).alias("predicate"), T.matches(k, F.coalesce("raw", F.lit(""))).alias("hit")) for k in _PREDICATES])
    return train.select(F.inline(hits)).groupBy("predicate").agg(F.count_if("hit").alias("hits"))


def _classified(train: DataFrame) -> DataFrame:
    p = _pairs(train).withColumn("label", F.when(F.col("source_id") == "sotto", C.operation("raw", "expected")).otherwise(F.lit("")))
    return C.declared_additions(C.classified(C.with_text_features(p)))


_CLASSIFIED = K.CLASSIFIED.strip().replace("{corpus}", _CORPUS)


@query("train_sotto_lfm", sql=f"WITH {_CLASSIFIED}, o AS (SELECT src AS source_id, {K.OUTCOME} AS outcome, {K.REASON} AS reason FROM classified) SELECT source_id, outcome, reason, count(*) AS n FROM o GROUP BY ALL")
def train_routing(train: DataFrame) -> DataFrame:
    """Candidates, quarantine and rejections by reason."""
    return C.routed(_classified(train)).groupBy("source_id", "outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("train_sotto_lfm", sql=f"WITH {_CLASSIFIED}, o AS (SELECT 'category' AS kind, unnest(categories) AS tag FROM classified UNION ALL SELECT 'risk', unnest(risks) FROM classified) SELECT kind, tag, count(*) AS n FROM o GROUP BY ALL")
def train_tag_counts(train: DataFrame) -> DataFrame:
    """Categories and risks of the classified pairs."""
    c = _classified(train)
    kinds = F.array(F.struct(F.lit("category").alias("kind"), F.col("categories").alias("tags")), F.struct(F.lit("risk").alias("kind"), F.col("risk_tags").alias("tags")))
    return c.select(F.inline(kinds)).select("kind", F.explode("tags").alias("tag")).groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("train_sotto_lfm", sql=f"""WITH {_CLASSIFIED}, o AS (SELECT {K.BUCKET} AS bucket, {K.PROTECTED_FLAG} AS p, {K.ASKING_FLAG} AS a FROM classified)
SELECT bucket, count(*) AS n, avg(CAST(p AS DOUBLE)) AS protected, avg(CAST(a AS DOUBLE)) AS asking FROM o GROUP BY bucket""")  # fmt: skip
def train_buckets(train: DataFrame) -> DataFrame:
    """Primary buckets and the flags that cut across them."""
    c = _classified(train).select(C.bucket().alias("bucket"), C.crosscutting().alias("flags"))
    return c.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_contains("flags", "protected_literal").cast("double")).alias("protected"), F.avg(F.array_contains("flags", "must_not_answer_or_command_question").cast("double")).alias("asking"))


# Pool: of each bucket the first 88 rows by hash, and of those with the flag the first 44. Of a
# bucket as many flagged rows as it has room for, of all of them 20, the rest by hash.
@query("train_sotto_lfm", sql=f"""WITH {_CLASSIFIED}, o AS (SELECT id, {K.BUCKET} AS bucket, {K.PROTECTED_FLAG} AS flag FROM classified),
b AS (SELECT * FROM o WHERE bucket IN ('filler_or_repetition', 'mixed_or_discourse') AND id IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('23:candidate-pool:' || id), id) AS k, row_number() OVER (PARTITION BY bucket, flag ORDER BY sha256('23:candidate-pool:' || id), id) AS f FROM b),
pool AS (SELECT id, bucket, flag FROM h WHERE k <= 88 OR (flag AND f <= 44)),
x AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('23:train:cross:' || id), id) AS k FROM pool WHERE flag),
y AS (SELECT *, row_number() OVER (ORDER BY sha256('23:train:cross:' || id), id) AS k2 FROM x WHERE k <= 20), taken AS (SELECT id, bucket FROM y WHERE k2 <= 20),
room AS (SELECT bucket, 20 - count(*) AS n FROM taken GROUP BY bucket),
z AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('23:train:fill:' || id), id) AS k FROM pool WHERE id NOT IN (SELECT id FROM taken))
SELECT id, bucket FROM taken UNION ALL SELECT z.id, z.bucket FROM z LEFT JOIN room USING (bucket) WHERE z.k <= coalesce(room.n, 20)""")  # fmt: skip
def train_quota_selection(train: DataFrame) -> DataFrame:
    """Exact quotas of two buckets with a minimum of one flag, out of a bounded pool."""
    c = materialize(_classified(train).select("id", C.bucket().alias("bucket"), C.crosscutting().alias("flags")), "pool")
    quotas = {"filler_or_repetition": 20, "mixed_or_discourse": 20}
    p = sample.pool(c, quotas, 0.1, {"protected_literal": 0.5}, 4, 23)
    return sample.choose(p, quotas, {"protected_literal": 0.5}, 23, "train").select("id", "bucket")


@query("train_sotto_lfm", sql=f"""
SELECT pair, count(*) AS n FROM (SELECT sha256({S.overlap('raw')} || chr(0) || {S.overlap('expected')}) AS pair FROM train_sotto_lfm) GROUP BY pair HAVING count(*) > 1""")  # fmt: skip
def train_duplicate_pairs(train: DataFrame) -> DataFrame:
    """Pairs that are one after folding."""
    return C.duplicate_pairs(train)


@query("cleanup_cases", sql="SELECT id, count(*) AS n FROM cleanup_cases WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def case_duplicate_ids(cases: DataFrame) -> DataFrame:
    return C.duplicate_ids(cases)


@query(
    "cleanup_cases",
    sql=f"""
WITH c AS (SELECT *, coalesce(must_preserve, []) AS keep, coalesce(must_remove, []) AS gone FROM cleanup_cases),
v AS (SELECT id, unnest(list_filter([CASE WHEN {S.blank('id')} THEN 'blank_id' END, CASE WHEN {S.blank('raw')} THEN 'blank_raw' END,
  CASE WHEN {S.blank('expected')} THEN 'blank_expected' END, CASE WHEN coalesce(len(categories), 0) = 0 THEN 'no_category' END,
  CASE WHEN len(list_distinct(categories)) < len(categories) THEN 'repeated_category' END,
  CASE WHEN len(list_filter(keep, lambda a: NOT contains(expected, a))) > 0 THEN 'preserve_absent' END,
  CASE WHEN len(list_filter(gone, lambda a: NOT contains(raw, a))) > 0 THEN 'remove_absent' END,
  CASE WHEN len(list_filter(gone, lambda a: contains(expected, a))) > 0 THEN 'remove_survives' END, CASE WHEN spoken IS NULL THEN 'spoken_missing' END], lambda x: x IS NOT NULL)) AS rule FROM c)
SELECT rule, count(*) AS records, count(DISTINCT id) AS ids FROM v GROUP BY rule""",
)
def case_violations(cases: DataFrame) -> DataFrame:
    """How many cases break each rule."""
    return C.violations(cases, "id", C.case_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("id").alias("ids"))


@query("train_sotto_lfm", "heldout_cases", sql=f"""
WITH f AS (SELECT DISTINCT {S.overlap('s')} AS norm FROM (SELECT raw AS s FROM heldout_cases UNION ALL SELECT expected FROM heldout_cases) WHERE s IS NOT NULL)
SELECT DISTINCT id FROM train_sotto_lfm WHERE ({S.overlap('raw')} IN (SELECT norm FROM f WHERE norm <> '') OR {S.overlap('expected')} IN (SELECT norm FROM f WHERE norm <> ''))""")  # fmt: skip
def train_frozen_overlap(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """Training records one of whose texts equals a frozen one."""
    return dedup.overlapping_exact(train, "id", ("raw", "expected"), dedup.frozen_surfaces(heldout))


@query("train_sotto_lfm", "heldout_cases")
def train_contamination(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """Training records that overlap frozen texts by any of the rules."""
    return dedup.contaminated(train, "id", ("raw", "expected"), dedup.frozen_surfaces(heldout))


@query(
    "train_sotto_lfm",
    sql=f"""
WITH RECURSIVE k AS (SELECT id AS key, concat_ws(chr(10), raw, expected) AS t FROM train_sotto_lfm WHERE id IS NOT NULL),{S.NEAR}
SELECT component, count(*) AS records FROM comp GROUP BY component HAVING count(*) > 1""",
)
def train_near_components(train: DataFrame) -> DataFrame:
    """Components over equal pairs and near ones."""
    t = train.withColumn("both", F.concat_ws("\n", "raw", "expected"))
    return dedup.text_groups(t, "id", "both").groupBy("component").agg(F.count(F.lit(1)).alias("records")).where("records > 1")


@query(
    "train_sotto_lfm",
    sql=f"""
WITH t AS (SELECT id, sha256({S.normalized('expected')}) AS family FROM train_sotto_lfm WHERE id IS NOT NULL AND expected IS NOT NULL),
f AS (SELECT family, count(*) AS n, {_unit("'17' || chr(31) || family")} AS u FROM t GROUP BY family),
p AS (SELECT family, coalesce(sum(n) OVER (ORDER BY u, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM f)
SELECT id, CASE WHEN before < round_even(total * 0.8, 0) THEN 'train' WHEN before < round_even(total * 0.9, 0) THEN 'dev' ELSE 'test' END AS split FROM t JOIN p USING (family)""",
)
def train_grouped_split(train: DataFrame) -> DataFrame:
    """Records of one target stay together; 80 / 10 / 10 by whole families."""
    t = train.where("id IS NOT NULL AND expected IS NOT NULL")
    return sample.grouped_split(t, "id", F.sha2(T.normalized_text("expected"), 256), {"train": 0.8, "dev": 0.1, "test": 0.1}, "17").select(F.col("key").alias("id"), "split")


@query(
    "train_sotto_lfm",
    sql=f"""
WITH x AS (SELECT id, {_CORPUS} AS source_id, row_number() OVER (ORDER BY {_unit("'5' || chr(31) || id")}, id) AS ordinal FROM train_sotto_lfm WHERE {_USABLE})
SELECT id, source_id, ordinal, 'stream-' || lpad(CAST(ordinal AS VARCHAR), 9, '0') AS stream_id FROM x""",
)
def train_single_pass(train: DataFrame) -> DataFrame:
    """Every usable row once in the order of a hash, numbered."""
    return sample.single_pass(_pairs(train).select("id", "source_id"), "id", "5", "stream").select("id", "source_id", "ordinal", "stream_id")


@query(
    "train_sotto_lfm",
    sql=f"""
WITH t AS (SELECT id, list_transform({S.words('expected')}, lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '#' ELSE w END) AS w FROM train_sotto_lfm WHERE expected IS NOT NULL)
SELECT substr(sha256({S.joined('w')}), 1, 16) AS template, count(*) AS records FROM t GROUP BY 1 HAVING count(*) > 1""",
)
def train_templates(train: DataFrame) -> DataFrame:
    """Targets that differ in numbers only."""
    t = train.where("expected IS NOT NULL").select(T.stable_hash(T.template_shape(T.lexical_tokens("expected")), 16).alias("template"))
    return t.groupBy("template").agg(F.count(F.lit(1)).alias("records")).where("records > 1")


@query(
    "train_sotto_lfm",
    sql=f"""
WITH t AS (SELECT id, {S.words('raw')} AS w FROM train_sotto_lfm)
SELECT count_if(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0) AS repeating, count(*) AS records FROM t""",
)
def train_repetitions(train: DataFrame) -> DataFrame:
    """Records that say a word twice in a row."""
    return train.agg(F.count_if(T.has_adjacent_repeat(T.lexical_tokens("raw"))).alias("repeating"), F.count(F.lit(1)).alias("records"))


@query("train_sotto_lfm", sql="""
WITH t AS (SELECT id, source_id, split_part(source_ref, ':', 2) AS file FROM train_sotto_lfm WHERE source_ref IS NOT NULL)
SELECT file, count(*) AS records, count(DISTINCT source_id) AS sources, count_if(file LIKE 'data/train-%') AS in_train FROM t GROUP BY file""")  # fmt: skip
def train_files(train: DataFrame) -> DataFrame:
    """Records by the file of their reference, and whether a path rule admits it."""
    t = train.where("source_ref IS NOT NULL").withColumn("file", F.coalesce(F.get(F.split("source_ref", ":"), F.lit(1)), F.lit("")))
    return t.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("source_id").alias("sources"), F.count_if(F.col("file").like("data/train-%")).alias("in_train"))


@query(
    "train_sotto_lfm",
    sql=f"""
WITH RECURSIVE {_SHARDED.strip()},
p AS (
  SELECT shard, k, n, 0 AS pack, n AS used FROM r WHERE k = 1
  UNION ALL
  SELECT r.shard, r.k, r.n, CASE WHEN p.used > 0 AND p.used + r.n > 512 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.used > 0 AND p.used + r.n > 512 THEN r.n ELSE p.used + r.n END
  FROM p JOIN r ON r.shard = p.shard AND r.k = p.k + 1
), one AS (SELECT shard, pack, count(*) AS rows, sum(n) AS tokens FROM p GROUP BY shard, pack)
SELECT count(*) AS packs, sum(rows) AS examples, sum(tokens) AS tokens, max(tokens) AS fullest, sum(tokens) / (count(*) * 512) AS utilization FROM one""",
)
def train_packing(train: DataFrame) -> DataFrame:
    """Records packed into sequences of 512 words in the order of a hash, shard by shard."""
    t = _pairs(train).select("id", (F.size(T.lexical_tokens("raw")) + F.size(T.lexical_tokens("expected"))).alias("length"))
    t = sample.sharded(t, "id", 16).withColumn("ordinal", T.stable_hash("id", 32))
    return folds.packing_report(folds.packed(t, "length", 512), "length", 512)


@query(
    "train_sotto_lfm",
    sql=f"""
WITH RECURSIVE {_SHARDED.strip()},
p AS (
  SELECT shard, k, n, cap, 0 AS batch, 1 AS rows, n AS longest FROM r WHERE k = 1
  UNION ALL
  SELECT shard, k, n, cap, batch + new, CASE WHEN new = 1 THEN 1 ELSE rows + 1 END, CASE WHEN new = 1 THEN n ELSE greatest(longest, n) END FROM (
    SELECT r.shard, r.k, r.n, r.cap, p.batch, p.rows, p.longest, CASE WHEN r.cap <> p.cap OR p.rows >= 16 OR greatest(p.longest, r.n) * (p.rows + 1) > 2048 THEN 1 ELSE 0 END AS new
    FROM p JOIN r ON r.shard = p.shard AND r.k = p.k + 1)
)
SELECT shard, CAST(batch AS BIGINT) AS batch, count(*) AS rows, CAST(max(n) AS INTEGER) AS longest, max(cap) AS cap FROM p GROUP BY shard, batch""",
)
def train_batches(train: DataFrame) -> DataFrame:
    """Records batched by equal caps, at most 16 rows and 2,048 padded words."""
    t = _pairs(train).select("id", (F.size(T.lexical_tokens("raw")) + F.size(T.lexical_tokens("expected"))).alias("length"))
    t = t.withColumn("cap", T.token_cap("length"))
    t = sample.sharded(t, "id", 16).withColumn("ordinal", T.stable_hash("id", 32))
    b = folds.batched(t, "length", "cap", 16, 2048)
    return b.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("rows"), F.max("length").alias("longest"), F.max("cap").alias("cap"))


@query("train_sotto_lfm", sql="""
SELECT id, source_id, place FROM (SELECT id, source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY length(raw) DESC, id) AS INTEGER) AS place FROM train_sotto_lfm WHERE raw IS NOT NULL) WHERE place <= 3""")  # fmt: skip
def train_longest_by_source(train: DataFrame) -> DataFrame:
    """The three longest inputs of each source, ties by id."""
    w = Window.partitionBy("source_id").orderBy(F.desc(F.char_length("raw")), "id")
    return train.where("raw IS NOT NULL").select("id", "source_id", F.row_number().over(w).alias("place")).where("place <= 3")


@query("train_sotto_lfm", "split_targets", sql=f"""
WITH t AS (SELECT {_CORPUS} AS corpus, CASE WHEN {S.hash64("id")} < 1844674407370955161 THEN 'dev' ELSE 'train' END AS split, {S.overlap('expected')} AS fam FROM train_sotto_lfm WHERE expected IS NOT NULL)
SELECT sha256(fam) AS family, count(DISTINCT split) AS splits FROM t GROUP BY fam HAVING count(DISTINCT split) > 1""")  # fmt: skip
def split_leaks(train: DataFrame, _targets: DataFrame) -> DataFrame:
    """Families that a split by id alone would part."""
    t = train.where("expected IS NOT NULL").select(F.sha2(T.overlap_text("expected"), 256).alias("family"), F.when(T.hash64("id") < F.lit("1844674407370955161").cast("decimal(20,0)"), "dev").otherwise("train").alias("split"))
    return C.crossing(t, "family")


@query("cleanup_cases", "sample_targets", sql="""
WITH c AS (SELECT DISTINCT id, unnest(categories) AS category FROM cleanup_cases), a AS (SELECT category, count(DISTINCT id) AS n FROM c GROUP BY category),
t AS (SELECT category, max(min_rows) * 20 AS required FROM sample_targets WHERE table_name = 'cleanup_cases' GROUP BY category)
SELECT category, required, coalesce(n, 0) AS available, required - coalesce(n, 0) AS missing FROM t LEFT JOIN a USING (category) WHERE required > coalesce(n, 0)""")  # fmt: skip
def case_shortfall(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """Labels, as written, with fewer cases than twenty times the minimum."""
    a = cases.select("id", F.explode("categories").alias("category")).groupBy("category").agg(F.countDistinct("id").alias("available"))
    t = targets.where("table_name = 'cleanup_cases'").groupBy("category").agg((F.max("min_rows") * 20).alias("required"))
    return C.shortfall(a, t, "category")
