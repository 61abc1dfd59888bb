"""SQL for the queries that SQL can express. The others are tested against brute force."""

_CATEGORY = r"regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[\s_\-]+', '_', 'g')"
_CORPUS = r"regexp_replace(" + _CATEGORY + r", '([_.]?(mirror|v(ersion)?_?[0-9]+([._][0-9]+)*))+$', '')"

P4_FOUND = f"""
WITH members AS (
  SELECT DISTINCT 'cleanup_cases' AS table_name, id, {_CATEGORY.format('c')} AS category
  FROM (SELECT id, unnest(categories) AS c FROM cleanup_cases) WHERE c IS NOT NULL
  UNION
  SELECT DISTINCT 'train_sotto_lfm', id, {_CORPUS.format('source_id')} FROM train_sotto_lfm WHERE source_id IS NOT NULL
), have AS (SELECT table_name, category, count(*) AS n FROM members GROUP BY ALL),
sizes AS (
  SELECT 'cleanup_cases' AS table_name, count(DISTINCT id) AS n_ids FROM cleanup_cases
  UNION ALL SELECT 'train_sotto_lfm', count(DISTINCT id) FROM train_sotto_lfm
)
SELECT DISTINCT t.target_set, t.category
FROM sample_targets t JOIN sizes s USING (table_name)
LEFT JOIN have h ON h.table_name = t.table_name AND h.category = t.category
WHERE coalesce(h.n, 0) < greatest(t.min_rows, round(t.target_share * t.sample_fraction * s.n_ids, 6))
"""

_ORIGINS = rf"""
origins AS (
  SELECT id, {_CORPUS.format('source_id')} AS corpus,
         unnest(regexp_extract_all(lower(regexp_extract(source_ref, '^[^:]*:[^:]*:(.*)$', 1)),
                '(contributor|ctb|speaker|spk|paragraph|par)(%[0-9a-f][0-9a-f]|[\s\-_#=.])*[0-9]+')) AS o
  FROM train_sotto_lfm
), ents AS (
  SELECT DISTINCT id, corpus || '/' || CASE regexp_extract(o, '^[a-z]+') WHEN 'ctb' THEN 'contributor' WHEN 'spk' THEN 'speaker'
         WHEN 'par' THEN 'paragraph' ELSE regexp_extract(o, '^[a-z]+') END || ':' || CAST(CAST(regexp_extract(o, '[0-9]+$') AS BIGINT) AS VARCHAR) AS e
  FROM origins
)"""

P5_FOUND = f"""
WITH RECURSIVE {_ORIGINS.strip()},
ties AS (SELECT DISTINCT a.e AS x, b.e AS y FROM ents a JOIN ents b USING (id) WHERE a.e <> b.e),
reach AS (
  SELECT e AS x, e AS y FROM (SELECT DISTINCT e FROM ents)
  UNION
  SELECT r.x, t.y FROM reach r JOIN ties t ON r.y = t.x
), comp AS (SELECT x AS e, min(y) AS component FROM reach GROUP BY x),
member AS (SELECT DISTINCT id, component FROM ents JOIN comp USING (e)),
first AS (SELECT component, min(id) AS first_id FROM member GROUP BY component)
SELECT first_id, id FROM member JOIN first USING (component) WHERE id <> first_id
"""

# The composed form (NFC) gives the words of the compatibility form (NFKC) but for characters
# that don't occur in these tables.
_WORDS = r"regexp_extract_all(lower(nfc_normalize(coalesce({0}, ''))), '[\p{{L}}\p{{N}}]+')"

P2_FOUND = f"""
WITH s AS (SELECT id, list_distinct(list_concat({_WORDS.format('raw')}, {_WORDS.format('expected')})) AS w FROM train_sotto_lfm WHERE id IS NOT NULL),
t AS (SELECT DISTINCT id, len(w) AS n, w FROM s WHERE len(w) >= 8),
x AS (SELECT id, n, unnest(w) AS v FROM t)
SELECT a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON a.v = b.v AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n
HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))
"""

P5_BATCHES = f"""
WITH RECURSIVE {_ORIGINS.strip()},
ties AS (SELECT DISTINCT a.e AS x, b.e AS y FROM ents a JOIN ents b USING (id) WHERE a.e <> b.e),
reach AS (
  SELECT e AS x, e AS y FROM (SELECT DISTINCT e FROM ents)
  UNION
  SELECT r.x, t.y FROM reach r JOIN ties t ON r.y = t.x
), comp AS (SELECT x AS e, min(y) AS component FROM reach GROUP BY x),
member AS (SELECT DISTINCT id, component FROM ents JOIN comp USING (e)),
every AS (
  SELECT id, component FROM member
  UNION ALL SELECT DISTINCT id, 'id:' || id FROM train_sotto_lfm WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM member)
)
SELECT component, CAST(1 AS BIGINT) AS splits, count(*) AS records FROM every GROUP BY component
"""

P7_FOUND = f"""
WITH i AS (SELECT DISTINCT id, unnest([spoken, raw, expected]) AS t FROM heldout_cases),
iw AS (SELECT id, {_WORDS.format('t')} AS w FROM i WHERE t IS NOT NULL),
ig AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM iw WHERE len(w) >= 8),
dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM dw WHERE len(w) >= 8)
SELECT DISTINCT doc_id, id AS item_id FROM dg JOIN ig USING (g)
"""

_UNIT = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"

P4_SAMPLE = f"""
WITH members AS (
  SELECT DISTINCT 'cleanup_cases' AS table_name, id, {_CATEGORY.format('c')} AS category
  FROM (SELECT id, unnest(categories) AS c FROM cleanup_cases) WHERE c IS NOT NULL AND id IS NOT NULL
  UNION
  SELECT DISTINCT 'train_sotto_lfm', id, {_CORPUS.format('source_id')} FROM train_sotto_lfm WHERE source_id IS NOT NULL AND id IS NOT NULL
), sizes AS (
  SELECT 'cleanup_cases' AS table_name, count(DISTINCT id) AS n_ids FROM cleanup_cases
  UNION ALL SELECT 'train_sotto_lfm', count(DISTINCT id) FROM train_sotto_lfm
), wanted AS (
  SELECT t.*, CAST(ceil(greatest(t.min_rows, round(t.target_share * t.sample_fraction * s.n_ids, 6))) AS BIGINT) AS quota FROM sample_targets t JOIN sizes s USING (table_name)
), ranked AS (
  SELECT w.target_set, w.category, m.id, w.quota,
    row_number() OVER (PARTITION BY w.target_set, w.category ORDER BY {_UNIT.format("'sample' || chr(31) || w.target_set || chr(31) || m.category || chr(31) || m.id")}, m.id) AS r
  FROM wanted w JOIN members m ON m.table_name = w.table_name AND m.category = w.category
)
SELECT target_set, category, id FROM ranked WHERE r <= quota
"""

P8_MIX_BYTES = f"""
WITH d AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS tokens FROM documents),
sizes AS (SELECT source, sum(tokens) AS size FROM d WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT m.*, coalesce(s.size, 0) AS size FROM mix_targets m LEFT JOIN sizes s USING (source)),
total AS (SELECT mix_id, sum(size) * max(budget_ratio) AS total FROM t GROUP BY mix_id),
b AS (SELECT t.mix_id, t.source, t.size, least(t.target_share * total, CAST(t.max_repeats * t.size AS DOUBLE)) AS room FROM t JOIN total USING (mix_id)),
c AS (SELECT *, CAST(CASE WHEN size > 0 THEN floor(room / size) ELSE 0 END AS INTEGER) AS rounds FROM b),
e AS (SELECT *, greatest(room - rounds * size, 0.0) AS rest FROM c),
p AS (
  SELECT e.mix_id, e.source, d.doc_id, d.tokens, e.rounds, e.rest,
    coalesce(sum(d.tokens) OVER (PARTITION BY e.mix_id, e.source ORDER BY {_UNIT.format("'mix' || chr(31) || e.mix_id || chr(31) || d.doc_id")}, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN d ON d.source = e.source WHERE d.doc_id IS NOT NULL
)
SELECT mix_id, source, doc_id, CAST(rounds + CASE WHEN rest > 0 AND before + tokens <= rest THEN 1 ELSE 0 END AS INTEGER) AS repeats, tokens
FROM p WHERE rounds + CASE WHEN rest > 0 AND before + tokens <= rest THEN 1 ELSE 0 END > 0
"""

P6_BOUNDS = """
WITH one AS (SELECT DISTINCT result_id, prompt_variant, timings FROM cleanup_results),
leaf AS (
  SELECT prompt_variant, replace(substr(j.fullkey, 3), '"', '') AS metric, CAST(j.atom AS DOUBLE) AS v
  FROM one, json_tree(one.timings) AS j
  WHERE j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'DECIMAL')
)
SELECT prompt_variant, metric, count(*) AS n, count(*) >= 128 AS collapsed, true AS within FROM leaf GROUP BY prompt_variant, metric
"""

# As many tokens a character in every source, by which the answer doesn't change.
P8_FOUND = """
WITH sizes AS (SELECT source, sum(length(text)) AS size FROM documents WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT m.*, coalesce(s.size, 0) AS size FROM mix_targets m LEFT JOIN sizes s USING (source)),
total AS (SELECT mix_id, sum(size) * max(budget_ratio) AS total FROM t GROUP BY mix_id)
SELECT DISTINCT mix_id, source FROM t JOIN total USING (mix_id) WHERE max_repeats * size < target_share * total
"""

# Summaries are exact up to some thousands of values a group.
P6_PERCENTILES = """
WITH one AS (SELECT DISTINCT result_id, prompt_variant, timings FROM cleanup_results),
leaf AS (
  SELECT prompt_variant, replace(substr(j.fullkey, 3), '"', '') AS metric, CAST(j.atom AS DOUBLE) AS v
  FROM one, json_tree(one.timings) AS j
  WHERE j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'DECIMAL')
)
SELECT prompt_variant, metric, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90,
       quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, CAST(0 AS DOUBLE) AS rank_error
FROM leaf GROUP BY prompt_variant, metric
"""

SQL = {
    "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p4_sample": P4_SAMPLE, "p5_found": P5_FOUND, "p5_batches": P5_BATCHES, "p6_percentiles": P6_PERCENTILES,
    "p6_bounds": P6_BOUNDS, "p7_found": P7_FOUND, "p8_found": P8_FOUND, "p8_mix_bytes": P8_MIX_BYTES,
}
