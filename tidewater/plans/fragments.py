"""SQL fragments (DuckDB) that mirror the text functions."""

WORD = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"


def words(c: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), '{WORD}'), lambda x: lower(x))"


def joined(lst: str) -> str:
    return f"array_to_string({lst}, ' ')"


def normalized(c: str) -> str:
    return joined(words(c))


def overlap(c: str) -> str:
    return f"array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '{WORD}'), ' ')"


def tidy(c: str) -> str:
    return rf"regexp_replace(replace({c}, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g')"


def blank(c: str) -> str:
    return rf"NOT coalesce(regexp_matches({c}, '[^\s\p{{Z}}]'), false)"


def hash64(c: str) -> str:
    return f"CAST('0x' || substr(sha256({c}), 1, 16) AS UBIGINT)"


def ngrams(lst: str, n: int) -> str:
    many = f"list_distinct(list_transform(range(1, len({lst}) - {n - 2}), lambda i: array_to_string({lst}[i:i + {n - 1}], ' ')))"
    return f"CASE WHEN len({lst}) >= {n} THEN {many} WHEN len({lst}) > 0 THEN [array_to_string({lst}, ' ')] ELSE [] END"


LATEST_RESULTS = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) AS rn FROM cleanup_results WHERE result_id IS NOT NULL
  ) WHERE rn = 1
)"""

CASES = """
cases AS (
  SELECT id AS case_id, any_value(raw) AS raw, any_value(expected) AS expected, any_value(categories) AS categories,
         any_value(must_preserve) AS must_preserve, any_value(must_remove) AS must_remove
  FROM (SELECT id, raw, expected, categories, must_preserve, must_remove FROM cleanup_cases
        UNION ALL SELECT id, raw, expected, categories, must_preserve, must_remove FROM heldout_cases)
  GROUP BY id
)"""

PAIRS = LATEST_RESULTS + "," + CASES + """,
pairs AS (SELECT l.*, c.* EXCLUDE (case_id) FROM latest l JOIN cases c USING (case_id))"""

MEASURED = """
measured AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY engine, run_id, case_id, repeat_index ORDER BY ingested_at DESC) AS rn
    FROM stt_bench WHERE phase = 'measured' AND engine IS NOT NULL AND run_id IS NOT NULL AND case_id IS NOT NULL AND repeat_index IS NOT NULL
  ) WHERE rn = 1
)"""


# Components over near texts of k (key, t): equal folded texts, and pairs that reach one of the three
# thresholds where their word 3-grams are similar to 0.4 or the shorter one has at most 64 characters.
NEAR = f"""w AS (SELECT key, {words('t')} AS w FROM k), n AS (SELECT key, array_to_string(w, ' ') AS norm, w FROM w),
u AS (SELECT norm, min(key) AS key, any_value(w) AS w FROM n WHERE norm <> '' GROUP BY norm),
g AS (SELECT key, norm, {ngrams('w', 3)} AS g3, CASE WHEN length(norm) >= 5 THEN list_distinct(list_transform(range(1, length(norm) - 3), lambda i: substr(norm, i, 5))) ELSE [norm] END AS g5 FROM u),
x3 AS (SELECT key, len(g3) AS n, unnest(g3) AS g FROM g), c3 AS (SELECT a.key AS a, b.key AS b FROM x3 a JOIN x3 b ON a.g = b.g AND a.key < b.key GROUP BY a.key, b.key, a.n, b.n HAVING count(*) >= 0.4 * (a.n + b.n - count(*))),
short AS (SELECT a.key AS a, b.key AS b FROM g a JOIN g b ON a.key < b.key AND least(length(a.norm), length(b.norm)) <= 64 AND greatest(length(a.norm), length(b.norm)) <= 85),
c AS (SELECT * FROM c3 UNION SELECT * FROM short),
s AS (SELECT c.a, c.b, len(list_intersect(x.g3, y.g3)) AS i3, len(x.g3) AS n3, len(y.g3) AS m3, len(list_intersect(x.g5, y.g5)) AS i5, len(x.g5) AS n5, len(y.g5) AS m5, x.norm AS p, y.norm AS q
  FROM c JOIN g x ON x.key = c.a JOIN g y ON y.key = c.b),
near AS (SELECT a, b FROM s WHERE i3 >= 0.8 * (n3 + m3 - i3) OR i5 >= 0.8 * (n5 + m5 - i5) OR levenshtein(p, q) <= floor(0.1 * greatest(length(p), length(q)) + 1e-9)),
e AS (SELECT a, b FROM near UNION SELECT u.key, n.key FROM n JOIN u USING (norm) WHERE n.key <> u.key), links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT key AS x, key AS y FROM k UNION SELECT r.x, e.b FROM reach r JOIN links e ON r.y = e.a),
comp AS (SELECT x AS key, min(y) AS component FROM reach GROUP BY x)"""

# The same of all pairs that reach one of the three thresholds, whatever their words and lengths.
NEAR_WHOLE = (
    NEAR[: NEAR.index("x3 AS")]
    + """x3 AS (SELECT key, len(g3) AS n, unnest(g3) AS g FROM g), x5 AS (SELECT key, len(g5) AS n, unnest(g5) AS g FROM g),
near AS (SELECT a.key AS a, b.key AS b FROM x3 a JOIN x3 b ON a.g = b.g AND a.key < b.key GROUP BY a.key, b.key, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
  UNION SELECT a.key, b.key FROM x5 a JOIN x5 b ON a.g = b.g AND a.key < b.key GROUP BY a.key, b.key, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
  UNION SELECT a.key, b.key FROM g a JOIN g b ON a.key < b.key WHERE CASE WHEN abs(length(a.norm) - length(b.norm)) <= floor(0.1 * greatest(length(a.norm), length(b.norm)) + 1e-9)
    THEN levenshtein(a.norm, b.norm) <= floor(0.1 * greatest(length(a.norm), length(b.norm)) + 1e-9) ELSE false END),
"""
    + NEAR[NEAR.index("e AS (") :]
)
