"""Contracts between tables and reviews, on small and odd tables."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import curate, dedup, evaluate, review
from tidewater.plans import documents


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_subsets_and_members(spark):
    d = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "id string, n int")
    assert rows(review.case_subset(d, ["b", "a", "b"])) == [("a", 1), ("b", None)]
    with pytest.raises(review.ContractError, match="unknown cases: z"):
        review.case_subset(d, ["a", "z"])
    review.same_members(d.where("id = 'a'"), d.where("n = 1"), "id")
    with pytest.raises(review.ContractError, match="left only: b"):
        review.same_members(d.where("id IS NOT NULL"), d.where("n = 1"), "id")
    with pytest.raises(review.ContractError, match="repeated: a"):
        review.same_members(d.where("n = 1").union(d.where("n = 1")), d.where("n = 1"), "id")
    with pytest.raises(review.ContractError):
        review.refuse_blind("/data/Blind/x.jsonl")
    with pytest.raises(review.ContractError, match="blind records"):
        review.refuse_blind("x", spark.createDataFrame([("train",), ("blind",)], "split string"))


def test_equal_fields(spark):
    a = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "id string, n int, t string")
    b = spark.createDataFrame([("a", 1, None), ("b", 5, "z"), ("d", 3, "y")], "id string, n int, t string")
    assert rows(review.equal_fields(a, b, "id", ["n", "t"])) == [("b", "n"), ("b", "t"), ("c", "missing"), ("d", "unexpected")]
    assert review.require_equal(a, a, "id", ["n", "t"]).count() == 3
    with pytest.raises(review.ContractError, match="differs: b, n"):
        review.require_equal(a.where("id = 'b'"), b.where("id = 'b'"), "id", ["n"])
    jobs = spark.createDataFrame([(0, "a"), (1, "x"), (2, "c"), (3, "d")], "place long, id string")
    assert rows(review.positional(a, jobs, ["id"], "place", ["id"])) == [(1, "id"), (3, "missing")]


CASE = "id string, raw string, expected string, must_preserve array<string>"


def test_evaluation_cases(spark):
    c = spark.createDataFrame([("a", "um go", "Go.", ["Go"]), ("b", "x y", "X y.", None)], CASE)
    j = spark.createDataFrame([("a", "um go", "go", "r"), ("b", "x y", "x y", "r")], "case_id string, raw_stt string, model_input string, run_id string")
    assert [(r.id, r.raw, r.source_raw) for r in review.evaluation_cases(c, j).orderBy("id").collect()] == [("a", "go", "um go"), ("b", "x y", "x y")]
    with pytest.raises(review.ContractError, match="anchor absent"):
        review.evaluation_cases(c.withColumn("expected", F.lit("Stay.")), j)
    with pytest.raises(review.ContractError, match="no input"):
        review.evaluation_cases(c, j.withColumn("model_input", F.lit(" ")))
    with pytest.raises(review.ContractError, match="left only"):
        review.evaluation_cases(c, j.where("case_id = 'a'"))


def test_reviews(spark):
    c = spark.createDataFrame([("a", "r", "e"), ("b", "r", None)], "case_id string, raw string, expected string")
    r = spark.createDataFrame([("a", "r", "e", " e "), ("b", "r", None, None)], "case_id string, raw string, expected string, model_text string")
    q = review.review_queue(c, r)
    assert {x.case_id: x.exact for x in q.collect()} == {"a": True, "b": None}
    with pytest.raises(review.ContractError, match="other texts: a"):
        review.review_queue(c, r.withColumn("raw", F.when(F.col("case_id") == "a", "s").otherwise(F.col("raw"))))
    with pytest.raises(review.ContractError, match="unknown case: a"):
        review.review_queue(c.where("case_id = 'b'"), r)
    done = q.withColumns({k: F.lit(True) for k in review.JUDGED} | {"reviewer_ref": F.lit("r1"), "reviewed_at": F.lit("2026-01-02")})
    s = review.review_summary(done).first()
    assert (s.records, s.reviewers, s.unsafe, s.passes) == (2, 1, 0, True) and review.review_problems(done).count() == 0
    open_ = review.review_summary(q).first()
    assert open_.unsafe == 2 and not open_.passes and review.unsafe_cases(q).count() == 2
    assert {x.rule for x in review.review_problems(q).collect()} == {"unjudged", "no_reviewer", "no_date"}
    none = review.review_summary(q.where("1 = 0")).first()
    assert none.records == 0 and none.passes
    d = spark.createDataFrame([("a", "r1")], "id string, reviewer_ref string")
    queue = spark.createDataFrame([("a", "r1"), ("a", "r2"), (None, "r1")], "id string, reviewer_ref string")
    assert rows(review.pending(queue, d)) == [("a", "r2"), (None, "r1")]
    with pytest.raises(review.ContractError, match="repeated decision"):
        review.pending(queue, d.union(d))


def test_record_rules(spark):
    full = {
        "id": "i", "raw": "um go to Ana", "expected": "Go to Ana.", "source": "public_corpus", "source_ref": "s:f:1", "family_id": "f", "template_id": "t", "split": "train", "license": "l", "generator_version": "g",
        "categories": ["fillers"], "must_preserve": ["Ana"], "must_remove": ["um"], "risk_tags": [], "allowed_additions": None, "speaker_id": None, "session_id": None,
    }
    lists = {"categories", "must_preserve", "must_remove", "risk_tags", "allowed_additions"}
    schema = ", ".join(f"{k} {'array<string>' if k in lists else 'string'}" for k in full)
    allowed = {"categories": ["fillers"], "risk_tags": ["name"], "split": ["train"], "source": ["public_corpus"]}

    def broken(**change):
        d = spark.createDataFrame([tuple((full | change).values())], schema)
        return {x.rule for x in curate.violations(d.withColumn("key", F.lit(1)), "key", review.record_rules(allowed, d.columns)).collect()}

    assert broken() == set()
    assert broken(expected="Go to Bo.") == {"preserve_absent", "added_words"}
    assert broken(expected="Go to Bo.", must_preserve=[], allowed_additions=["Bo"]) == set()
    assert broken(categories=["fillers", "fillers", "other", " "]) == {"categories_repeated_item", "categories_unknown", "categories_blank_item"}
    assert broken(categories=None, must_remove=None) >= {"categories_missing", "must_remove_missing"}
    assert broken(split="blind", source="x", source_ref=None) == {"split_unknown", "source_unknown", "source_ref_required"}
    assert broken(source="consented_real_stt") >= {"consent_fields", "canary_split", "source_unknown"}
    assert broken(raw=None, id=" ") >= {"raw_missing", "id_missing"}
    assert broken(expected="Go to Ana, café.", allowed_additions=["café"]) == {"denormal"}
    d = spark.createDataFrame([("a", "b c", "b c"), ("x", "b", "b z")], "id string, raw string, expected string")
    assert review.without_added_words(d.where("id = 'a'"), "id").count() == 1
    with pytest.raises(review.ContractError, match="added words: x, z"):
        review.without_added_words(d, "id")


def test_candidate_records(spark):
    d = spark.createDataFrame([("sotto", "sotto:f:1", "um go to Ana", "Go to Ana.", ""), ("nyra", None, "", "", "")], "source_id string, source_ref string, raw string, expected string, label string")
    r = {x.raw: x for x in review.candidate_records(d).collect()}
    assert r["um go to Ana"].must_remove == ["um"] and "Ana" in r["um go to Ana"].must_preserve and r["um go to Ana"].split == "train" and len(r) == 2


def test_summaries_of_odd_groups(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), ("n", None)], "g string, value double")
    got = {r.g: r for r in evaluate.timing_summary(d.withColumn("metric", F.lit("m")), ["g"]).collect()}
    assert got["a"].n == 2 and got["a"].median == 1.5 and got["a"].p95 == 2.0 and got["a"].mean == 1.5
    assert got[None].median == 5.0 and got["n"].n == 0 and got["n"].median is None
    assert evaluate.timing_summary(d.where("1 = 0").withColumn("metric", F.lit("m")), ["g"]).count() == 0
    many = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    r = {x.g: x for x in evaluate.percentiles_exact(many, ["g"], "v", {"p90": 0.9}, {"mid": 0.5}).collect()}
    for g in (0, 1):
        v = sorted(i * 7919 % 1000 for i in range(1000) if i % 2 == g)
        assert r[g].p90 == v[449] and r[g].mid == (v[249] + v[250]) / 2
    host = spark.createDataFrame([("m", 10.0, 110.0, 20), ("m", None, 50.0, 5), ("k", None, None, None)], "model string, ttft_ms double, total_ms double, output_tokens int")
    h = {x.model: x for x in review.host_summary(host, ["model"]).collect()}
    assert h["m"].rate_median == 200.0 and h["m"].requests == 2 and h["k"].rate_p10 is None


def test_texts_of_no_words_and_repeats_in_near_pairs(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "--"), (4, "one"), (5, "ONE!"), (6, "one two"), (7, "x " * 20_000)], "id long, t string")
    g = {r.key: r.component for r in dedup.text_groups(d, "id", "t").collect()}
    assert g[4] == g[5] == 4 and g[1] == 1 and g[2] == 2 and g[6] == 6 and len(g) == 7
    assert dedup.near_pairs(d.where("1 = 0"), "id", "t").count() == 0


def test_texts_that_share_some_grams_are_no_candidates(spark):
    """Of texts that have a sentence or two in common no pairs are written; similar ones stay."""
    word = lambda i, k: f"{'abcdefghij'[i % 10]}{i * 31 + k}x"
    texts = [" ".join([*(word(i, k) for k in range(40)), *(f"s{i % 7}w{k}" for k in range(8)), *(f"t{i % 5}w{k}" for k in range(8))]) for i in range(0, 400, 2)]
    texts += [texts[0] + " more", texts[7].replace("s0w3", "other")]
    f = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    got = rows(dedup.gram_pairs(f, dedup.word_grams, 0.4))
    assert (0, 200) in got and (7, 201) in got and len(got) < 20


def test_long_texts_need_common_words_to_be_near(spark):
    a = "median latency moved from 8640 to 23 milliseconds once the receipt was cached"
    b = "median latency moved from 8 to 66 milliseconds once the receipt was cached"
    assert dedup.near_pairs(spark.createDataFrame([(1, a), (2, b)], "id long, t string"), "id", "t").count() == 0
    assert dedup.near_pairs(spark.createDataFrame([(1, a), (2, a.replace("8640", "8641"))], "id long, t string"), "id", "t").count() == 1


def test_signatures_of_passes_leave_no_files(spark, monkeypatch):
    """However many passes are made, the rarest grams and the pairs of the passes go from disk."""
    texts = [" ".join(f"{c}{i % 70}" for c in "abcdefghij") + f" {i}" for i in range(300)]
    f = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    want = rows(dedup.gram_pairs(f, dedup.word_grams, 0.4))
    monkeypatch.setattr(dedup, "PASS", 30)
    kept = session._written[spark.sparkContext.applicationId]
    before = set(kept)
    got = dedup.gram_pairs(f, dedup.word_grams, 0.4)
    assert rows(got) == want and len(want) > 100
    assert len(set(kept) - before) == 1


def test_texts_of_other_words_are_near_by_characters_and_edits(spark, monkeypatch):
    """Without a bound on common words every pair that reaches a threshold is found, in blocks of any size."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(3, 8)))

    def edited(x, k):
        x = list(x)
        for p in sorted(rng.sample(range(len(x)), k), reverse=True):
            x[p : p + 1] = rng.choice(([], [x[p], "z"], ["q"]))
        return " ".join("".join(x).split())

    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(24)] + ["ab", "cd", "abcdefghij", "abcdefghix", "x " * 700 + "x", "x " * 702 + "x"]
    texts += [edited(x, int(len(x) * share)) for x in texts[:24] for share in (0.06, 0.09, 0.1, 0.11)]
    texts = sorted({*texts} - {""})

    @functools.cache
    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i] + [0] * len(y)
            for j, e in enumerate(y, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != e))
        return row[-1]

    grams = lambda x, n: {tuple(x[i : i + n]) for i in range(max(1, len(x) - n + 1))}
    sets = [(grams(x.split(), 3), grams(x, 5)) for x in texts]
    want, far = set(), 0
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            alike = [len(p & q) / len(p | q) for p, q in zip(sets[i], sets[j])]
            longest = max(len(texts[i]), len(texts[j]))
            few = abs(len(texts[i]) - len(texts[j])) <= 0.1 * longest
            if max(alike) >= 0.8 or (few and edits(texts[i], texts[j]) <= 0.1 * longest):
                want.add((i, j))
                far += alike[0] < 0.4 and min(len(texts[i]), len(texts[j])) > 64
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {(r.a, r.b) for r in dedup.near_pairs(d, "id", "t", candidate=None).collect()} == want and far > 50
    monkeypatch.setattr(dedup, "HELD", 10_000)
    both = dedup.edit_pairs(d.select("id", F.col("t").alias("norm")), 0.9).collect()
    assert len(both) == len({(r.a, r.b) for r in both}) and {(i, j) for i, j in want if edits(texts[i], texts[j]) <= 0.1 * max(len(texts[i]), len(texts[j]))} <= {(r.a, r.b) for r in both}


def test_documents_need_no_common_words_to_be_near(spark):
    a = "median latency moved from 8640 to 23 milliseconds once the receipt was cached"
    d = spark.createDataFrame([(1, a), (2, a.replace("8640", "8").replace("23", "66")), (3, "an unrelated note")], "doc_id long, text string")
    assert {r.doc_id: r.component for r in documents.doc_near_components(d).collect()} == {1: 1, 2: 1, 3: 3}
