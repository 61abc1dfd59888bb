import random


import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import components, curate, dedup, evaluate, folds, generate, prefix, sample, skew, trace


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(30)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)] + [(500, 500)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges + [(None, 1)], "src long, dst long")).collect()}
    up: dict[int, int] = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("per", [3, 1000])
def test_prefix_sums(spark, per):
    rows = [(g, i, i % 5 if i % 7 else None) for g in ("a", None) for i in range(50)]
    d = spark.createDataFrame(rows, "g string, i long, v long").withColumn("u", prefix.unit_hash("i"))
    got = prefix.prefix_sums(d, ["g"], "u", "i", "v", rows_per_bucket=per).toPandas()
    for _, x in got.groupby("g", dropna=False):
        x = x.sort_values(["u", "i"])
        assert x.before.tolist() == [0, *x.v.fillna(0).cumsum().astype(int).tolist()[:-1]]
    assert len(got) == 100


def test_prefix_sums_of_nothing(spark):
    d = spark.createDataFrame([], "g string, u double, i long, v long")
    assert prefix.prefix_sums(d, ["g"], "u", "i", "v").count() == 0


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 11}") for i in range(300)] + [(999, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("zz", 3)], "k string, x int")
    assert skew.hot_keys(left, "k", 0.3) == ["hot"]
    a = sorted(map(tuple, skew.salted_join(left, right, "k", "id").select("id", "x").collect()), key=str)
    b = sorted(map(tuple, left.join(right, "k", "left").select("id", "x").collect()), key=str)
    assert a == b


def test_latest_takes_the_last_delivery(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1), (None, "x", 5)], "id long, v string, at long")
    assert sorted(map(tuple, evaluate.latest(d, "id", "at").collect())) == [(1, "b", 2), (2, None, 1)]


def test_scores_and_rates(spark):
    cases = spark.createDataFrame([("c", "uh go now", "Go now.", ["fillers", "x"], ["Go"], ["uh"])], "id string, raw string, expected string, categories array<string>, must_preserve array<string>, must_remove array<string>")
    res = spark.createDataFrame([(1, "c", "Go now.", False, None), (2, "c", None, True, True), (3, "zz", "q", False, False)], "result_id long, case_id string, model_text string, used_fallback boolean, hit_output_token_limit boolean")
    p = evaluate.paired(res, evaluate.one_case(cases))
    r = evaluate.score_streams(p, []).first()
    assert (r.cases, r.exact_matches, r.anchors_kept, r.anchors_wanted, r.empties) == (2, 1, 1, 2, 1)
    assert {x.category: x.cases for x in evaluate.score_categories(p).collect()} == {"fillers": 2, "x": 2}
    assert [x.reasons for x in evaluate.failures(p).collect()] == [["exact_mismatch", "missing_preservation_anchor", "empty"]]
    assert {(x.kind, x.case_id) for x in evaluate.unmatched(res, evaluate.one_case(cases)).collect()} == {("unknown", "zz")}
    none = evaluate.score_streams(p.where("1 = 0"), ["case_id"])
    assert none.count() == 0
    m = evaluate.removal_scores(p, []).first()
    assert (m.cases, m.preserved, m.removed) == (2, 1, 2)


def test_percentile_flavours(spark):
    d = spark.createDataFrame([("g", float(i)) for i in range(1, 12)], "g string, v double")
    r = d.groupBy("g").agg(evaluate.nearest_rank("v", 0.9).alias("a"), evaluate.floor_rank("v", 0.9).alias("b"), evaluate.near_ceil_rank("v", 0.9).alias("c"), evaluate.interpolated("v", 0.9).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (10, 9, 10, 10)
    e = evaluate.ranked_exact(d, ["g"], "v", {"a": F.ceil(F.col("n") * 0.9), "b": F.floor(F.col("n") * 0.9)}).first()
    assert (e.n, e.a, e.b) == (11, 10, 9)


def test_speech_scores(spark):
    rows = [("e", "r", "measured", "c1", k, "It's 2.1", "it’s two 1", 100.0 * (k + 1)) for k in (0, 1)] + [("e", "r", "warmup", "c1", 0, "x", "y", 1.0)]
    d = spark.createDataFrame(rows, "engine string, run_id string, phase string, case_id string, repeat_index int, reference string, hypothesis string, inference_duration_ms double").withColumn("ingested_at", F.lit("2026-01-01"))
    m = evaluate.measured(d)
    w = evaluate.word_errors(m).first()
    assert (w.cases, w.reference_words, w.word_errors, w.wer) == (1, 3, 1, pytest.approx(1 / 3))
    c = evaluate.repeat_completeness(m).first()
    assert (c.cases, c.whole, c.least_repeats) == (1, 1, 2)
    assert evaluate.instability(m).first().unstable == 0


def test_compare_and_combine(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, t string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "q")], "k int, t string")
    assert {r.k: r.status for r in evaluate.compare_runs(a, b, ["k"], "t").collect()} == {1: "same", 2: "differs", 3: "same", 4: "only_right"}
    p = spark.createDataFrame([("a", 10, 5.0, 3), ("a", 30, 10.0, 1), ("b", None, 5.0, 1), ("b", 1, 1.0, None)], "t string, completion_tokens int, tokens_per_second double, first_token_ms int")
    r = {x.t: x for x in evaluate.combined_passes(p, ["t"]).collect()}
    assert (r["a"].tokens_per_second, r["a"].completion_tokens, r["a"].first_token_ms) == (8.0, 40, 1)
    assert r["b"].tokens_per_second is None and r["b"].completion_tokens is None
    assert [x.field for x in evaluate.single_value(p, [], ["t", "completion_tokens"]).orderBy("field").collect()] == ["completion_tokens", "t"]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "raw string, expected string, source_id string, label string")


def test_classification_and_routing(spark):
    d = pairs(
        spark,
        [
            ("all good here", "all good here", "sotto", ""),
            ("um send the the file", "Send the file.", "sotto", ""),
            ("the dose is 5 mg", "The dose is 5 mg.", "sotto", ""),
            ("we met", "We met Ana.", "sotto", ""),
            ("it may rain at 10", "It may rain at 10.", "nyra", ""),
            ("[noise] hello", "Hello.", "nyra", ""),
            ("one milk two eggs", "1. milk\n2. eggs", "sotto", "list_formatting"),
        ],
    )
    c = curate.declared_additions(curate.classified(curate.with_text_features(d)))
    r = curate.routed(c).collect()
    assert r[0].categories == ["no_op", "already_clean"] and (r[0].outcome, r[0].reason) == ("candidate", "pending_human_review")
    assert r[1].categories == ["fillers", "repetition", "mixed"] and r[1].outcome == "candidate"
    assert "high_stakes" in r[2].categories and r[2].reason == "high_stakes_domain"
    assert (r[3].outcome, r[3].reason) == ("quarantine", "lexical_addition_requires_review")
    assert r[4].reason == "high_risk_requires_explicit_review"
    assert (r[5].outcome, r[5].reason) == ("rejected", "out_of_domain_transcription_annotation")
    assert r[6].allowed == ["1", "2"]
    b = c.select(curate.bucket(ref="source_id").alias("b"), curate.crosscutting().alias("f")).collect()
    assert b[0].b == "clean_no_op" and b[1].b == "mixed_or_discourse" and "high_stakes" in b[2].f
    ops = pairs(spark, [("first milk", "1. milk", "", ""), ("stop period", "Stop.", "", ""), ("i gonna go", "I will go", "", ""), ("jason file", "JSON file", "", ""), ("x", "X", "", "")])
    assert [x.o for x in ops.select(curate.operation("raw", "expected").alias("o")).collect()] == ["list_formatting", "dictation_commands", "grammar", "misheard_words", ""]


def test_empty_table_is_classified(spark):
    c = curate.declared_additions(curate.classified(curate.with_text_features(pairs(spark, []))))
    assert curate.routed(c).count() == 0


def test_validation(spark):
    d = spark.createDataFrame(
        [("a", "uh go", "Go.", ["x"], ["Go"], ["uh"], "uh go"), ("b", "go", "Go now.", ["x", "x"], ["stop"], ["now"], None), (None, " ", None, [], None, None, "s")],
        "id string, raw string, expected string, categories array<string>, must_preserve array<string>, must_remove array<string>, spoken string",
    )
    v = {(r.id, r.rule) for r in curate.violations(d, "id", curate.case_rules()).collect()}
    assert v == {("b", r) for r in ("repeated_category", "preserve_absent", "remove_absent", "remove_survives", "spoken_missing")} | {(None, r) for r in ("blank_id", "blank_raw", "blank_expected", "no_category")}
    assert curate.duplicate_ids(d.union(d)).count() == 2
    twice = spark.createDataFrame([("Go, now", "x"), ("go now!", "X.")], "raw string, expected string")
    assert curate.duplicate_pairs(twice).first().n == 2
    s = spark.createDataFrame([("f", "train"), ("f", "dev"), ("g", "dev")], "fam string, split string")
    assert curate.crossing(s, "fam").first().fam == "f"


def test_reviews(spark):
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    d = spark.createDataFrame([("a", "approve", "x", "2026-01-01"), ("b", "approve", "x", "2026-01-01"), ("b", "reject", "y", "2026-01-02")], "id string, decision string, reviewer_ref string, reviewed_at string")
    assert {x.id: x.status for x in curate.reviewed(r, d).collect()} == {"a": "approved", "b": "pending", "c": "pending"}
    rules = curate.review_rules()
    rec = spark.sql("SELECT 'a' AS id, 'blind' AS split, named_struct('status','approved','reviewers',1,'adjudicated',false,'reviewed_at','2026-1-1','reviewer_refs',array('x','y')) AS review")
    assert {x.rule for x in curate.violations(rec, "id", rules).collect()} == {"review_blind_reviewers", "review_blind_adjudicated", "review_date", "review_refs"}


def test_near_groups(spark):
    base = "please bring the blue ladder back to the old barn before the storm arrives tonight"
    d = spark.createDataFrame(
        [(1, base, "f1"), (2, base + " friend", "f2"), (3, base.upper() + "!", "f3"), (4, "an unrelated note about tea", "f4"), (5, "something else entirely here", "f4"), (6, None, None), (7, "", None)],
        "id long, t string, fam string",
    )
    g = {r.key: r.component for r in dedup.text_groups(d, "id", "t", ("fam",), dedup.Thresholds(0.5, 0.5, 0.5)).collect()}
    assert g == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    only_edit = dedup.near_pairs(spark.createDataFrame([(1, "the train to zurich leaves at nine"), (2, "the train to zurich leaves at nime")], "id long, t string"), "id", "t", dedup.Thresholds(1.1, 1.1, 0.9)).collect()
    assert [(r.a, r.b) for r in only_edit] == [(1, 2)] and only_edit[0].edit >= 0.9


def test_near_pairs_of_a_large_family_equal_brute_force(spark):
    """300 near copies of one text, each given twice with a small edit, and short texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    shared = [word() for _ in range(90)]
    texts = []
    for _ in range(150):
        own = shared[:45] + [word() for _ in range(6)] + shared[45:]
        texts += [" ".join(own), " ".join(own[:-1] + [own[-1] + "x"])]
    texts += ["abcdefghi", "abcdefghij", "abcdefgxij", "abcd", "abce"] + [" ".join(word() for _ in range(n)) for n in range(1, 40)]
    many = dedup.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").select("a", "b").collect()
    got = {(r.a, r.b) for r in many}
    assert len(many) == len(got)

    def grams(x, n):
        return {tuple(x[i : i + n]) for i in range(max(1, len(x) - n + 1))}

    sets = [(grams(x.split(), 3), grams(x, 5)) for x in texts]

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i] + [0] * len(y)
            for j, e in enumerate(y, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != e))
        return row[-1]

    want = set()
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            near = any(len(p & q) >= 0.8 * len(p | q) for p, q in zip(sets[i], sets[j]))
            # Of the family, the grams decide; elsewhere short texts may be near by edits alone.
            if near or (i >= 300 and edits(texts[i], texts[j]) <= 0.1 * max(len(texts[i]), len(texts[j]))):
                want.add((i, j))
    assert len(want) > 40_000 and want <= got
    assert {p for p in got if p[0] >= 300} == {p for p in want if p[0] >= 300}


@pytest.mark.parametrize("indexed", [10, 0])
def test_contamination(spark, indexed):
    frozen = dedup.frozen_surfaces(spark.createDataFrame([("h1", "Meet Ana at 10:30 near the bridge", None), ("h2", "the quick brown fox jumps over the lazy dog today", "")], "id string, raw string, expected string"))
    d = spark.createDataFrame([(1, "meet ana at 10:30 near the bridge!"), (2, "Meet Bob at 11 near the bridge"), (3, "the quick brown fox jumps over the lazy dog now"), (4, "nothing alike"), (5, None)], "id long, t string")
    got = {(r.key, r.item) for r in dedup.contaminated(d, "id", ("t",), frozen, dedup.Thresholds(0.6, 0.8, 0.9), indexed=indexed).collect()}
    assert got == {(1, "h1"), (2, "h1"), (3, "h2")}
    assert [r.id for r in dedup.overlapping_exact(d, "id", ("t",), frozen).collect()] == [1]


def test_splits_and_pools(spark):
    d = spark.createDataFrame([(f"r{i}", f"f{i // 2}") for i in range(200)], "id string, fam string")
    s = sample.grouped_split(d, "id", F.col("fam"), {"train": 0.8, "dev": 0.1, "test": 0.1}, "1").toPandas()
    assert len(s) == 200 and s.groupby("family").split.nunique().max() == 1
    assert s.split.value_counts().to_dict() == {"train": 160, "dev": 20, "test": 20}
    c = sample.component_split(d.select(F.col("id").alias("key"), F.col("fam").alias("component")), 0.3, "x").toPandas()
    assert c.groupby("component").split.nunique().max() == 1 and 0.1 < (c.split == "dev").mean() < 0.5
    one = sample.single_pass(d, "id", "s").toPandas()
    assert sorted(one.ordinal) == list(range(1, 201)) and one.stream_id.nunique() == 200
    assert sample.top_by_hash(d, "fam", "id", 1, "q").count() == 100


def test_quotas(spark):
    rows = [(f"a{i}", "x", ["p"] if i < 5 else []) for i in range(40)] + [(f"b{i}", "y", []) for i in range(10)]
    d = spark.createDataFrame(rows, "id string, bucket string, flags array<string>")
    p = sample.pool(d, {"x": 6, "y": 2}, 0.0, {"p": 0.5}, 2, 1)
    assert p.where(F.array_contains("flags", "p")).count() == 5
    got = sample.choose(p, {"x": 6, "y": 2}, {"p": 0.5}, 1, "train").collect()
    assert sorted(r.bucket for r in got) == ["x"] * 6 + ["y"] * 2 and sum("p" in r.flags for r in got) >= 4
    assert got == sample.choose(p, {"x": 6, "y": 2}, {"p": 0.5}, 1, "train").collect()
    with pytest.raises(ValueError):
        sample.choose(p, {"x": 6, "y": 99}, {}, 1, "train")


def test_folds(spark):
    d = spark.createDataFrame([(0, i, n, c) for i, (n, c) in enumerate([(4, 900), (5, 900), (5, 901), (8, 901)])], "shard int, ordinal int, n int, cap int")
    assert [r.batch for r in folds.batched(d, "n", "cap", 3, 12).orderBy("ordinal").collect()] == [0, 0, 1, 2]
    p = folds.packed(d, "n", 10).orderBy("ordinal").collect()
    assert [(r.pack, r.segment, r.start) for r in p] == [(0, 0, 0), (0, 1, 4), (1, 0, 0), (2, 0, 0)]
    r = folds.packing_report(folds.packed(d, "n", 10), "n", 10).first()
    assert (r.packs, r.examples, r.tokens, r.fullest) == (3, 4, 22, 9)


def test_intervals(spark):
    rng = random.Random(5)
    a = [(rng.randint(0, 500), rng.randint(0, 60)) for _ in range(60)]
    b = [(rng.randint(0, 500), rng.randint(1, 60), 1.0) for _ in range(60)]
    got = trace.overlaps(spark.createDataFrame(a, "ts long, dur long"), spark.createDataFrame(b, "ts long, dur long, energy_delta double"), 37)
    want = sorted((s, d, t, e, min(s + d, t + e) - max(s, t)) for s, d in a for t, e, _ in b if d > 0 and min(s + d, t + e) > max(s, t))
    assert sorted(map(tuple, got.select("ts", "dur", "r_ts", "r_dur", "overlap").collect())) == want
    s = spark.createDataFrame([("run", 0, 10), ("run", 100, 50)], "name string, ts long, dur long")
    c = spark.createDataFrame([(1, 5, 1.0), (1, 120, 2e6), (1, 150, 5e6), (1, 151, 9e6)], "track_id int, ts long, energy_since_boot double")
    e = trace.rail_energy(trace.within_longest(s, c, "run"), spark.createDataFrame([(1, "GPU")], "track_id int, subsystem string")).first()
    assert (e.samples, e.joules) == (2, 3.0)


def test_generator(spark):
    frames = [generate.Frame("uh {verb} the {thing}", "{verb} the {thing}.", ("fillers",)), generate.Frame("{verb} {verb} the {thing}", "{verb} the {thing}.", ("repetition",))]
    g = generate.pairs(spark, "demo", frames, 6, {"verb": ["send", "keep"], "thing*": ["plan", "map", "key"]}, {"thing*": 2}, 1).collect()
    assert len(g) == 12 and len({r.id for r in g}) == 12 and len({r.family_id for r in g}) == 6
    with pytest.raises(Exception, match="adds words"):
        generate.pairs(spark, "bad", [generate.Frame("{a}", "{a} more")], 1, {"a": ["x"]}, {}, 0).collect()


def test_jobs_order():
    assert sample.jobs(3, 1, 1) == [(0, "warmup", 0), (1, "measured", 0), (2, "measured", 0), (0, "measured", 0)]


def test_identities(spark):
    d = spark.createDataFrame([("s", "s:f:1", "Meet at 10", ""), ("s", "s:f:2", "Meet at 11", "")], "source_id string, source_ref string, expected string, label string")
    r = curate.record_ids(d).collect()
    assert r[0].template_id == r[1].template_id and r[0].family_id != r[1].family_id and r[0].record_id != r[1].record_id


def test_shares_and_shortfall(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert {r.k: r.share for r in sample.shares(d, "k").collect()} == {"a": 0.5, "b": 0.25, None: 0.25}
    t = spark.createDataFrame([("a", 1), ("b", 3), ("z", 1)], "k string, required int")
    have = d.groupBy("k").agg(F.count("*").alias("available"))
    assert {r.k: r.missing for r in curate.shortfall(have, t, "k").collect()} == {"b": 2, "z": 1}
    assert T.ratio is not None


def test_shards(spark):
    from tidewater.operators import shards

    c = spark.createDataFrame([("zeta", 0), ("alpha", 1), ("middle", 2)], "case_id string, source_index int")
    r = c.withColumns({"shard_index": T.shard_of("case_id", 3), "shard_count": F.lit(3), "evaluation_fingerprint": F.lit("f")})
    assert [x.case_id for x in shards.merged(r, c, 3).collect()] == ["zeta", "alpha", "middle"]
    for bad, why in ((r.union(r.limit(1)), "repeated"), (r.where("case_id <> 'zeta'"), "missing"), (r.withColumn("shard_count", F.lit(4)), "wrong_shard"), (r.withColumn("evaluation_fingerprint", F.col("case_id")), "several_settings")):
        with pytest.raises(shards.ShardError, match=why):
            shards.merged(bad, c, 3)
    assert [x.case_id for x in shards.remaining(c, c.where("source_index < 1")).orderBy("source_index").collect()] == ["alpha", "middle"]
    with pytest.raises(shards.ShardError):
        shards.remaining(c, c.where("source_index = 1"))
    assert shards.fingerprint({"a": 1, "b": 2}) == shards.fingerprint({"b": 2}, {"a": 1})
    with pytest.raises(shards.ShardError):
        shards.fingerprint({"a": 1}, {"a": 2})
    import hashlib

    assert shards.ordered_digest(c, "case_id", "source_index").first().digest == hashlib.sha256(b"zeta\nalpha\nmiddle\n").hexdigest()
    one = spark.createDataFrame([("s", "p"), ("s", None)], "run_source string, prompt_variant string")
    assert {x.run_label for x in shards.runs(one, "L").collect()} == {"L:p", "L:default"}


def test_global_rank(spark):
    rng = random.Random(2)
    v = [rng.random() for _ in range(500)]
    d = spark.createDataFrame([(x,) for x in v], "v double").repartition(7)
    got = sorted((r["rank"], r.v) for r in prefix.global_rank(d, "v").collect())
    assert got == list(enumerate(sorted(v)))
    assert prefix.global_rank(d.where("v > 2"), "v").count() == 0
