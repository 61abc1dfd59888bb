"""The operators of the nine problems against brute force, and on odd tables."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.wordcut import words
from tidewater.llm import answers, leakage, mixing, names, neardup, pair_rules, pairs, quantiles, residue, residue_rules, sampling, splits, trie, truncation

RESULT = "result_id bigint, case_id string, run_source string, model_name string, prompt_variant string, model_text string, timings string, finish_reason string, max_output_tokens int, hit_output_token_limit boolean, completion_tokens int, finished_at timestamp, ingested_at timestamp, raw string"
CASE = "id string, spoken string, raw string, expected string, categories array<string>, must_preserve array<string>, must_remove array<string>, model_text string"
TRAIN = "id string, source_id string, source_ref string, raw string, expected string, component string, key bigint"
DOC = "doc_id bigint, text string, source string, kind string, tmpl string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def cases(spark, data):
    return spark.createDataFrame([(i, None, raw, exp, None, None, None, "clash") for i, raw, exp in data], CASE)


def results(spark, data):
    return spark.createDataFrame([(i, c, src, "m", None, t, None, None, cap, None, n, None, None, "clash") for i, c, src, t, n, cap in data], RESULT)


# ---- 1 and 3 ------------------------------------------------------------------------------

EXP = "The old bridge near Hallam closes at nine. Bring the blue folder and the second key. Nobody knows who will paint it."
RAW = "um the old bridge near Hallam closes at at nine bring the blue folder and the second key nobody knows who will paint it"


@pytest.mark.parametrize(
    "text,want",
    [
        (EXP, None),
        (EXP[:-1], None),
        (EXP[:60], "word"),  # ... the blue fo
        (EXP[:58], "words"),  # ... the blue
        (EXP[:42], "words"),  # ... at nine.
        ("Result:\n" + EXP[:50] + "...", "word"),  # Bring t
        (EXP[:57] + " (truncated)", "words"),
        (EXP[:61] + "&am", "word"),
        (EXP[:61] + "\\u00", "word"),
        (EXP[:61] + "�", "word"),
        (EXP[:57] + "�", "words"),
        (RAW, None),
        (RAW[: RAW.index(" folder")], "words"),
        (EXP.replace("paint it", "paint lamp"), None),
        (EXP.replace("blue folder", "green folder"), None),
        ("I must decline to help with that request", None),
        ("Am Freitag kommt der Koffer aus dem Bür", None),
        ("...", None),
        (EXP + " Let me know", None),
    ],
)
def test_cut_short(text, want):
    assert answers.cut_short(text, words(EXP), words(RAW)) == want


def test_an_expected_ellipsis_is_complete():
    e = "We should go now. But I don't know if..."
    assert answers.cut_short(e, words(e), words("uh we should go now but I don't know if")) is None


def test_spikes_and_cut_results(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    data, cs = [], []
    for i in range(400):
        full = " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30))) + "."
        cs.append((f"c{i}", full, full))
        data.append((i, f"c{i}", "web", full[:80], 5, 900))
        data.append((1000 + i, f"c{i}", "free", full, 5, 900))
    data += [(0, "c0", "web", data[0][3], 5, 900), (5000, "unknown", "web", "no end here", 1, 9), (5001, "c1", None, None, None, None), (5002, None, "web", "x", 1, 1), (5003, "c3", "web", "", 1, 1)]
    r, c = results(spark, data), cases(spark, cs)
    spikes = {(s.source, s.measure, s.value) for s in truncation.length_spikes(r).collect()}
    assert ("web", "chars", 80) in spikes and not any(s == "free" for s, _, _ in spikes)
    want = {i for i, cid, src, t, *_ in data if src == "web" and cid and cid.startswith("c") and t and words(t) != words(dict((a, b) for a, b, _ in cs)[cid])}
    got = truncation.cut_results(r, c).collect()
    assert {x.result_id for x in got} == want and len(got) == len(want) and all(x.at_spike for x in got)
    rep = {x.run_source: x for x in truncation.truncation_report(r, c).collect()}
    assert rep["web"].truncated == len(want) and rep["free"].truncated == 0 and rep[None].results == 1


@pytest.mark.parametrize(
    "text,want",
    [
        (None, ["empty"]), ("", ["empty"]), ("​\n", ["empty"]), ("N/A", ["empty"]), ("<no output>", ["empty"]), ("Output:", ["empty"]), ("```\n```", ["empty"]),
        (EXP, []), (EXP[:60], ["truncated"]),
        ("I'm sorry, but I can't help with that request.", ["refusal"]), ("Lo siento, no puedo procesar este texto.", ["refusal", "other_language"]), ("Es tut mir leid, ich kann das nicht bearbeiten.", ["refusal", "other_language"]),
        ("Désolé, je ne peux pas traiter ce texte.", ["refusal", "other_language"]),
        (RAW, ["copied"]), ("Transcript: " + RAW.upper() + "!", ["copied"]), (RAW + "\n" + RAW, ["copied"]),
        ("Die alte Brücke ist noch nicht fertig und der Schlüssel liegt im Büro.", ["other_language"]), ("Peut-être que le pont est déjà près de la gare avec la clé.", ["other_language"]),
        (RAW[: RAW.index(" knows")] + " is sure", ["truncated", "copied_prefix"]), (EXP.replace("folder", "(folder"), ["unclosed"]), (EXP[:-4] + "«it", ["unclosed"]),
        ("Старый мост закрывается в девять часов вечера", ["other_language"]),
        ("The old bridge near Hallam opens at ten. Bring a red folder and a third key. Nobody knows who will paint it.", []),
    ],
)
def test_defects(text, want):
    assert pair_rules.defects(text, EXP, RAW) == want


def test_a_dictated_refusal_is_content():
    e = "Unfortunately I cannot attend the meeting on Friday. Please tell Ana."
    assert pair_rules.defects("Unfortunately I cannot attend the meeting on Friday. Please tell Anna.", e, "um unfortunately I cannot attend the meeting on friday please tell Ana") == []
    assert pair_rules.defects("same words", "same words", "same words") == []
    mixed = "The playlist isn't ready but the badge is. They wrote: “ich habe ihm gesagt dass der Schlüssel nach Hause muss und die Nummer nicht auf der Karte steht”."
    assert pair_rules.defects("Das kostet nicht viel und am Freitag kommt der Koffer mit dem Beleg aus der Stadt.", mixed, "um " + mixed) == ["other_language"]
    assert pair_rules.unclosed("a (b") and not pair_rules.unclosed("a (b) “c”")


def test_pairs_on_odd_rows(spark):
    c = cases(spark, [("c", RAW, EXP), ("c", RAW, EXP), ("n", None, None)])
    r = results(spark, [(1, "c", "s", EXP, 1, 9), (2, "c", "s", None, 1, 9), (2, "c", "s", None, 1, 9), (3, "zz", "s", " ", 1, 9), (4, "n", "s", "some text", 1, 9), (None, "c", "s", "", 1, 9), (5, "c", None, EXP[:60], 1, 9)])
    assert rows(pairs.first_defects(r, c)) == [(2, "empty"), (3, "empty"), (5, "truncated")]
    assert pairs.first_defects(r.where("1 = 0"), c).count() == 0
    long = results(spark, [(9, "c", "s", "word " * 200_000, 1, 9)])
    assert pairs.first_defects(long, c).count() == 0


def test_every_triggered_defect_is_reported(spark):
    german = "Die alte Brücke ist noch nicht fertig und der Schlüssel liegt im Büro bei der Post."
    c = cases(spark, [("g", "ähm " + german, german), ("q", "um bring it (the red one)", "Bring it (the red one).")])
    r = results(spark, [(1, "g", "s", "I'm sorry, but I can't help you with that request.", 1, 9), (2, "q", "s", "Bring it (the red one.", 1, 9), (3, "q", "s", "Bring it (the red one).", 1, 9)])
    assert {x.result_id: x.defects for x in pairs.defective_pairs(r, c).collect()} == {1: ["refusal", "other_language"], 2: ["unclosed"]}
    assert rows(pairs.first_defects(r, c)) == [(1, "refusal")]
    assert {(x.defect, x.results) for x in pairs.defect_report(r, c).collect()} == {("refusal", 1), ("other_language", 1), ("unclosed", 1)}


# ---- 2 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (12, 2)).astype(np.uint64)
    noise = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (150, 2, 3)).astype(np.uint64), axis=2)
    prints = base[rng.integers(0, 12, 150)] ^ noise * (rng.random((150, 2)) < 0.5).astype(np.uint64)
    sizes, roots = rng.integers(10, 60, 150), np.sort(rng.integers(0, 5, 150))
    order = np.lexsort((*prints.T[::-1], roots))
    prints, sizes, roots = prints[order], sizes[order], roots[order]
    budget = trie.Budget(7, 10)
    t = trie.Trie(roots, prints, sizes)
    k = np.arange(len(t.starts[0]))
    old, trie.FRONTIER = trie.FRONTIER, 50
    x, y = t.join(k, k, budget)
    trie.FRONTIER = old
    want = set()
    for i in range(150):
        for j in range(i + 1, 150):
            s, u = int(sizes[i]), int(sizes[j])
            if roots[i] == roots[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= (s + u) * 3 // 17 and 10 * min(s, u) >= 7 * max(s, u):
                want.add((i, j))
    assert {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())} == want and len(x) == len(want)


def test_trie_prunes_families():
    """Forty families of fifty like rows: node pairs are visited instead of all row pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    prints = np.repeat(base, 50, axis=0)
    prints[:, 1] ^= np.uint64(1) << rng.integers(0, 12, len(prints)).astype(np.uint64)
    prints = prints[np.lexsort(prints.T[::-1])]
    n = len(prints)
    t = trie.Trie(np.zeros(n, int), prints, np.full(n, 30))
    x, _ = t.join(np.array([0]), np.array([0]), trie.Budget(7, 10))
    assert len(x) == 40 * 50 * 49 // 2 and t.visited < n * n / 10


def records(seed, n=160):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(25)], [f"r{i}" for i in range(900)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(rare)
        else:
            w = [rng.choice(common) for _ in range(rng.randint(4, 30))] + [rng.choice(rare) for _ in range(rng.randint(0, 12))]
        out.append((f"id{i:04d}", " ".join(w)))
    return out


@pytest.mark.parametrize("seed,tile", [(1, 4096), (2, 4096), (3, 16)])
def test_near_pairs_equal_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(trie, "TILE", tile)
    data = records(seed)
    d = spark.createDataFrame([(i, "s", None, t, None, "x", 1) for i, t in data] + [(None, None, None, data[0][1], None, None, None), ("e", None, None, "", None, None, None), ("n", None, None, None, None, None, None), (data[0][0], "s", None, data[0][1], None, "x", 1)], TRAIN)
    want = set()
    for k, (i, a) in enumerate(data):
        for j, b in data[:k]:
            x, y = set(words(a)), set(words(b))
            if min(len(x), len(y)) >= 8 and 10 * len(x & y) >= 7 * len(x | y):
                want.add((min(i, j), max(i, j)))
    got = rows(neardup.near_pairs(d))
    assert got == sorted(want) and len(want) > 50
    g = neardup.near_groups(d).collect()
    assert {r.id for r in g} == {i for p in want for i in p} and all(r.group_id <= r.id for r in g)


def tiles_of(sets, num=7, den=10, tile=1 << 16, turns=1):
    """What the tiles of the sets find, without Spark, and the pairs that are looked at."""
    keys = [i * 7919 << 4 | 5 for i in range(len(sets))]
    counts = np.bincount(np.concatenate(sets) % 4096, minlength=4096)
    budget = trie.Budget(num, den)
    classes = pd.DataFrame({"key": keys, "words": [np.array(sorted(x), np.int64) for x in sets]})
    signed = list(neardup._signatures(SimpleNamespace(value=counts), budget)(iter([classes])))
    found, visited = set(), 0
    for turn in range(turns):
        t = pd.concat(trie._tiled(budget, tile, turn, turns)(iter(signed))).sort_values("tile", kind="stable").reset_index(drop=True)
        done = trie.Tiles(t, budget)
        found |= set(map(tuple, done.pairs().to_numpy().tolist()))
        visited += done.visited
    return keys, found, visited


@pytest.mark.parametrize("num,den,split,rest,tile,turns", [(7, 10, 96, 64, 1 << 16, 1), (7, 10, 3, 64, 1 << 16, 2), (7, 10, 3, 64, 30, 3), (1, 2, 3, 5, 1 << 16, 1), (9, 10, 2, 4, 20, 2)])
def test_tiles_lose_no_pair(monkeypatch, num, den, split, rest, tile, turns):
    monkeypatch.setattr(trie, "SPLIT", split)
    monkeypatch.setattr(trie, "REST", rest)
    rng = random.Random(split + tile)
    vocab, sets = [rng.getrandbits(62) for _ in range(60)], []
    for _ in range(300):
        w = set(rng.choice(sets)) if sets and rng.random() < 0.6 else {rng.choice(vocab) for _ in range(rng.randint(1, 30))}
        w = w - {rng.choice(vocab) for _ in range(4)} | {rng.choice(vocab)}
        if w not in sets:
            sets.append(w)
    keys, got, _ = tiles_of([list(w) for w in sets], num, den, tile, turns)
    want = {(keys[j], keys[i]) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
    assert len(want) > 20 and want <= got


def test_sets_that_share_a_frequent_word_are_not_all_compared(monkeypatch):
    rng = random.Random(9)
    vocab = [rng.getrandbits(62) for _ in range(100)]
    sets = [rng.sample(vocab, 20) for _ in range(4000)]
    _, got, visited = tiles_of(sets)
    monkeypatch.setattr(trie, "SPLIT", 1 << 30)
    _, all_, whole = tiles_of(sets)
    near = lambda a, b: 10 * len({*a} & {*b}) >= 7 * len({*a} | {*b})
    real = lambda p: {(a, b) for a, b in p if near(sets[(a >> 4) // 7919], sets[(b >> 4) // 7919])}
    assert visited < whole / 2 and real(got) == real(all_)


def test_near_pairs_of_nothing(spark):
    assert neardup.near_pairs(spark.createDataFrame([], TRAIN)).count() == 0
    one = spark.createDataFrame([("a", "s", None, "word " * 100_000 + " b c d e f g h i", None, None, None)] * 2, TRAIN)
    assert neardup.near_pairs(one).count() == 0 and neardup.near_groups(one).count() == 0


def test_prefixes_never_miss():
    for s in range(8, 40):
        for t in range(math.ceil(0.7 * s), s + 1):
            need = -(-7 * (s + t) // 17)
            assert neardup.prefix_lengths(s, 7, 10)[1] >= min(s, s - need + 1) and neardup.prefix_lengths(t, 7, 10)[0] >= min(t, t - need + 1)


# ---- 4 --------------------------------------------------------------------------------------


def test_category_names(spark):
    d = spark.createDataFrame([(" Multi-Sentence ",), ("MULTI SENTENCE",), ("multi_sentence",), (" ",), (None,)], "c string")
    assert [r.k for r in d.select(names.category_key("c").alias("k")).collect()] == ["multi_sentence"] * 3 + [None, None]
    d = spark.createDataFrame([("Sotto",), (" sotto_v2",), ("sotto-mirror",), ("Disfl-qa",), ("disfl_qa_v2",), ("a_v",)], "c string")
    assert [r.k for r in d.select(names.corpus_key("c").alias("k")).collect()] == ["sotto"] * 3 + ["disfl_qa"] * 2 + ["a_v"]


def test_samples(spark):
    c = spark.createDataFrame([(f"c{i}", None, "r", "e", ["Big"] if i % 10 else ["big", "rare", " RARE "], None, None, "x") for i in range(100)] * 2 + [(None, None, None, None, ["big"], None, None, None)], CASE)
    t = spark.createDataFrame([(f"t{i}", "S_v2" if i % 2 else "s", None, None, None, None, None) for i in range(60)], TRAIN)
    targets = spark.createDataFrame(
        [("x", "cleanup_cases", "big", 0.5, 2, 0.4), ("x", "cleanup_cases", "rare", 0.3, 2, 0.4), ("x", "cleanup_cases", "none", 0.1, 1, 0.4), ("y", "train_sotto_lfm", "s", 1.0, 5, 0.5), ("y", "train_sotto_lfm", "z", None, 0, None)],
        "target_set string, table_name string, category string, target_share double, min_rows int, sample_fraction double",
    )
    assert rows(sampling.unmet_targets(c, t, targets)) == [("x", "none"), ("x", "rare")]
    got = sampling.draw(c, t, targets).toPandas()
    assert got.groupby(["target_set", "category"]).size().to_dict() == {("x", "big"): 20, ("x", "rare"): 10, ("y", "s"): 30}
    assert not got.duplicated().any()
    again = sampling.draw(c.repartition(7), t, targets).toPandas()
    assert set(map(tuple, got.values)) == set(map(tuple, again.values))
    rep = {(r.target_set, r.category): r.deficit for r in sampling.sample_report(c, t, targets).collect()}
    assert rep == {("x", "big"): 0, ("x", "rare"): 2, ("x", "none"): 4, ("y", "s"): 0, ("y", "z"): 0}
    assert sampling.unmet_targets(c.where("1=0"), t.where("1=0"), targets).count() == 4


# ---- 5 --------------------------------------------------------------------------------------


def train_refs(spark, refs):
    return spark.createDataFrame([(f"r{i:03d}", s, r, "a", "b", "clash", 1) for i, (s, r) in enumerate(refs)], TRAIN)


def test_origins(spark):
    d = spark.createDataFrame([("a:f.parquet:Ctb%2D00012/5",), ("a:f:SPK_7+speaker=8/s1/9",), ("a:f:Sheet2:10/paragraph-0003",), ("a:ctb1.json:q5",), ("a:f:",), ("a",), (None,)], "r string")
    assert [r.o for r in d.select(names.origins("r").alias("o")).collect()] == [["contributor:12"], ["speaker:7", "speaker:8"], ["paragraph:3"], [], [], [], []]


def test_related_records(spark):
    d = train_refs(spark, [("s", "s:f:spk1/1"), ("S-mirror", "s:f:speaker-001/2"), ("t", "t:f:spk1/3"), ("s", "s:f:spk2 and spk3/4"), ("s", "s:f:spk#3/5"), ("s", "s:f:spk3|spk4/6"), ("s", None), ("s", "s:f:"), ("s", "s:f:spk4/7")])
    t = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    assert rows(splits.related_records(d.union(d), t)) == [("r000", "r001"), ("r003", "r004"), ("r003", "r005"), ("r003", "r008")]
    assert splits.related_records(d.where("1=0"), t).count() == 0


def test_batches_keep_components_together(spark):
    rng = random.Random(6)
    d = train_refs(spark, [("s", f"s:f:spk{rng.randint(1, 60)}{'+spk' + str(rng.randint(1, 60)) if rng.random() < 0.1 else ''}/{i}") for i in range(300)] + [("s", None)] * 20)
    t = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    x = splits.split_in_batches(d, t, 3).toPandas()
    assert len(x) == 320 and x.id.is_unique and x.groupby("component").split.nunique().max() == 1
    whole = splits.assign_splits(d, t)[0].toPandas()
    same = x.merge(whole, on="id")
    assert same.groupby("component_x").component_y.nunique().max() == 1 and same.groupby("component_y").component_x.nunique().max() == 1


def test_samples_are_topped_up(spark, monkeypatch):
    """Where the hash accepts too few, the next ones are taken, as if more had been accepted."""
    c = spark.createDataFrame([(f"c{i}", None, "r", "e", ["big"], None, None, "x") for i in range(200)], CASE)
    targets = spark.createDataFrame([("x", "cleanup_cases", "big", 0.5, 2, 0.4)], "target_set string, table_name string, category string, target_share double, min_rows int, sample_fraction double")
    t = train_refs(spark, [])
    a = rows(sampling.draw(c, t, targets))
    monkeypatch.setattr(sampling, "OVERSAMPLE", 0.2)
    monkeypatch.setattr(sampling, "SIGMAS", 0.0)
    assert rows(sampling.draw(c, t, targets)) == a and len(a) == 40


TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)]


def test_splits_are_near_their_shares_and_stable(spark):
    rng = random.Random(4)
    d = train_refs(spark, [("s", f"s:f:spk{min(rng.randint(1, 400), rng.randint(1, 400))}/{i}") for i in range(900)] + [("s", None)] * 100)
    t = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    a, table = splits.assign_splits(d, t)
    x = a.toPandas()
    assert len(x) == 1000 and x.groupby("component").split.nunique().max() == 1
    share = x.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    more = d.union(train_refs(spark, [("s", "s:f:spk9000/1"), ("s", "s:f:spk9001/2")]).withColumn("id", F.concat(F.lit("new"), "id")))
    b, _ = splits.assign_splits(more, t, existing=table)
    y = b.toPandas().set_index("id")
    named = x[~x.component.str.startswith("id:")]
    assert (y.loc[named.id].split.values == named.split.values).all()
    rep = {r.split: r.records for r in splits.split_report(a, t).collect()}
    assert rep["none"] == 0 and sum(rep.values()) == 1000


def test_conflicting_merges_are_quarantined(spark, tmp_path):
    old = spark.createDataFrame([("s/speaker:1", "s/speaker:1", "train"), ("s/speaker:2", "s/speaker:2", "test"), ("s/speaker:3", "s/speaker:3", "test")], splits.COMPONENTS)
    splits.save_components(old, str(tmp_path / "c"))
    d = train_refs(spark, [("s", "s:f:spk1+spk2/1"), ("s", "s:f:spk3+spk4/2"), ("s", "s:f:spk2/3")])
    a, table = splits.assign_splits(d, spark.createDataFrame(TARGETS, "split_name string, target_share double"), splits.load_components(spark, str(tmp_path / "c")))
    assert rows(a.select("id", "split")) == [("r000", "quarantine"), ("r001", "test"), ("r002", "quarantine")]
    assert {r.entity: r.split for r in table.collect()} == {"s/speaker:1": "quarantine", "s/speaker:2": "quarantine", "s/speaker:3": "test", "s/speaker:4": "test"}
    with pytest.raises(ValueError):
        splits.assign_splits(d, spark.createDataFrame([], "split_name string, target_share double"))


# ---- 6 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["sorted", "random", "ties"])
def test_summary_error_is_within_its_bound(shape):
    rng = np.random.default_rng(3)
    v = {"sorted": np.arange(30_000.0), "random": rng.pareto(1.5, 30_000), "ties": rng.integers(0, 5, 30_000).astype(float)}[shape]
    whole = quantiles.Summary(64)
    for part in np.array_split(v, 17):
        s = quantiles.Summary(64)
        for p in np.array_split(part, 5):
            s.add(p)
        whole.merge(quantiles.Summary.of(type("R", (), s.state()), 64))
    o = np.sort(v)
    assert whole.n == len(v) and whole.bound() < 0.15 * len(v)
    for p, x in zip((0.0, 0.1, 0.5, 0.9, 0.99, 1.0), whole.percentiles((0.0, 0.1, 0.5, 0.9, 0.99, 1.0))):
        rank = max(1, math.ceil(p * len(v)))
        lo, hi = np.searchsorted(o, x, "left") + 1, np.searchsorted(o, x, "right")
        assert max(0, lo - rank, rank - hi) <= whole.bound()
    assert quantiles.Summary().percentiles((0.5,)) == [None]


def test_leaves():
    assert quantiles.numeric_leaves('{"a": 1, "b": {"c": [2, null, true, "x"], "d": NaN}}') == {"a": 1.0, "b.c.0": 2.0}
    assert quantiles.numeric_leaves("oops") == {} and quantiles.numeric_leaves(None) == {} and quantiles.numeric_leaves("3") == {}


def test_timing_percentiles(spark):
    data = [(i, "c", "s", "m", "v" if i % 3 else None, None, f'{{"t": {i}}}' if i % 10 else None, None, None, None, None, None, None, None) for i in range(1, 301)]
    d = spark.createDataFrame(data + data[:50], RESULT)
    assert all(x.within for x in quantiles.percentile_check(d, 16).collect())
    for k in (4096, 16):
        r = {x.prompt_variant: x for x in quantiles.timing_percentiles(d, k).collect()}
        for g in ("v", None):
            v = [i for i in range(1, 301) if i % 10 and (i % 3 > 0) == (g == "v")]
            assert r[g].n == len(v) and r[g].metric == "t"
            rank = sum(x <= r[g].p90 for x in v)
            assert abs(rank - math.ceil(0.9 * len(v))) <= r[g].rank_error * len(v) + 1e-6
            if k == 4096:
                assert r[g].rank_error == 0 and r[g].p50 == v[math.ceil(len(v) / 2) - 1]
    assert quantiles.timing_percentiles(d.where("1=0")).count() == 0


def test_many_summaries_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN_IN", 2)
    parts = []
    for i in range(23):
        s = quantiles.Summary(8)
        s.add(np.arange(i * 10, i * 10 + 10, dtype=float))
        st = s.state()
        parts.append((None, "m", st["n"], st["error"], st["lo"], st["hi"], [int(x) for x in st["levels"]], [float(x) for x in st["vals"]]))
    d = spark.createDataFrame(parts, f"grp string, metric string, {quantiles.STATE}")
    r = quantiles.percentiles(d, k=8).first()
    assert r.n == 230 and abs(r.p50 - 114) <= r.rank_error * 230


# ---- 7 --------------------------------------------------------------------------------------


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in texts], DOC)


ITEM = "Only Moreno remembers which hinge opened the vault with 4711 before the night of rain"


def test_leaks(spark, monkeypatch):
    items = cases(spark, [("h1", ITEM, None), ("h2", "short one", "short one"), (None, ITEM, ITEM)])
    d = docs(
        spark,
        [
            (1, "Intro. " + ITEM.upper() + " outro"), (2, " ".join(ITEM.split()[3:11]) + " x"), (3, " ".join(ITEM.split()[3:10]) + " x"),
            (4, "so Only Castor remembers which hinge opened the vault with 99 before the night"), (5, None), (6, ""), (7, "Ｏｎｌｙ Moreno\nremembers, which - hinge opened the vault!"),
            (1, "Intro. " + ITEM.upper() + " outro"), (None, ITEM), (8, "x " * 100_000 + ITEM),
        ],
    )
    for limit in (leakage.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", limit)
        assert rows(leakage.leaked(d, items)) == [(1, "h1"), (2, "h1"), (7, "h1"), (8, "h1")]
        kinds = {r.doc_id: r.kind for r in leakage.leaks(d, items).collect()}
        assert kinds[4] == "reparameterised" and 3 not in kinds
    assert leakage.leaked(d.where("1=0"), items).count() == 0 and leakage.leaked(d, items.where("1=0")).count() == 0
    rep = {r.item_id: r for r in leakage.leak_report(d, items).collect()}
    assert rep["h1"].exact_documents == 4 and rep["h1"].testable and not rep["h2"].testable and len(rep) == 2


def test_slots_hold_over_all_windows(spark):
    """One value of an item stands for one of the document, in all windows of the two."""
    item = "take 12 boxes from the left shelf and put 12 boxes on the right shelf before nine"
    items = cases(spark, [("h", item, None)])
    d = docs(spark, [(1, item.replace("12", "40")), (2, item.replace("12", "40", 1).replace("12", "41")), (3, item.replace("12", "40", 1)), (4, item)])
    assert {r.doc_id: r.kind for r in leakage.leaks(d, items).collect()} == {1: "reparameterised", 3: "exact", 4: "exact"}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = ["Ann", "ann", "Bo", "12", "x9", "euros", "der", "die", "tag"] + list("abcdefg")
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + rng.choice([".", "\n", ""])
    its = [(f"h{i}", text(14), text(10)) for i in range(12)]
    ds = []
    for i in range(120):
        t = text(10)
        if rng.random() < 0.5:
            w = rng.choice(its)[1].split()
            k = rng.randrange(len(w) - 7)
            t += " " + " ".join(w[k : k + rng.randint(7, 10)]) + " " + text(5)
        ds.append((i, t if rng.random() < 0.8 else t.title()))
    grams: dict = {}
    for i, a, b in its:
        for t in (a, b):
            w = words(t)
            for k in range(len(w) - 7):
                grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = {(i, h) for i, t in ds for k in range(len(words(t)) - 7) for h in grams.get(tuple(words(t)[k : k + 8]), ())}
    assert rows(leakage.leaked(docs(spark, ds), cases(spark, its))) == sorted(want, key=str) and want


# ---- 8 --------------------------------------------------------------------------------------


def test_mixtures(spark):
    rng = random.Random(2)
    text = lambda: " ".join(["word"] * rng.randint(20, 60))
    data = [(i, text(), "big", None, None) for i in range(200)] + [(1000 + i, text(), "small", None, None) for i in range(10)] + [(2000, None, "big", None, None), (2001, "x", None, None, None)]
    d = spark.createDataFrame(data, DOC)
    t = spark.createDataFrame([("m", "big", 0.7, 2, 1.0), ("m", "small", 0.2, 3, 1.0), ("m", "none", 0.1, 3, 1.0), ("n", "small", 1.0, 4, 3.5)], "mix_id string, source string, target_share double, max_repeats int, budget_ratio double")
    assert rows(mixing.short_sources(d, t)) == [("m", "none"), ("m", "small")]
    m = mixing.mix(d, t).toPandas()
    tok = dict(mixing.token_counts(d).select("doc_id", "tokens").collect())
    assert tok[2000] == 0 and not m.duplicated(["mix_id", "doc_id"]).any()
    size = {s: sum(tok[i] for i, _, x, *_ in data if x == s and i in tok) for s in ("big", "small")}
    used = lambda mix, s: sum(r.repeats * r.tokens for r in m.itertuples() if (r.mix_id, r.source) == (mix, s))
    total = size["big"] + size["small"]
    assert 0 <= 0.7 * total - used("m", "big") <= 61
    assert used("m", "small") == 3 * size["small"] and m[m.source == "small"].repeats.max() <= 4
    assert 0 <= 3.5 * size["small"] - used("n", "small") <= 61
    r = {(x.mix_id, x.source): x for x in mixing.mix_report(d, t).collect()}
    assert r["m", "none"].reached_tokens == 0 and r["m", "small"].falls_short and not r["n", "small"].falls_short
    assert mixing.mix(d.where("1=0"), t).count() == 0


# ---- 9 --------------------------------------------------------------------------------------


def own_kind(text):
    """The kind that a text's trusted passages alone would give it."""
    ps = residue_rules.passages(text)
    if any(p.canon.startswith(residue_rules.VARIABLE) and p.kind for p in ps):
        return "placeholder"
    kinds = {p.kind for p in ps if p.kind}
    return min(kinds) if kinds else None


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dear {{first_name}}, your parcel waits at the depot.", "placeholder"), ("Bonjour ${name}, le colis est là.", "placeholder"), ("The cleanup of %(reviewer)s finished.", "placeholder"),
        ("In the style guide, ${HOME} stands for the home folder.", None), ("The preview showed `{{speaker}}` in the documentation.", None),
        ('The config is {"lang": "en", "beam": {num}} on the handset.', None), ("The regex [a-z]{2,5} matched 3 rows.", None), ("We took list[0] and 5% off.", None),
        ("Lorem ipsum dolor sit amet consectetur.", "filler"), ("A heading\nblah blah blah blah", "filler"), ("test test test test", "filler"), ("TBD TBD TBD", "filler"),
        ("We discussed whether lorem ipsum is a fair sample for speech tests.", None),
        ("404 - page not found. The address does not exist.", "error_page"), ("Home | Help\nError 503: unavailable.", "error_page"), ("Die angeforderte Seite wurde nicht gefunden.", "error_page"),
        ("The tester saw a 404 on the portal yesterday and reported it to Ana.", None), ("A session expires after 5 minutes, which annoyed Ana.", None),
        ("Error 500 was the highlight of a novel called so by critics.", None), ("404 not found was all that Ana said.", None),
        ("Please enable JavaScript to view this page.", "script_notice"), ("Bitte aktivieren Sie JavaScript, um fortzufahren.", "script_notice"),
        ("This course requires JavaScript and a good deal of patience.", None),
        ("Support told Ana to enable JavaScript, and afterwards the page worked.", None), ("Word errors fell when Ana read the needle script slowly.", None),
        (None, None), ("", None), (" \n", None), ("A plain note about tea.", None),
    ],
)
def test_trusted_passages(text, want):
    assert own_kind(text) == want


def residue_of(spark, texts):
    return {r.doc_id: (r.kind, r.source_of_label) for r in residue.residue(docs(spark, texts)).collect()}


def test_labels_pass_through_components(spark):
    """Wordings the rules don't know get the label of the trusted one they are near to, or near
    to a near one; what only tells of such strings doesn't."""
    got = residue_of(
        spark,
        [
            (1, "Please enable JavaScript to view this page."), (2, "Please enable JavaScript to view this viewer."), (3, "Please enable scripting to view this viewer."), (4, "Ana told us to please enable JavaScript to view this page."),
            (5, "This course requires JavaScript and a good deal of patience."), (6, "Error 500 was the highlight of a novel called so by critics."), (7, None), (8, ""),
            (9, "You don't have permission to view this recording."), (10, "Dear {{first name}}, the tea is cold."), (11, "Dear [FIRST NAME], the tea is cold."), (12, "Dear [INAUDIBLE], the tea is cold."), (13, "HTTP 404 Not Found"),
        ],
    )
    assert got == {
        1: ("script_notice", "own"), 2: ("script_notice", "group"), 3: ("script_notice", "group"), 9: ("error_page", "group"),
        10: ("placeholder", "own"), 11: ("placeholder", "group"), 13: ("error_page", "own"),
    }


def test_companions_of_messages(spark):
    beside = "Nothing came back from the shelf."
    texts = [(i, f"HTTP 50{i} Server Error\n{beside}") for i in range(4)] + [(9, beside + " The ladder is blue. The lamp stands near the river."), (10, "Try the second door.\nHTTP 404 Not Found")]
    assert set(residue_of(spark, texts[:4])) == {0, 1, 2, 3}
    # Where it stands in other documents too, it is no companion and the rest decides.
    assert set(residue_of(spark, texts)) == set()


def test_length_makes_no_difference(spark):
    """A message is one whether it is said once or a thousand times; ordinary text around it
    decides by its share."""
    note = "The blue ladder stands near the old barn and nobody knows why. "
    got = residue_of(spark, [(1, "404 Not Found\n" * 2000), (2, "404 Not Found\n" + note * 3), (3, "Lorem ipsum dolor sit amet.\n" + note * 2000), (4, "x " * 100_000 + "{{name}}"), (5, "404 Not Found\n")])
    assert got == {1: ("error_page", "own"), 4: ("placeholder", "own"), 5: ("error_page", "own")}


def test_residue_of_odd_tables(spark):
    d = docs(spark, [(1, "TBD TBD TBD"), (1, "TBD TBD TBD"), (None, "TBD TBD TBD"), (2, None), (3, "fine words here")])
    assert rows(residue.residue_kinds(d)) == [(1, "filler")]
    assert {r.doc_id for r in residue.without_residue(d).collect()} == {None, 2, 3}
    assert residue.residue(d.where("1=0")).count() == 0


def test_levels_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, f"Please enable JavaScript to view this {rng.choice(['page', 'note', 'viewer', 'letter', 'record'])} {w}.") for i, w in enumerate(["now", "here", "again", "today", "first"] * 8)]
    a = residue_of(spark, texts)
    monkeypatch.setattr(residue, "BLOCK", 3)
    assert residue_of(spark, texts) == a and len(a) == len(texts)


def test_near_passages_meet(spark):
    """Pairs at the threshold and above meet in the tables; those found are checked exactly."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8)))
    a, b, met, all_ = [], [], 0, 0
    for _ in range(300):
        w = [word() for _ in range(8)]
        v = list(w)
        for i in rng.sample(range(8), rng.randint(1, 3)):
            v[i] = word()
        a.append(" ".join(w))
        b.append(" ".join(v))
    x, y = residue.fingerprints(a), residue.fingerprints(b)
    found = set(zip(*[z.tolist() for z in residue.Tables(y).meet(x)]))
    for i in range(300):
        p, q = (set(residue.grams([t])[1].tolist()) for t in (a[i], b[i]))
        if 2 * len(p & q) >= len(p | q):
            all_ += 1
            met += (i, i) in found
    assert all_ > 150 and met >= 0.93 * all_ and len(found) < 3000
    assert len(residue.fingerprints([])) == 0 and residue.fingerprints(["", "x"]).shape == (2, 2)


def test_furniture_and_signatures_of_what_tells(spark):
    """Only texts that may hold furniture are searched for it, and what tells gets no fingerprint."""
    for t in ("MENU  Search LOGIN x", "prıvacy polıcy", "Home | a | B text", "© 2020 Foo bar", "cookİe settİngs", "all rıghts reserved.", "Skip to content\nA note.", "Back to Top", "Terms of use", "nothing of it"):
        assert residue_rules.plain(t) == residue_rules._FURN.sub("\n", residue_rules._BULLET.sub("", t)).strip()
    d = spark.createDataFrame([(1, "The page was not found, she said. Bring the blue ladder to the barn.")], "doc_id long, text string")
    got = {r.tells: (r.p0, r.p1) for r in residue.read_passages(d).collect()}
    assert got[True] == (0, 0) != got[False] and len(got) == 2
