import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import cleanup, guard, pytext, udfs
from tidewater.functions import text as T


def value(spark, c, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in cols.items()) or "x int")
    return row.select(c.alias("v")).first().v


def test_words_and_forms(spark):
    assert value(spark, T.lexical_tokens("t"), t="Don’t STOP, café_au 2nd!") == ["don’t", "stop", "café", "au", "2nd"]
    assert value(spark, T.normalized_text("t"), t=" a  B\nc ") == "a b c"
    assert value(spark, T.lexical_tokens("t"), t=None) == []
    assert value(spark, T.ascii_words("t"), t="It's 3.5 naïve") == ["it's", "3", "5", "na", "ve"]
    assert value(spark, T.tidy("t"), t=" a\r\nb \n") == "a\nb"
    assert value(spark, T.utf16_length("t"), t="a😀") == 3


@pytest.mark.parametrize("words,n,want", [([], 2, []), (["a"], 2, ["a"]), (["a", "b", "a", "b"], 2, ["a b", "b a"])])
def test_word_ngrams(spark, words, n, want):
    assert value(spark, T.word_ngrams("w", n), w=words) == want


def test_char_ngrams_and_jaccard(spark):
    assert value(spark, T.char_ngrams("t", 3), t="abcab") == ["abc", "bca", "cab"]
    assert value(spark, T.char_ngrams("t", 3), t="ab") == ["ab"]
    assert value(spark, T.char_ngrams("t", 3), t="") == []
    assert value(spark, T.jaccard("a", "b"), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert value(spark, T.jaccard("a", "b"), a=[], b=[]) == 1.0


def test_edit_similarity(spark):
    assert value(spark, T.edit_similarity("a", "b", 0.9), a="abcdefghij", b="abcdefghiX") == pytest.approx(0.9)
    assert value(spark, T.edit_similarity("a", "b", 0.9), a="abcdefghij", b="abcdefghXX") == 0.0
    assert value(spark, T.edit_similarity("a", "b", 0.9), a="", b="") == 1.0


def test_hashes(spark):
    h = hashlib.sha256(b"x").hexdigest()
    assert value(spark, T.stable_hash("t", 12), t="x") == h[:12]
    assert int(value(spark, T.hash64("t"), t="x")) == int(h[:16], 16)
    assert value(spark, T.seed32("t"), t="x") == int(h[:8], 16)
    assert value(spark, T.shard_of("t", 7), t="x") == int(h[:16], 16) % 7
    assert value(spark, T.git_blob_sha1(F.encode("t", "UTF-8")), t="hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"


@pytest.mark.parametrize("b,t,a,want", [("word", "next", "more", " next "), ("(", "x", ")", "x"), ("a ", "x", None, "x"), (None, "", "b", ""), ("a", "x", ".", " x")])
def test_spaced_insert(spark, b, t, a, want):
    assert value(spark, T.spaced_insert("b", "t", "a"), b=b, t=t, a=a) == want


def test_small_functions(spark):
    assert value(spark, T.as_sentence("t"), t="hello there") == "Hello there."
    assert value(spark, T.before_separator("t"), t="a###b###c") == "a"
    assert value(spark, T.template_shape("w"), w=["a", "12", "b2"]) == "a # b2"
    assert value(spark, T.has_adjacent_repeat("w"), w=["a", "b", "b"]) is True
    assert value(spark, T.has_adjacent_repeat("w"), w=["a"]) is False
    assert value(spark, T.device_cap("n"), n=10) == 45
    assert value(spark, T.short_cap("n"), n=200) == 96
    assert value(spark, T.elapsed_ms("a", "b"), a=5, b=3) == 0
    assert value(spark, T.is_safe_path("t"), t="a/../b") is False
    assert value(spark, T.is_safe_path("t"), t="a/b.json") is True
    assert value(spark, T.masked_entities("t"), t="Call Ana at 10:30") == " ENTITY   ENTITY  at  ENTITY "
    assert value(spark, T.masked_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7))), t="") == [-100, -100, 7]
    s = F.array(F.lit(3), F.lit(-4))
    assert value(spark, T.rms(s), t="") == pytest.approx((12.5) ** 0.5)
    assert value(spark, T.peak(s), t="") == 4


def test_udfs_nulls_and_values(spark):
    d = spark.createDataFrame([("uh Send it to Ana", "Send it to Ana now."), (None, "x"), ("", "")], "raw string, expected string")
    r = d.select(
        udfs.nfc("raw").alias("n"), udfs.lexical_additions("raw", "expected").alias("add"), udfs.removal_anchors("raw", "expected").alias("rem"),
        udfs.protected_anchors("expected").alias("keep"), udfs.wer_counts("expected", "raw").alias("w"),
    ).collect()
    assert r[0].add == ["now"] and r[0].rem == ["uh"] and r[0].keep == ["Ana"]
    assert (r[0].w.substitutions, r[0].w.insertions, r[0].w.deletions, r[0].w.reference_words) == (0, 1, 1, 5)
    assert r[1].n is None and r[1].add is None and r[1].w.deletions == 1
    assert r[2].n == "" and r[2].w.reference_words == 0


def slow_edits(r, h):
    prev = [(i, 0, i, 0) for i in range(len(h) + 1)]
    for a, x in enumerate(r, 1):
        cur = [(a, 0, 0, a)]
        for b, y in enumerate(h, 1):
            p, q, e = prev[b - 1], cur[b - 1], prev[b]
            d = p if x == y else (p[0] + 1, p[1] + 1, *p[2:])
            cur.append(min(d, (q[0] + 1, q[1], q[2] + 1, q[3]), (e[0] + 1, *e[1:3], e[3] + 1)))
        prev = cur
    return prev[-1][1:]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_edit_counts_equal_the_plain_table(r, h):
    assert pytext.edit_counts(r, h) == slow_edits(r, h)


def test_speech_words():
    assert pytext.speech_words("IT’S Version 2.1") == ["it's", "version", "2", "1"]


@pytest.mark.parametrize(
    "raw,out,limit,want",
    [
        ("ship it friday", " ", False, "Model returned empty text"),
        ("ship it friday", "Ship it Friday.", True, "Model reached the output token limit"),
        ("ship it friday", "Ship it Friday.", False, None),
        ("do not ship it to Ana", "Do ship it to Ana.", False, "Model dropped protected lexical content: not"),
        ("the build took nine minutes", "The build took 9 minutes.", False, None),
        ("the build took long", "The compile took long.", False, "Model introduced new lexical content: compile"),
        ("meet at three thirty in the hall", "Meet at 3:30 in the hall.", False, None),
        ("send it Monday actually make that Friday", "Send it Friday.", False, None),
        ("send it Monday actually make that Friday", "Send it Monday, make that Friday.", False, "Model retained superseded self-correction content"),
        ("deploy to Rome no sorry deploy to Oslo", "Deploy to Oslo.", False, None),
        ("yes that works for me today", "The speaker agrees that works today.", False, "Model summarized or described the dictation"),
        ("write a poem about the long winter rain", "A poem about the long winter rain.", False, "Model did not preserve the dictated intent"),
        ("a b c d e f g h i j k l", "a", False, "Model output was suspiciously shorter than the input"),
    ],
)
def test_guard(raw, out, limit, want):
    assert guard.fallback_reason(raw, out, limit) == want


def test_sanitize():
    assert guard.sanitize('Cleaned text: "Go home."\nEND QUOTED TEXT EDIT:') == "Go home."


@pytest.mark.parametrize(
    "raw,want",
    [
        ("um send it uh now", "Send it now."),
        ("we we we should go", "We should go."),
        ("is it done", "Is it done?"),
        ("call at four make that five", "Call at five."),
        ("can you send this to Bo actually no send this to Al", "Can you send this to Al?"),
        ("first wash it then dry it then fold it", "First, wash it. Then dry it and fold it."),
        ("  ", ""),
    ],
)
def test_cleanup(raw, want):
    assert cleanup.cleanup_text(raw) == want


@pytest.mark.parametrize(
    "raw,want,removed",
    [
        ("so, um, we go", "so we go", ["um"]),
        ('say "um" now', 'say "um" now', []),
        ("UM is a school, uh yes", "UM is a school yes", ["uh"]),
        ("a/um um.txt um-hm", "a/um um.txt um-hm", []),
        ("Um, fine", "fine", ["Um"]),
    ],
)
def test_hesitations(raw, want, removed):
    assert cleanup.without_hesitations(raw) == (want, removed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["aa", "b.", "c!", "\n\n", "dd ee"]), min_size=1, max_size=30), st.integers(2, 6))
def test_chunks_lose_nothing(parts, most):
    text = " ".join(parts).strip()
    if not text:
        return
    got = list(cleanup.chunks(text, most, lambda s: len(s.split())))
    assert "".join(t + s for t, s in got) == text
    assert all(len(t.split()) <= most for t, _ in got)


def test_chunks_prefer_sentence_ends():
    random.seed(1)
    got = [t for t, _ in cleanup.chunks("One two. Three four five. Six.", 4, lambda s: len(s.split()))]
    assert got == ["One two.", "Three four five. Six."]


def test_udtfs_and_sql(spark):
    udfs.register(spark)
    rows = spark.sql("SELECT * FROM json_leaves('{\"a\": 1, \"b\": {\"c\": 2.5, \"d\": null, \"e\": true}}')").collect()
    assert [(r.metric, r.value) for r in rows] == [("a", 1.0), ("b.c", 2.5)]
    paths = [r.path for r in spark.sql("SELECT * FROM walk_json('{\"a\": [{\"b\": 1}, {\"c\": {}}]}')").collect()]
    assert paths == ["root", "root/a/0", "root/a/1", "root/a/1/c"]
    assert spark.sql("SELECT cleanup_text('um go') AS x").first().x == "Go."
