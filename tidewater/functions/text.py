"""Text functions as column expressions; they stay in the JVM.

Case is folded by ``lower``; where full case folding or a Unicode form is needed use the UDFs in
:mod:`tidewater.functions.udfs`. A null text gives null, or an empty array of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import lexicon as L

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: C) -> Column:
    """Null or nothing but white space of any kind."""
    return ~F.coalesce(col(c).rlike(r"[^\s\p{Z}]"), F.lit(False))


def lexical_tokens(c: C) -> Column:
    """Lower-cased words, as written."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(L.WORD_JVM), F.lit(0)), F.lower)


def normalized_text(c: C) -> Column:
    """The words joined by single spaces."""
    return F.array_join(lexical_tokens(c), " ")


def overlap_text(c: C) -> Column:
    """As :func:`normalized_text`, folded before it is cut into words."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(L.WORD_JVM), F.lit(0)), " ")


def ascii_words(c: C) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def tidy(c: C) -> Column:
    """Line ends as LF, without outer white space. Apply the NFC UDF first where the text may
    be in another form."""
    return F.regexp_replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


def word_ngrams(tokens: C, n: int) -> Column:
    """Distinct word n-grams of an array of words; a shorter text is one gram, none is none."""
    t = col(tokens)
    size = F.size(t)
    many = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(size >= n, F.array_distinct(many)).when(size > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: C, n: int) -> Column:
    """Distinct character n-grams of a text, with the same rule for short ones."""
    t = col(text)
    size = F.char_length(t)
    # A look-ahead at every place: one pass over the text, which has no index of its characters.
    many = F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(size >= n, F.array_distinct(many)).when(size > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def jaccard(a: C, b: C) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    a, b = col(a), col(b)
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def edit_similarity(a: C, b: C, threshold: float) -> Column:
    """1 - Levenshtein distance / longer length where that reaches the threshold, else 0. Texts
    whose lengths alone rule it out aren't compared."""
    a, b = col(a), col(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    most = F.floor((1 - threshold) * longest + 1e-9).cast("int")
    gap = F.abs(F.char_length(a) - F.char_length(b))
    d = F.call_function("levenshtein", a, b, most)  # -1 beyond the limit; only a band is computed
    return F.when(longest == 0, F.lit(1.0)).when(gap > most, F.lit(0.0)).otherwise(F.when(d >= 0, 1 - d / longest).otherwise(F.lit(0.0)))


def masked_entities(c: C, pattern: str = L.ENTITY_MIXTURE) -> Column:
    return F.regexp_replace(col(c), "(?U)" + pattern, " ENTITY ")


def template_shape(tokens: C) -> Column:
    """Words with digit-only ones as ``#``, joined."""
    return F.array_join(F.transform(col(tokens), lambda w: F.when(w.rlike(r"^\d+$"), F.lit("#")).otherwise(w)), " ")


def label_key(*fields: C) -> Column:
    """The first text of the fields: trimmed, lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(F.coalesce(*[col(f) for f in fields], F.lit("")))), "- ", "__")


def stable_hash(c: C, n: int = 16) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, n)


def hash64(c: C) -> Column:
    """The first 64 bits of SHA-256 as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(col(c), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def shard_of(c: C, shards: int) -> Column:
    return F.pmod(hash64(c), F.lit(shards).cast("decimal(20,0)")).cast("int")


def seed32(c: C) -> Column:
    """The first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(col(c), 256), 1, 8), 16, 10).cast("bigint")


def hash_below(c: C, fraction: float) -> Column:
    """Whether the 64-bit hash falls into the given fraction of its range."""
    return hash64(c) < F.lit(str(int(fraction * 2**64))).cast("decimal(20,0)")


def utf16_length(c: C) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16LE")) / 2).cast("int")


def expands(candidate: C, raw: C) -> Column:
    """Longer than 1.8 times the raw text, in code points."""
    return F.char_length(col(candidate)) * 10 > F.char_length(col(raw)) * 18


def before_separator(c: C, mark: str = "###") -> Column:
    return F.substring_index(col(c), mark, 1)


def as_sentence(c: C) -> Column:
    """Capital first letter and a final period where no mark ends it."""
    t = F.trim(col(c))
    s = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
    return F.when(s.rlike(r"[.!?]$") | (s == ""), s).otherwise(F.concat(s, F.lit(".")))


# Marks that take no blank behind them, and marks that take none before them.
OPENING, CLOSING = "([{<“‘\"", ".,!?;:%)]}>”’'\""


def spaced_insert(before: C, text: C, after: C) -> Column:
    """``text`` with a blank where it would touch its surroundings: on each side where both
    neighbours are there and neither is white space, the left one opens nothing and the right
    one closes nothing."""
    b, t, a = (F.coalesce(col(c), F.lit("")) for c in (before, text, after))

    def gap(left: Column, right: Column) -> Column:
        x, y = F.right(left, F.lit(1)), F.substring(right, 1, 1)
        fine = (x != "") & (y != "") & ~x.rlike(r"\s") & ~y.rlike(r"\s") & ~F.contains(F.lit(OPENING), x) & ~F.contains(F.lit(CLOSING), y)
        return F.when(fine, F.lit(" ")).otherwise(F.lit(""))

    return F.when(t == "", t).otherwise(F.concat(gap(b, t), t, gap(t, a)))


def has_adjacent_repeat(tokens: C) -> Column:
    t = col(tokens)
    return F.when(F.size(t) < 2, F.lit(False)).otherwise(
        F.exists(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.element_at(t, i) == F.element_at(t, i + 1))
    )


def missing_anchors(anchors: C, text: C) -> Column:
    """The anchors a text doesn't contain, as written."""
    return F.filter(F.coalesce(col(anchors), F.array().cast("array<string>")), lambda a: ~F.contains(col(text), a))


def matches(name: str, c: C) -> Column:
    """One of the classifier's predicates."""
    return F.coalesce(col(c).rlike(L.PATTERNS[name]), F.lit(False))


def token_cap(words: C) -> Column:
    """Output budget by words: at least 900."""
    return F.greatest(F.lit(900), F.ceil(col(words) * 3 / 2)).cast("int")


def short_cap(tokens: C) -> Column:
    return F.least(F.greatest(col(tokens), F.lit(16)), F.lit(96)).cast("int")


def device_cap(tokens: C) -> Column:
    """ceil(1.3 n) + 32 in whole numbers."""
    return (F.expr("0") + F.floor((col(tokens) * 13 + 9) / 10) + 32).cast("int")


def elapsed_ms(start_ns: C, end_ns: C) -> Column:
    return F.floor(F.greatest(col(end_ns) - col(start_ns), F.lit(0)) / 1_000_000).cast("bigint")


def is_date(c: C) -> Column:
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def is_safe_path(c: C) -> Column:
    """Relative, without a parent step or a drive."""
    p = col(c)
    return F.coalesce((p != "") & ~p.startswith("/") & ~F.contains(p, F.lit("\\")) & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike(r"^[A-Za-z]:"), F.lit(False))


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def rms(samples: C) -> Column:
    s = col(samples)
    return F.sqrt(F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double") * x), F.size(s)))


def peak(samples: C) -> Column:
    return F.array_max(F.transform(col(samples), lambda x: F.abs(x.cast("double"))))


def clipping(samples: C, at: float = 32767) -> Column:
    s = col(samples)
    return F.try_divide(F.size(F.filter(s, lambda x: F.abs(x.cast("double")) >= at)), F.size(s))


def masked_labels(prompt: C, answer: C) -> Column:
    """Labels for training on the answer only: -100 for every token of the prompt."""
    return F.concat(F.array_repeat(F.lit(-100), F.size(col(prompt))), col(answer))


def git_blob_sha1(content: C) -> Column:
    c = col(content)
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(c).cast("string"), F.lit("\x00")), "UTF-8")
    return F.sha1(F.concat(head, c))


def rotated(variant: C, case: C, n: int) -> Column:
    """Position of a variant when the order turns by one with each case."""
    return F.pmod(col(variant) - col(case), F.lit(n))
