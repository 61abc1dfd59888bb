"""Rows of text pairs: classification, routing, buckets, validation, reviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import lexicon as L
from tidewater.functions import text as T
from tidewater.functions import udfs


def _none() -> Column:
    return F.array().cast("array<string>")


def tags(rules: Sequence[tuple[Column, str | Sequence[str]]]) -> Column:
    """The labels of all rules that hold, each once, in the order of the rules. A rule that is
    null doesn't hold."""
    parts = [F.when(F.coalesce(c, F.lit(False)), F.array(*[F.lit(x) for x in ([names] if isinstance(names, str) else names)])).otherwise(_none()) for c, names in rules]
    return F.array_distinct(F.flatten(F.array(*parts))) if parts else _none()


def first_match(rules: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The value of the first rule that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    head, *rest = rules
    c = reduce(lambda acc, r: acc.when(r[0], lit(r[1])), rest, F.when(head[0], lit(head[1])))
    return c if otherwise is None else c.otherwise(lit(otherwise))


def pair_of(candidates: Sequence[tuple[str, str]], columns: Sequence[str]) -> tuple[Column, Column]:
    """Of several possible pairs of columns the first with two non-blank texts."""
    there = [(a, b) for a, b in candidates if a in columns and b in columns]
    full = [~T.is_blank(a) & ~T.is_blank(b) for a, b in there]
    if not there:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return first_match([(f, F.col(a)) for f, (a, _) in zip(full, there)]), first_match([(f, F.col(b)) for f, (_, b) in zip(full, there)])


def operation(raw: Column | str, expected: Column | str) -> Column:
    """A label inferred from the texts alone where the source gives none; ordered rules."""
    r, e = T.col(raw), T.col(expected)
    rules = [
        (T.matches("list_marker", e) & T.matches("spoken_list", r), "list_formatting"),
        (F.contains(e, F.lit("\n\n")) & F.contains(F.lower(r), F.lit("new paragraph")), "paragraph_formatting"),
    ]
    for said, mark in L.SPOKEN_PUNCTUATION.items():
        rules.append((F.contains(F.lower(r), F.lit(said)) & ~F.contains(F.lower(e), F.lit(said)) & F.contains(e, F.lit(mark)), "dictation_commands"))
    rules += [(T.matches("grammar_cue", r), "grammar"), (T.matches("asr_cue", r), "misheard_words")]
    return first_match(rules, "")


def with_text_features(df: DataFrame, raw: str = "raw", expected: str = "expected") -> DataFrame:
    """The words of both texts and the literals to protect: one Arrow pass for all of them."""
    d = df.withColumn("__f", udfs.pair_features(raw, expected))
    return d.withColumns({c: F.col(f"__f.{c}") for c in udfs.FEATURES.names}).drop("__f")


def classified(df: DataFrame, raw: str = "raw", expected: str = "expected", source: str = "source_id", label: str = "label") -> DataFrame:
    """Adds ``categories`` and ``risk_tags`` to rows with :func:`with_text_features`."""
    r, e, rw, ew, src, up = (F.col(c) for c in (raw, expected, "raw_words", "expected_words", source, label))
    lit = lambda words: F.array(*[F.lit(w) for w in words])
    m = T.matches
    both = F.concat(r, F.lit("\n"), e)
    names = list(L.UPSTREAM)
    formatting = up.isin(*L.FORMATTING)
    self_corrected = (src == "disfl_qa") | m("correction", r)
    asks = r.endswith("?") | e.endswith("?")
    commands = m("command", r) & ~formatting
    said_aside = F.exists(F.regexp_extract_all(r, F.lit(L.PATTERNS["discourse"]), F.lit(0)), lambda x: ~F.contains(F.lower(e), F.lower(x)))
    dated = m("date_numeric", both) | m("date_word", both) | m("date_may", both)
    stakes = m("high_stakes", r) | m("high_stakes", e)
    digit = F.exists("expected_anchors", lambda a: a.rlike(r"\p{N}"))
    foreign = F.exists("expected_anchors", lambda a: a.rlike(r"[^\x00-\x7F]"))
    negated, unsure = F.arrays_overlap(rw, lit(L.NEGATION)), F.arrays_overlap(rw, lit(L.UNCERTAINTY))
    filler = F.arrays_overlap(F.array_except(rw, ew), lit(L.FILLERS))
    named = F.size("expected_names") > 0
    cats: list[tuple[Column, str | Sequence[str]]] = [
        (r == e, ("no_op", "already_clean")),
        ((rw == ew) & (r != e), ("already_clean", "punctuation", "capitalization")),
        *[(up == k, L.UPSTREAM[k]) for k in names],
        *[(up == k, ("formatting_directive", v)) for k, v in L.FORMATTING.items()],
        (up == "adversarial", "must_not_answer"),
        (src == "disfl_qa", ("self_correction", "question")),
        (self_corrected, "self_correction"),
        (filler, "fillers"),
        (said_aside, "discourse_marker"),
        (T.has_adjacent_repeat(rw) & (rw != ew), "repetition"),
        (asks, ("question", "must_not_answer")),
        (commands, ("command", "must_not_answer")),
        (m("adversarial", r), ("adversarial_instruction", "must_not_answer")),
        (m("technical", r), "technical_text"),
        (stakes, "high_stakes"),
        (negated, "negation"),
        (unsure, "uncertainty"),
        (digit, "numbers"),
        (m("version", both), "versions"),
        (m("path", both), "paths"),
        (m("identifier", both), "identifiers"),
        (m("money", both), "money"),
        (dated, "dates"),
        (named, "names"),
        (foreign, "unicode"),
        (F.size(rw) >= 25, "long_form"),
    ]
    risks: list[tuple[Column, str | Sequence[str]]] = [
        (formatting, "formatting_scope"),
        (up == "adversarial", ("adversarial_content", "dictated_instruction")),
        (self_corrected, "superseded_fact"),
        (asks | commands, "dictated_instruction"),
        (m("adversarial", r), ("adversarial_content", "dictated_instruction")),
        (m("technical", r), "technical_literal"),
        (stakes, "high_stakes"),
        (up.isin("grammar", "misheard_words"), "inferred_content"),
        (negated, "negation"),
        (unsure, "uncertainty"),
        (digit, "number"),
        (m("version", both), ("number", "technical_literal")),
        (m("path", both) | m("identifier", both), "technical_literal"),
        (m("money", both) | dated, "number"),
        (named, "name"),
        (foreign, "unicode_literal"),
    ]
    c = tags(cats)
    df = df.withColumn("__c", c).withColumn("risk_tags", tags(risks))
    base = F.when(F.size("__c") > 0, F.col("__c")).otherwise(F.when(rw != ew, F.array(F.lit("mixed"))).otherwise(F.array(F.lit("already_clean"))))
    kinds = lit(("self_correction", "fillers", "discourse_marker", "repetition", "false_start", "grammar_rewrite", "asr_correction"))
    mixed = F.size(F.array_intersect(base, kinds)) > 1
    return df.withColumn("categories", F.when(mixed, F.array_union(base, F.array(F.lit("mixed")))).otherwise(base)).drop("__c")


def declared_additions(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``allowed``: the added words that are accepted. In lists only numbers that were
    spoken as words are; one other word and none is."""
    spoken = F.create_map(*[x for k, v in L.LIST_NUMBERS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    fine = F.forall("added", lambda a: F.coalesce(F.arrays_overlap(F.try_element_at(spoken, F.lower(a)), F.col("raw_words")), F.lit(False)))
    allowed = F.when(F.col(label) != "list_formatting", F.col("added")).when(fine, F.col("added")).otherwise(_none())
    return df.withColumn("allowed", allowed)


def routed(df: DataFrame, raw: str = "raw", expected: str = "expected", source: str = "source_id", label: str = "label") -> DataFrame:
    """Adds ``outcome`` (candidate, quarantine, rejected) and ``reason`` by ordered rules."""
    r, e, src, up = (F.col(c) for c in (raw, expected, source, label))
    changed = F.exists("raw_anchors", lambda a: ~F.contains(F.lower(e), F.lower(a)))
    risky = F.arrays_overlap("risk_tags", F.array(*[F.lit(x) for x in ("negation", "uncertainty", "adversarial_content", "formatting_scope", "inferred_content", "lexical_addition", "high_stakes")]))
    rules = [
        ((src == "nyra") & T.matches("annotation", r), ("rejected", "out_of_domain_transcription_annotation")),
        (F.size("added") > F.size("allowed"), ("rejected", "target_introduces_lexical_content")),
        (F.size("added") > 0, ("quarantine", "lexical_addition_requires_review")),
        ((src == "sotto") & up.isin(*L.REVIEWED_UPSTREAM), ("quarantine", F.concat(F.lit("review_required_category:"), up))),
        (T.matches("high_stakes", r) | T.matches("high_stakes", e), ("quarantine", "high_stakes_domain")),
        (changed, ("quarantine", "protected_anchor_changed")),
        (risky, ("quarantine", "high_risk_requires_explicit_review")),
    ]
    return df.withColumn("outcome", first_match([(c, v[0]) for c, v in rules], "candidate")).withColumn("reason", first_match([(c, v[1]) for c, v in rules], "pending_human_review"))


def bucket(categories: str = "categories", risks: str = "risk_tags", ref: str = "source_ref") -> Column:
    """The primary bucket of a row: the first that fits."""
    has = lambda *x: F.arrays_overlap(F.col(categories), F.array(*[F.lit(v) for v in x]))
    risk = F.arrays_overlap(F.col(risks), F.array(*[F.lit(v) for v in ("number", "name", "technical_literal", "unicode_literal", "negation", "uncertainty")]))
    return first_match(
        [
            (F.coalesce(F.col(ref).startswith("disfl_qa:"), F.lit(False)), "disfl_qa_correction"),
            (has("list_formatting"), "explicit_list_formatting"),
            (has("paragraph_formatting"), "explicit_paragraph_formatting"),
            (has("spoken_punctuation", "formatting_directive"), "explicit_spoken_punctuation"),
            (has("grammar_rewrite"), "grammar_rewrite"),
            (has("asr_correction"), "asr_correction"),
            (has("mixed", "discourse_marker"), "mixed_or_discourse"),
            (has("self_correction", "false_start", "abandoned_start"), "correction_or_false_start"),
            (has("fillers", "repetition"), "filler_or_repetition"),
            (has("adversarial_instruction"), "adversarial_must_not_answer"),
            (has("no_op", "already_clean"), "clean_no_op"),
            (risk, "protected_literal"),
        ]
    )


def crosscutting(categories: str = "categories", risks: str = "risk_tags") -> Column:
    """The flags that cut across buckets."""
    has = lambda c, *x: F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in x]))
    return tags(
        [
            (has(categories, "must_not_answer", "command", "question"), "must_not_answer_or_command_question"),
            (has(categories, "adversarial_instruction"), "adversarial_instruction"),
            (has(risks, "number", "name", "technical_literal", "unicode_literal"), "protected_literal"),
            (has(risks, "negation", "uncertainty"), "negation_or_uncertainty"),
            (has(categories, "unicode", "multilingual"), "unicode_or_multilingual"),
            (has(categories, "technical_text"), "technical_text"),
            (has(categories, "long_form"), "long_form"),
            (has(categories, "high_stakes") | has(risks, "high_stakes"), "high_stakes"),
        ]
    )


def record_ids(df: DataFrame, ref: str = "source_ref", source: str = "source_id", expected: str = "expected", label: str = "label", speaker: str | None = None) -> DataFrame:
    """Adds the derived identities of a record: id, family and template, all from hashes."""
    nul = F.lit("\x00")
    key = T.stable_hash(F.concat(F.col(source), nul, F.col(speaker)), 20) if speaker else F.lit(None).cast("string")
    basis = F.coalesce(F.concat(F.lit("speaker:"), key), F.lower(T.tidy(expected)))
    return df.withColumns(
        {
            "record_id": F.concat(F.lit("candidate-"), F.col(source), F.lit("-"), T.stable_hash(ref, 20)),
            "family_id": F.concat(F.col(source), F.lit("-family-"), T.stable_hash(F.concat(F.col(source), nul, basis))),
            "template_id": F.concat(F.col(source), F.lit("-template-"), T.stable_hash(F.concat(F.col(source), nul, F.col(label), nul, T.template_shape(T.lexical_tokens(expected))))),
        }
    )


# ---- validation ---------------------------------------------------------------------------


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)``, a row for every rule a record breaks; a rule that is null is kept."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def blank(c: str) -> Column:
    return T.is_blank(c)


def case_rules() -> dict[str, Column]:
    """What a case of text cleanup must keep."""
    none = _none()
    keep, gone = F.coalesce("must_preserve", none), F.coalesce("must_remove", none)
    # An anchor may stand in a text in another case or spacing; these rules compare as written.
    return {
        "blank_id": blank("id"),
        "blank_raw": blank("raw"),
        "blank_expected": blank("expected"),
        "no_category": F.coalesce(F.size("categories"), F.lit(0)) <= 0,
        "repeated_category": F.size(F.array_distinct("categories")) < F.size("categories"),
        "preserve_absent": F.exists(keep, lambda a: ~F.contains(F.col("expected"), a)),
        "remove_absent": F.exists(gone, lambda a: ~F.contains(F.col("raw"), a)),
        "remove_survives": F.exists(gone, lambda a: F.contains(F.col("expected"), a)),
        "spoken_missing": F.col("spoken").isNull(),
    }


def review_rules(require_approved: bool = False) -> dict[str, Column]:
    """What the review of a record must keep; ``review`` is a struct."""
    s, n = F.col("review.status"), F.col("review.reviewers")
    blind = (F.col("split") == "blind") & (s == "approved")
    rules = {
        "review_status": ~F.coalesce(s.isin("draft", "pending", "approved", "rejected"), F.lit(False)),
        "review_reviewers": n.isNull() | (n < 0),
        "review_unreviewed": s.isin("approved", "rejected") & (n == 0),
        "review_draft": (s == "draft") & (n != 0),
        "review_blind_reviewers": blind & (n < 2),
        "review_blind_adjudicated": blind & ~F.coalesce(F.col("review.adjudicated"), F.lit(False)),
        "review_date": F.col("review.reviewed_at").isNotNull() & ~T.is_date("review.reviewed_at"),
        "review_refs": F.col("review.reviewer_refs").isNotNull() & (F.size(F.array_distinct("review.reviewer_refs")) != n),
    }
    return rules | ({"review_not_approved": s != "approved"} if require_approved else {})


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_pairs(df: DataFrame, raw: str = "raw", expected: str = "expected") -> DataFrame:
    """``(pair, n)``: pairs that are one after folding, as a hash of their words."""
    pair = F.sha2(F.concat(T.overlap_text(raw), F.lit("\x00"), T.overlap_text(expected)), 256)
    return df.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def crossing(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def reviewed(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with the outcome of their reviews: one voice approves or rejects, a conflict or
    none leaves them pending."""
    d = decisions.groupBy("id").agg(
        F.array_sort(F.collect_set("decision")).alias("__d"), F.array_sort(F.collect_set("reviewer_ref")).alias("reviewer_refs"), F.max("reviewed_at").alias("reviewed_at")
    )
    s = F.when(F.size("__d") == 1, F.when(F.col("__d")[0] == "approve", "approved").otherwise("rejected")).otherwise("pending")
    return records.join(d, "id", "left").withColumn("status", F.coalesce(s, F.lit("pending"))).drop("__d")


def shortfall(available: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``(key, required, available, missing)`` where something is missing."""
    a = targets.join(available, key, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return a.withColumn("missing", F.col("required") - F.col("available")).where("missing > 0").select(key, "required", "available", "missing")
