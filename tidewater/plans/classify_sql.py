"""The classification of pairs as SQL, put together from the same fixed values."""

from __future__ import annotations

from tidewater.functions import lexicon as L
from tidewater.plans import fragments as S


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _m(name: str, *columns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_q(L.PATTERNS[name])})" for c in columns) + ")"


def _written(c: str) -> str:
    return f"regexp_extract_all({c}, '{S.WORD}')"


def _words(c: str) -> str:
    return f"list_transform({_written(f'nfc_normalize({c})')}, lambda x: lower(x))"


def _names(c: str) -> str:
    """Capitalised words inside sentences, by the places where they begin."""
    start = rf"regexp_matches(substr({c}, i, 64), '^[A-Z][a-z]{{2,}}(?:[^\p{{L}}\p{{N}}_]|$)') AND (i = 1 OR NOT regexp_matches(substr({c}, i - 1, 1), '[\p{{L}}\p{{N}}_]'))"
    head = rf"regexp_matches(rtrim(regexp_replace(substr({c}, 1, i - 1), '\s+$', '')), '[^.!?]$')"
    at = f"list_filter(range(1, length({c}) + 1), lambda i: {start} AND {head})"
    found = f"list_transform({at}, lambda i: regexp_extract(substr({c}, i, 64), '^[A-Z][a-z]+'))"
    return f"list_filter({found}, lambda x: NOT list_contains({_in(L.CALENDAR)}, lower(x)))"


def _anchors(c: str, names: str) -> str:
    parts = [f"regexp_extract_all({c}, {_q(p)})" for p in L.PROTECTED]
    kept = _in([*L.NEGATION, *L.UNCERTAINTY])
    parts += [rf"list_filter({_written(c)}, lambda x: list_contains({kept}, lower(x)) OR regexp_matches(x, '[^\x00-\x7F]'))", names]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def _operation() -> str:
    rules = [(f"{_m('list_marker', 'e')} AND {_m('spoken_list', 'r')}", "list_formatting"), ("contains(e, chr(10) || chr(10)) AND contains(lower(r), 'new paragraph')", "paragraph_formatting")]
    for said, mark in L.SPOKEN_PUNCTUATION.items():
        rules.append((f"contains(lower(r), {_q(said)}) AND NOT contains(lower(e), {_q(said)}) AND contains(e, {'chr(10)' if mark == chr(10) else _q(mark)})", "dictation_commands"))
    rules += [(_m("grammar_cue", "r"), "grammar"), (_m("asr_cue", "r"), "misheard_words")]
    return "CASE " + " ".join(f"WHEN {c} THEN {_q(v)}" for c, v in rules) + " ELSE '' END"


def _tags(rules: list[tuple[str, tuple[str, ...]]]) -> str:
    out = "CAST([] AS VARCHAR[])"
    for c, names in rules:
        out = f"list_concat({out}, CASE WHEN {c} THEN {_in(names)} ELSE [] END)"
    return f"list_distinct({out})"


def _rules() -> tuple[str, str]:
    formatting = f"list_contains({_in(L.FORMATTING)}, up)"
    corrected = f"(src = 'disfl_qa' OR {_m('correction', 'r')})"
    asks = "(r LIKE '%?' OR e LIKE '%?')"
    commands = f"({_m('command', 'r')} AND NOT {formatting})"
    dated = f"({_m('date_numeric', 'pair')} OR {_m('date_word', 'pair')} OR {_m('date_may', 'pair')})"
    stakes = _m("high_stakes", "r", "e")
    negated, unsure = (f"list_has_any(rw, {_in(w)})" for w in (L.NEGATION, L.UNCERTAINTY))
    digit, foreign = r"len(list_filter(ea, lambda a: regexp_matches(a, '\p{N}'))) > 0", r"len(list_filter(ea, lambda a: regexp_matches(a, '[^\x00-\x7F]'))) > 0"
    cats = [
        ("r = e", ("no_op", "already_clean")), ("rw = ew AND r <> e", ("already_clean", "punctuation", "capitalization")),
        *[(f"up = {_q(k)}", (v,)) for k, v in L.UPSTREAM.items()], *[(f"up = {_q(k)}", ("formatting_directive", v)) for k, v in L.FORMATTING.items()],
        ("up = 'adversarial'", ("must_not_answer",)), ("src = 'disfl_qa'", ("self_correction", "question")), (corrected, ("self_correction",)),
        (f"len(list_filter(rw, lambda w: NOT list_contains(ew, w) AND list_contains({_in(L.FILLERS)}, w))) > 0", ("fillers",)),
        (f"len(list_filter(regexp_extract_all(r, {_q(L.PATTERNS['discourse'])}), lambda x: NOT contains(lower(e), lower(x)))) > 0", ("discourse_marker",)),
        ("len(list_filter(range(1, len(rw)), lambda i: rw[i] = rw[i + 1])) > 0 AND rw <> ew", ("repetition",)),
        (asks, ("question", "must_not_answer")), (commands, ("command", "must_not_answer")), (_m("adversarial", "r"), ("adversarial_instruction", "must_not_answer")),
        (_m("technical", "r"), ("technical_text",)), (stakes, ("high_stakes",)), (negated, ("negation",)), (unsure, ("uncertainty",)), (digit, ("numbers",)),
        (_m("version", "pair"), ("versions",)), (_m("path", "pair"), ("paths",)), (_m("identifier", "pair"), ("identifiers",)), (_m("money", "pair"), ("money",)), (dated, ("dates",)),
        ("len(en) > 0", ("names",)), (foreign, ("unicode",)), ("len(rw) >= 25", ("long_form",)),
    ]
    risks = [
        (formatting, ("formatting_scope",)), ("up = 'adversarial'", ("adversarial_content", "dictated_instruction")), (corrected, ("superseded_fact",)), (f"({asks} OR {commands})", ("dictated_instruction",)),
        (_m("adversarial", "r"), ("adversarial_content", "dictated_instruction")), (_m("technical", "r"), ("technical_literal",)), (stakes, ("high_stakes",)), ("up IN ('grammar', 'misheard_words')", ("inferred_content",)),
        (negated, ("negation",)), (unsure, ("uncertainty",)), (digit, ("number",)), (_m("version", "pair"), ("number", "technical_literal")), (f"({_m('path', 'pair')} OR {_m('identifier', 'pair')})", ("technical_literal",)),
        (f"({_m('money', 'pair')} OR {dated})", ("number",)), ("len(en) > 0", ("name",)), (foreign, ("unicode_literal",)),
    ]
    return _tags(cats), _tags(risks)


def _has(column: str, *values: str) -> str:
    return f"list_has_any({column}, {_in(values)})"


_CATS, _RISKS = _rules()
_KINDS = _in(("self_correction", "fillers", "discourse_marker", "repetition", "false_start", "grammar_rewrite", "asr_correction"))
_NUMBER = "CASE lower(a) " + " ".join(f"WHEN {_q(k)} THEN list_has_any(rw, {_in(v)})" for k, v in L.LIST_NUMBERS.items()) + " ELSE false END"

#: ``classified``: id, src, r, e, up, categories, risks, ra (literals of the input), added, allowed.
CLASSIFIED = f"""
c0 AS (SELECT id, source_ref, raw AS r, expected AS e, {{corpus}} AS src FROM train_sotto_lfm WHERE NOT {S.blank('raw')} AND NOT {S.blank('expected')}),
c1 AS (SELECT *, CASE WHEN src = 'sotto' THEN {_operation()} ELSE '' END AS up, r || chr(10) || e AS pair, {_words('r')} AS rw, {_words('e')} AS ew, {_names('r')} AS rn, {_names('e')} AS en FROM c0),
c2 AS (SELECT *, {_anchors('r', 'rn')} AS ra, {_anchors('e', 'en')} AS ea,
  list_filter(list_distinct(list_transform({_written('e')}, lambda x: lower(x))), lambda w: len(list_filter({_written('e')}, lambda x: lower(x) = w)) > len(list_filter(rw, lambda x: x = w))) AS added FROM c1),
c3 AS (SELECT *, {_CATS} AS c, {_RISKS} AS risks, CASE WHEN up <> 'list_formatting' OR len(list_filter(added, lambda a: NOT ({_NUMBER}))) = 0 THEN added ELSE [] END AS allowed FROM c2),
c4 AS (SELECT *, CASE WHEN len(c) > 0 THEN c WHEN rw <> ew THEN ['mixed'] ELSE ['already_clean'] END AS base FROM c3),
classified AS (SELECT *, CASE WHEN len(list_intersect(base, {_KINDS})) > 1 THEN list_distinct(list_concat(base, ['mixed'])) ELSE base END AS categories FROM c4)"""

_REVIEWED = _in(L.REVIEWED_UPSTREAM)
_RISKY = _in(("negation", "uncertainty", "adversarial_content", "formatting_scope", "inferred_content", "lexical_addition", "high_stakes"))
#: (condition, outcome, reason as an expression) of the routing rules, the first that holds.
ROUTES = (
    (f"src = 'nyra' AND {_m('annotation', 'r')}", "rejected", "'out_of_domain_transcription_annotation'"),
    ("len(added) > len(allowed)", "rejected", "'target_introduces_lexical_content'"),
    ("len(added) > 0", "quarantine", "'lexical_addition_requires_review'"),
    (f"src = 'sotto' AND list_contains({_REVIEWED}, up)", "quarantine", "'review_required_category:' || up"),
    (_m("high_stakes", "r", "e"), "quarantine", "'high_stakes_domain'"),
    ("len(list_filter(ra, lambda a: NOT contains(lower(e), lower(a)))) > 0", "quarantine", "'protected_anchor_changed'"),
    (f"list_has_any(risks, {_RISKY})", "quarantine", "'high_risk_requires_explicit_review'"),
)
OUTCOME = "CASE " + " ".join(f"WHEN {c} THEN {_q(o)}" for c, o, _ in ROUTES) + " ELSE 'candidate' END"
REASON = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in ROUTES) + " ELSE 'pending_human_review' END"

_C, _K = "categories", "risks"
BUCKET = "CASE " + " ".join(
    f"WHEN {c} THEN {_q(v)}"
    for c, v in (
        ("coalesce(source_ref LIKE 'disfl_qa:%', false)", "disfl_qa_correction"), (_has(_C, "list_formatting"), "explicit_list_formatting"), (_has(_C, "paragraph_formatting"), "explicit_paragraph_formatting"),
        (_has(_C, "spoken_punctuation", "formatting_directive"), "explicit_spoken_punctuation"), (_has(_C, "grammar_rewrite"), "grammar_rewrite"), (_has(_C, "asr_correction"), "asr_correction"),
        (_has(_C, "mixed", "discourse_marker"), "mixed_or_discourse"), (_has(_C, "self_correction", "false_start", "abandoned_start"), "correction_or_false_start"), (_has(_C, "fillers", "repetition"), "filler_or_repetition"),
        (_has(_C, "adversarial_instruction"), "adversarial_must_not_answer"), (_has(_C, "no_op", "already_clean"), "clean_no_op"),
        (_has(_K, "number", "name", "technical_literal", "unicode_literal", "negation", "uncertainty"), "protected_literal"),
    )
) + " END"
PROTECTED_FLAG = _has(_K, "number", "name", "technical_literal", "unicode_literal")
ASKING_FLAG = _has(_C, "must_not_answer", "command", "question")
