"""How an answer stands to its case: which part of the wanted text it gives, where it ends."""

from __future__ import annotations

import re

import numpy as np

from tidewater.functions.wordcut import words

# ---- Fixed values ---------------------------------------------------------------------
# Labels before an answer.
LABELS = r"(?:(?:here(?:'s| is)|below is) (?:the|your) )?(?:cleaned(?: up)?|corrected|final|edited)?\s*(?:text|transcript(?:ion)?|result|output|answer|version|cleaned|cleanup|corrected|response)\s*:"
# Marks that a field or a relay puts where it cut a text.
CUT_MARKS = r"\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|[\[(<]\s*(?:truncated|cut|cut off|continued|abridged|shortened)\s*[\])>]"
# What is left of a character, an entity or an escape that was cut in the middle.
TORN = r"�+|&(?:#x?[0-9a-fA-F]*|[a-zA-Z]{1,8})?|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]?|n)?|%[0-9a-fA-F]?|<[a-zA-Z/]{0,6}"
TERMINAL = ".!?。！？…"
CLOSERS = "\"'”’»)]}*_`“"
# ---------------------------------------------------------------------------------------

_LABEL = re.compile(rf"^[\s\W]*{LABELS}\s*", re.I)
_MARK = re.compile(rf"\s*(?:{CUT_MARKS})\s*$", re.I)
_TORN = re.compile(rf"(?:{TORN})$")
#: Of the words of an answer, at most this share may differ from the text it follows.
FOLLOWS = 0.45


def unlabelled(text: str) -> str:
    return _LABEL.sub("", text, count=1)


def torn(text: str) -> tuple[str, bool]:
    """The text without a cut mark or a torn piece at its end, and whether there was one."""
    t = _MARK.sub("", text)
    u = _TORN.sub("", t)
    return u, len(u) < len(text.rstrip()) or u != text and len(u) < len(text)


def ends_well(text: str) -> bool:
    """Whether a text ends with terminal punctuation."""
    t = text.rstrip().rstrip(CLOSERS).rstrip()
    return bool(t) and t[-1] in TERMINAL


def follow(answer: list[str], wanted: list[str]) -> tuple[float, int, bool]:
    """Align all of ``answer`` with the best beginning of ``wanted``: (share of words that
    differ, words of ``wanted`` passed, whether the last word is only the beginning of the one
    it stands for)."""
    n, m = len(answer), len(wanted)
    if not n:
        return 1.0, 0, False
    # Plain beginnings need no alignment.
    if n <= m and answer[:-1] == wanted[: n - 1] and wanted[n - 1].startswith(answer[-1]):
        same = wanted[n - 1] == answer[-1]
        return (0.0, n, False) if same else (0.3 / n, n, True)
    code: dict[str, int] = {}
    w = np.array([code.setdefault(x, len(code)) for x in wanted], np.int64)
    a = [code.get(x, -1) for x in answer]
    last = answer[-1]
    begins = np.array([x.startswith(last) and x != last for x in wanted], bool)
    idx = np.arange(m + 1, dtype=np.float64)
    row = idx.copy()
    for i, x in enumerate(a):
        cost = (w != x).astype(np.float64)
        if i == n - 1:
            cost[begins] = 0.3
        new = np.empty(m + 1)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + cost, row[1:] + 1)
        prev, row = row, np.minimum.accumulate(new - idx) + idx
    best = row.min()
    j = int(np.flatnonzero(row <= best + 1e-9)[-1])
    partial = j > 0 and bool(begins[j - 1]) and abs(row[j] - prev[j - 1] - 0.3) < 1e-9
    return float(best) / n, j, partial


def cut_short(text: str, wanted: list[str], raw: list[str]) -> str | None:
    """How an answer breaks off before the text it was giving was complete, or None: ``word``
    in the middle of a word, ``words`` before further words. The text it gives is what is
    wanted or, where it follows that more closely, the raw text."""
    body, was_torn = torn(unlabelled(text))
    a = words(body)
    if not a:
        return None
    found = []
    for w in (wanted, raw):
        if w:
            if found and found[0][0] == 0 and len(w) > (1 + FOLLOWS) * len(a):
                continue  # nothing follows better, and too much of the raw text is missing
            d, j, partial = follow(a, w)
            found.append((d, j, partial, len(w)))
            if j == len(w) and not partial and d <= FOLLOWS:
                return None
    if not found:
        return None
    d, j, partial, m = min(found, key=lambda x: x[0])
    if d > FOLLOWS:
        return None
    if partial:
        return "word"
    return "words" if j < m else None
