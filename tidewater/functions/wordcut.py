"""Words of a text, in Python, for Arrow-batched code: NFKC, lower case, runs of letters and
digits. A null text has no words."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    if not text:
        return ""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []
