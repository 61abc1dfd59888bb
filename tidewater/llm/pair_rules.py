"""Ordered rules for broken prompt and response pairs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from tidewater.functions.wordcut import words
from tidewater.llm.answers import FOLLOWS, LABELS, cut_short, follow, unlabelled

# ---- Fixed values ---------------------------------------------------------------------
# Stand-ins for "no output", compared without marks and in lower case.
STAND_INS = frozenset(
    "null|none|nil|nan|n a|na|empty|blank|no output|no text|no content|no response|no answer|no result|output|undefined|"
    "empty output|empty string|empty response|silence|nothing|leer|keine ausgabe|kein text|vide|aucun|aucune sortie|aucun texte|"
    "vacío|vacio|sin salida|sin texto|ninguno|ninguna salida|eos|end|s|pad|unk|endoftext|im end".split("|")
)
# How the task is declined, in four languages.
REFUSALS = (
    r"i(?:'m| am) (?:very |so |really )?sorry,? but i|i(?:'m| am) (?:not able|unable) to|i (?:can(?:'t|not| not)|won't|will not|must decline|have to decline|do not feel comfortable|don't feel comfortable|refuse to)|"
    r"sorry,? (?:but )?(?:i|it|this|that)\b|unfortunately,? i (?:can(?:'t|not| not)|am (?:not able|unable))|(?:this|that|your) request can(?:'t|not| not) be|as an? (?:language|ai|artificial|virtual|large)[\w ]{0,24}(?:model|assistant|ai)|"
    r"it (?:isn't|is not|'s not) possible for me|"
    r"es tut mir leid|tut mir leid|leider (?:kann|darf) ich|ich (?:kann|darf|werde|möchte) (?:dabei|das|diese[nrsm]?|ihnen|dir|hier)?\s*(?:leider )?(?:nicht|keine)|dabei (?:kann|darf) ich|(?:diese|ihre) anfrage kann nicht|als (?:ki|sprach)[\w\-]*|"
    r"lo siento|lamentablemente,? no|no me es posible|no puedo (?:ayudar|procesar|continuar|realizar|cumplir|editar|limpiar|reescribir|responder)|no estoy autorizad[oa]|debo rechazar|me temo que no|como (?:asistente|modelo)[\w ]*|no tengo permitido|"
    r"désolée?|je suis désolée?|je ne (?:peux|suis) pas|je ne puis|il m'est impossible|malheureusement,? je|en tant qu(?:e |')(?:assistant|modèle|ia)|cette demande ne peut|je dois (?:refuser|décliner)|je refuse"
)
# Frequent words of the languages, by which a text's language is told.
PROFILES = {
    "en": "the a an and or of to in is are was were that this with for on at from it i you he she we they my our your her his be been has have had not don't isn't can could should would will if who what whether before after by near under still please tell let says there only does did".split(),
    "de": "der die das ein eine einen einem den dem des und oder ist sind war nicht ich du er sie wir ihr mit für auf aus bei nach von vom zum zur im am als dass wenn wann ob noch immer schon bitte kann kannst sollten möchte lieber selbst über unter neben hat habe gesagt kommt steht liegt wäre könnte es kostet ohne bevor muss wer wird".split(),
    "es": "el la los las un una unos unas y o de del al en es son está están que qué no con por para sobre se su sus mi lo le les me te yo él ella si cuando cuándo antes después sería mejor más muy ya este esta esto eso hay debe junto todavía sigue llega dije hasta sin según unas nadie puedes deberíamos".split(),
    "fr": "le la les un une des du de et ou est sont que qui quoi ne pas avec pour par sur sous dans au aux se sa son ses mon ma je tu il elle nous vous ils ce cette ces si quand avant après serait mieux plus très déjà toujours près chez merci j'ai dit doit à en l' d' n' qu' jusqu' sans peux peut être devrions cela coûte arrive demande".split(),
}
# Letters that are typical of a language among these.
LETTERS = {"de": "äöüß", "es": "ñáíóú¿¡", "fr": "êèàùâîôëçœ"}
# ---------------------------------------------------------------------------------------

_REFUSAL = re.compile(rf"(?:^|[.!?\n:]\s*)\W*(?:{REFUSALS})(?!\w)", re.I)
_LABEL_ONLY = re.compile(rf"^[\s\W]*(?:{LABELS})?[\s\W]*$", re.I)
_SPLIT = re.compile(r"(?<=[a-zà-ÿ])['’]")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"")
_OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“", "<": ">"}
_WEIGHT: dict[str, dict[str, float]] = {}
for _lang, _ws in PROFILES.items():
    for _w in _ws:
        _WEIGHT.setdefault(_w.rstrip("'"), {})[_lang] = 1.0
for _w, _by in _WEIGHT.items():
    for _lang in _by:
        _by[_lang] = 1.0 / len(_by)

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language", "copied_prefix", "unclosed")
#: Of these a result that has no other defect is not unusable.
SLIGHT = ("copied_prefix", "unclosed")
#: An answer in another language shares at most this share of its words with what is wanted.
SHARED = 0.4


def stand_in(text: str | None) -> bool:
    """Null, nothing but blanks or marks, a lone label, or a stand-in for no output."""
    if text is None or _LABEL_ONLY.match(text):
        return True
    w = words(unlabelled(text))
    return not w or " ".join(w) in STAND_INS


@lru_cache(20000)
def language(text: str) -> tuple[str | None, float]:
    """The language with most of a text's frequent words, and its lead over the next."""
    score = dict.fromkeys(PROFILES, 0.0)
    low = text.lower()
    for k, letters in LETTERS.items():
        score[k] += 0.25 * sum(c in low for c in letters)
    for w in _SPLIT.sub(" ", low).replace("'", " ").replace("-", " ").split():
        for k, x in _WEIGHT.get(w.strip(".,;:!?\"“”«»()[]"), {}).items():
            score[k] += x
    order = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    return (order[0][0], order[0][1] - order[1][1]) if order[0][1] > 0 else (None, 0.0)


@lru_cache(20000)
def script(text: str) -> str | None:
    """The script most letters of a text belong to."""
    if text.isascii():
        return "LATIN" if any(c.isalpha() for c in text) else None
    seen: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ", 1)[0]
            seen[name] = seen.get(name, 0) + 1
    return max(seen, key=lambda k: (seen[k], k)) if seen else None


def unquoted(text: str) -> str:
    """A text without what it quotes, unless it is nothing but a quotation."""
    t = _QUOTED.sub(" ", text)
    return t if words(t) else text


def unclosed(text: str) -> bool:
    """Whether a bracket or quotation mark that opens isn't closed."""
    need: list[str] = []
    for c in text:
        if need and c == need[-1]:
            need.pop()
        elif c in _OPENERS and c != "<":
            need.append(_OPENERS[c])
    return bool(need)


def within(inner: list[str], outer: list[str]) -> bool:
    """Whether all of ``inner`` occurs in ``outer`` in order."""
    it = iter(outer)
    return all(w in it for w in inner)


def refuses(text: str, wanted: list[str], raw: list[str]) -> bool:
    """Whether the task is declined: a phrase of refusal that isn't what was dictated."""
    m = _REFUSAL.search(unlabelled(text))
    if not m:
        return False
    a = words(unlabelled(text))
    known = set(wanted) | set(raw)
    if sum(w in known for w in a) > 0.5 * len(a) and min(follow(a, x)[0] for x in (wanted, raw) if x) <= 0.6:
        return False
    return True


def copied_prefix(answer: list[str], wanted: list[str], raw: list[str]) -> bool:
    """Whether an answer opens with half of the raw text or more, word for word, though the
    wanted text opens otherwise."""
    k = 0
    while k < min(len(answer), len(raw)) and answer[k] == raw[k]:
        k += 1
    return k >= 5 and 2 * k >= len(raw) and k < len(raw) and raw[:k] != wanted[:k]


def defects(text: str | None, wanted: str | None, raw: str | None, check_end: bool = True) -> list[str]:
    """Every defect triggered, in the order of the rules, each rule on its own. ``check_end``:
    whether the end is looked at; the caller leaves it out where the end is known to be well. An
    unknown case (nothing wanted, no raw text) can only be empty, refusing or unclosed."""
    if stand_in(text):
        return ["empty"]
    assert text is not None
    e, r = words(wanted), words(raw)
    out = []
    if check_end and (e or r) and cut_short(text, e, r):
        out.append("truncated")
    body = unlabelled(text)
    a = words(body)
    if a != e:
        if refuses(text, e, r):
            out.append("refusal")
        if r and e != r and within(r, a) and len(a) >= len(r):
            out.append("copied")
        if e and sum(w in set(e) for w in a) <= SHARED * len(a):
            if script(body) != script(wanted or ""):
                out.append("other_language")
            else:
                lang, lead = language(body)
                # A quotation may be in another language than the text that holds it.
                other, _ = language(unquoted(wanted or ""))
                if lang and lang != other and lead > 0 and follow(a, e)[0] > FOLLOWS:
                    out.append("other_language")
        if "copied" not in out and r and copied_prefix(a, e, r):
            out.append("copied_prefix")
    if unclosed(text) and not unclosed(wanted or ""):
        out.append("unclosed")
    return out
