"""A tokenizer for full-text search: words folded in case and diacritics, and Porter's stems (1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# fixed values: the published suffix rules
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"
# the longest suffix that fits decides, whether or not its condition holds
_RULES = [[tuple(r.split(":")) for r in sorted(step.split(), key=lambda r: -len(r.partition(":")[0]))] for step in (_STEP2, _STEP3, _STEP4)]
_WORD = re.compile(r"[^\W_]+")


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Whether it ends consonant, vowel, consonant, and the last is not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _without_ed_or_ing(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if cut is None or "v" not in _shape(cut):
        return word
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if _double_end(cut) and cut[-1] not in "lsz":
        return cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut


def stem(word: str) -> str:
    """The stem of a lower-case word of Latin letters; other words are their own."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _without_ed_or_ing(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step, rules in enumerate(_RULES):
        for suffix, new in rules:
            if word.endswith(suffix):
                rest = word[: len(word) - len(suffix)]
                if _measure(rest) > (step == 2) and (suffix != "ion" or rest[-1:] in ("s", "t")):
                    word = rest + new
                break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("l") and _double_end(word) and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=100_000)
def folded(word: str) -> str:
    """The stem of the word in lower case without diacritics."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return stem(word.lower())


def stems(text: str) -> list[str]:
    """The folded stems of the text's words: letters and digits, of any script; all else parts words."""
    return [folded(w) for w in _WORD.findall(text)]


_PLAIN = re.compile(r"\w+")


def plain(text: str) -> list[str]:
    """Words of letters, digits and underscores in lower case, as they are."""
    return _PLAIN.findall(text.lower())
