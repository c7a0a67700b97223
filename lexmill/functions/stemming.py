"""The Porter stemmer for English words, after the published algorithm; everything but a-z is left as it is."""

from __future__ import annotations

import re
from functools import lru_cache

# The suffix rules of the algorithm's steps 2 to 4.
_STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    """Longest suffix first: the first that fits is the rule that counts."""
    return sorted((tuple((r + ":").split(":")[:2]) for r in text.split()), key=lambda r: -len(r[0]))


_RULES_2, _RULES_3, _RULES_4 = map(_rules, (_STEP_2, _STEP_3, _STEP_4))
_PLAIN = re.compile("[a-z]+")


def _shape(stem: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(stem):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last one not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return word
            return stem + new if measure(stem) > least else word
    return word


def _plural_and_past(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _shape(stem)[-2:] == "cc" and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3 or not _PLAIN.fullmatch(word):
        return word
    word = _plural_and_past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(_replace(word, _RULES_2, 0), _RULES_3, 0), _RULES_4, 1)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
