"""Stems of words by stripping suffixes, for four languages."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"

# Suffixes and what stands in their place, for words whose stem has a vowel and a consonant after it.
ENGLISH_LONG = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
ENGLISH_MORE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
ENGLISH_LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# Endings of the other languages, of which the longest goes that leaves three letters at least.
ENDINGS = {
    "fr": ["issements", "issement", "atrices", "ateurs", "ations", "atrice", "ateur", "ation", "ements", "ement", "ences", "ence", "ismes", "isme", "istes", "iste", "eaux", "euses", "euse", "ives", "ifs", "ive", "ables", "able", "ités", "ité", "ees", "ées", "ée", "és", "aient", "erait", "ait", "ons", "ez", "ent", "er", "ir", "es", "e", "s", "é"],
    "de": ["ungen", "heiten", "keiten", "ischen", "lichen", "ung", "heit", "keit", "isch", "lich", "igen", "erin", "ern", "em", "en", "er", "es", "ig", "e", "s", "n"],
    "es": ["amientos", "imientos", "amiento", "imiento", "aciones", "adoras", "adores", "ación", "adora", "mente", "idades", "idad", "istas", "ista", "ismos", "ismo", "ables", "able", "ibles", "ible", "ando", "iendo", "aron", "ieron", "aban", "aba", "ados", "idos", "adas", "idas", "ado", "ido", "ada", "ida", "ar", "er", "ir", "as", "os", "es", "a", "o", "e", "s"],
}


def _measure(stem: str) -> int:
    """How often a run of consonants follows a run of vowels."""
    kinds = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall(r"v+c+", kinds))


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") for i, c in enumerate(stem))


def _short(stem: str) -> bool:
    """Ends in a consonant, a vowel and a consonant that is none of w, x, y."""
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", stem))


def english(word: str) -> str:
    """The steps that Porter published in 1980."""
    if len(word) <= 2 or not word.isascii():
        return word
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + put
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (ENGLISH_LONG, ENGLISH_MORE):
        end = max((e for e in table if word.endswith(e)), key=len, default=None)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = max((e for e in ENGLISH_LAST if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str, language: str = "en") -> str:
    """The stem of a lower-cased word; of an unknown language the word itself."""
    if language == "en":
        return english(word)
    for end in sorted(ENDINGS.get(language, []), key=len, reverse=True):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word
