"""The Porter stemmer with the usual extensions: irregular forms, four-letter -ies/-ied, -y after a consonant only.

A word's letters are consonants or vowels; y is a vowel after a consonant. The measure of a stem is its number of
vowel-to-consonant changes. Each step looks for the first of its endings that the word has, and applies that rule or none.
"""

from __future__ import annotations

from functools import lru_cache

#: Irregular forms.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

#: Endings of each step and what replaces them, in the order they are tried.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _marks(word: str) -> str:
    """c or v for each letter."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _marks(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is one vowel and one consonant."""
    marks = _marks(stem)
    return (marks[-3:] == "cvc" and stem[-1] not in "wxy") or marks == "vc"


def _swap(word: str, rules, fits) -> str:
    for ending, new in rules:
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            return stem + new if fits(stem, ending) else word
    return word


def _step_1b(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    for ending in ("ed", "ing"):
        stem = word[: len(word) - len(ending)]
        if word.endswith(ending) and "v" in _marks(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _marks(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _step_2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]):
        word = word[:-2]
    return _swap(word, STEP_2, lambda stem, ending: _measure(stem + "l" if ending == "logi" else stem) > 0)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; the last ones asked for are kept."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _swap(word, STEP_1A, lambda *_: True)
    word = _step_1b(word)
    if word.endswith("y") and len(word) > 2 and _marks(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _step_2(word)
    word = _swap(word, STEP_3, lambda stem, _: _measure(stem) > 0)
    word = _swap(word, [(e, "") for e in STEP_4], lambda stem, ending: _measure(stem) > 1 and (ending != "ion" or stem[-1:] in ("s", "t")))
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
