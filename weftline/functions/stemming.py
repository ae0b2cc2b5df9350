"""Porter's stemmer for English words, with the extensions that scoring tools use, over distinct words of a batch."""

from __future__ import annotations

#: Words that are looked up instead of being stemmed.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Endings of the second and third step with what replaces them, in the order in which they are tried.
SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
#: Endings that the fourth step drops from long stems.
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        vowel = c in "aeiou" or (c == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How many times a vowel is followed by a consonant."""
    return _kinds(stem).count("vc")


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel and a consonant other than w, x, y, or is a vowel and a consonant."""
    kinds = _kinds(word)
    return kinds == "vc" or (kinds[-3:] == "cvc" and word[-1] not in "wxy")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    stem = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
    if stem is None or "v" not in _kinds(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    """The first ending that fits decides, whether its stem is long enough or not."""
    for end, other in rules:
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + other if _measure(stem) else word
    return word


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]):
        return _second(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) else word
    return _replaced(word, SECOND)


def _fourth(word: str) -> str:
    for end in FOURTH:
        if word.endswith(end):
            stem = word[: -len(end)]
            if end == "ion" and stem[-1:] not in ("s", "t"):
                continue
            return stem if _measure(stem) > 1 else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _kinds(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _fourth(_replaced(_second(word), THIRD))
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
