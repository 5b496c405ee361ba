"""English stop words and the Snowball English (Porter2) stemmer.

Written from the published description of the algorithm
(M. F. Porter, "The English (Porter2) stemming algorithm").
"""

from __future__ import annotations

import re
from functools import lru_cache

# The Snowball English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()

# Irregular forms of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = frozenset(
    "inning outing canning herring earring proceed exceed succeed".split()
)
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ness": "", "ful": "",
}
STEP_4 = (
    "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
)
LI_ENDINGS = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        found = _REGION.search(word, start)
        return found.end() if found else len(word)

    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            return len(prefix), after(len(prefix))
    first = after(0)
    return first, after(first)


def _short_syllable(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    if len(word) < 3:
        return False
    a, b, c = word[-3:]
    return a not in _VOWEL and b in _VOWEL and c not in _VOWEL and c not in "wxY"


def _step_1(word: str, r1: int) -> str:
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")):
        if any(c in _VOWEL for c in word[:-2]):
            word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word
    for ending in ("eedly", "eed"):
        if word.endswith(ending):
            return word[: -len(ending)] + "ee" if len(word) - len(ending) >= r1 else word
    for ending in ("ingly", "edly", "ing", "ed"):
        if word.endswith(ending):
            stem_part = word[: -len(ending)]
            if not any(c in _VOWEL for c in stem_part):
                return word
            if stem_part.endswith(("at", "bl", "iz")):
                return stem_part + "e"
            if stem_part.endswith(DOUBLES):
                return stem_part[:-1]
            if r1 >= len(stem_part) and _short_syllable(stem_part):
                return stem_part + "e"
            return stem_part
    return word


def _replace(word: str, r1: int, rules: dict[str, str]) -> tuple[str, bool]:
    for ending in sorted(rules, key=len, reverse=True):
        if word.endswith(ending):
            if len(word) - len(ending) >= r1:
                return word[: -len(ending)] + rules[ending], True
            return word, True
    return word, False


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if word[0] == "y":
        word = "Y" + word[1:]
    word = re.sub(r"(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = _step_1(word, r1)
    if word in KEPT_AFTER_PLURAL:
        return word
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    word, hit = _replace(word, r1, STEP_2)
    if not hit and word.endswith("ogi"):
        if len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
    elif not hit and word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in LI_ENDINGS:
        word = word[:-2]
    word, hit = _replace(word, r1, STEP_3)
    if not hit and word.endswith("ative") and len(word) - 5 >= r2:
        word = word[:-5]
    for ending in STEP_4:
        if word.endswith(ending):
            if len(word) - len(ending) >= r2:
                word = word[: -len(ending)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
