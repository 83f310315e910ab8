"""English word stems (the Porter 2 rules) and stop words, for full-text search."""

from __future__ import annotations

import re
from functools import lru_cache

#: The words that an English full-text configuration leaves out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too
    very s t can will just don should now""".split()
)

#: Words whose stem the rules don't give.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
#: Words that lose nothing more once plurals are gone.
_WHOLE = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
#: Suffixes that give way to others within the first region, longest first.
_STEP_2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin: each after the first consonant that follows a vowel."""
    begun = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if begun is None:
        found = _REGION.match(word)
        begun = found.end() if found else len(word)
    found = _REGION.match(word, begun)
    return begun, found.end() if found else len(word)


def _is_short(word: str, first: int) -> bool:
    return first >= len(word) and _SHORT_END.search(word) is not None


def _plurals(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if _VOWEL.search(word[:-2]) else word


def _past(word: str, first: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + "ee" if len(word) - len(suffix) >= first else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if not _VOWEL.search(rest):
                return word
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if _DOUBLE.search(rest):
                return rest[:-1]
            return rest + "e" if _is_short(rest, first) else rest
    return word


def _replaced(word: str, first: int, second: int, rules: tuple) -> str:
    for suffix, other in rules:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            fits = at >= (second if suffix == "ative" else first)
            if suffix == "ogi":
                fits = fits and word[at - 1 : at] == "l"
            if suffix == "li":
                fits = fits and word[at - 1 : at] in tuple("cdeghkmnrt")
            return word[:at] + other if fits else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = word.removeprefix("'")
    # a y that is a consonant is written Y meanwhile
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    first, second = _regions(word)
    word = re.sub("'s'$|'s$|'$", "", word)
    word = _plurals(word)
    if word in _WHOLE:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _replaced(word, first, second, _STEP_2)
    word = _replaced(word, first, second, _STEP_3)
    for suffix in _STEP_4:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= second and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        rest = word[:-1]
        if len(rest) >= second or len(rest) >= first and not _SHORT_END.search(rest):
            word = rest
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()
