"""The English Snowball stemmer (Porter2), as published with its rules, and the stop words that go with it.

Small helpers for workers: they see distinct words, and remember what they have worked out.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The stop words of the English Snowball configuration.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)
#: Words with stems of their own, and words that stay after the first step.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what they become, in steps 2 and 3; the longest one that fits counts.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_VOWEL = "aeiouy"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
#: A short syllable at the end: vowel between other letters, the last not w, x or Y; or a vowel that begins the word.
_SHORT = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel behind a vowel begins, looked for from `start` on."""
    found = _REGION.match(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str:
    """The longest of some endings that a word has; empty if it has none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word; others than ASCII letters and apostrophes are taken for consonants."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    exact = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = exact if exact is not None else _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub(r"('s'|'s|')$", "", word)
    word = _plural(word)
    if word in STAY:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    word = _suffix(word, r1, r2)
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _plural(word: str) -> str:
    """Step 1a."""
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and any(c in _VOWEL for c in word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    """Step 1b."""
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        return word[: -len(ending)] + "ee" if len(word) - len(ending) >= r1 else word
    if not ending or not any(c in _VOWEL for c in word[: -len(ending)]):
        return word
    word = word[: -len(ending)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _DOUBLE.search(word):
        return word[:-1]
    return word + "e" if r1 >= len(word) and _SHORT.search(word) else word


def _suffix(word: str, r1: int, r2: int) -> str:
    """Steps 2 to 4."""
    ending = _longest(word, (*STEP2, "ogi", "li"))
    at = len(word) - len(ending)
    if ending and at >= r1:
        if ending == "ogi":
            word = word[:-1] if word[at - 1 : at] == "l" else word
        elif ending == "li":
            word = word[:-2] if word[at - 1 : at] in tuple("cdeghkmnrt") else word
        else:
            word = word[:at] + STEP2[ending]
    ending = _longest(word, (*STEP3, "ative"))
    at = len(word) - len(ending)
    if ending and at >= r1:
        if ending != "ative":
            word = word[:at] + STEP3[ending]
        elif at >= r2:
            word = word[:at]
    ending = _longest(word, (*STEP4, "ion"))
    at = len(word) - len(ending)
    if ending and at >= r2 and (ending != "ion" or word[at - 1 : at] in ("s", "t")):
        word = word[:at]
    return word


_TERM = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 16)
def english(term: str) -> str:
    """A term's stem; empty for a stop word."""
    return "" if term in STOP else stem(term)


def simple(term: str) -> str:
    return term


ANALYZERS = {"english": english, "simple": simple}


def terms(text: str | None, analyzer: str) -> tuple[list[tuple[str, int]], int]:
    """The (term, position from 0) of a text, and how many words it has; stop words are counted but have no term."""
    found = _TERM.findall((text or "").lower())
    of = ANALYZERS[analyzer]
    return [(t, k) for k, w in enumerate(found) if (t := of(w))], len(found)


def length(text: str | None) -> int:
    """How many words `terms` counts in a text."""
    return len(_TERM.findall((text or "").lower()))
