"""The published English stemmer (the second Porter algorithm) and the stop words that go with it."""

from __future__ import annotations

import re

# The published stop words of the English analyser.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

# Whole words with stems of their own, and those that stay as they are; tables of suffixes by step.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SPECIAL |= dict.fromkeys(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
KEPT_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES, LI_ENDS = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"

VOWEL = "[aeiouy]"
REGION = re.compile(f"{VOWEL}[^aeiouy]")
SHORT_END = re.compile(f"(?:[^aeiouy]{VOWEL}[^aeiouywxY]|^{VOWEL}[^aeiouy])$")


def longest(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def regions(word: str) -> tuple[int, int]:
    """Where the parts after the first and after the second consonant that follows a vowel begin."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = REGION.search(word)
        first = m.end() if m else len(word)
    m = REGION.search(word, first)
    return first, m.end() if m else len(word)


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in SPECIAL:
        return SPECIAL[word] or word
    if len(word) < 3:
        return word
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = regions(w)
    if s := longest(w, ("'", "'s", "'s'")):
        w = w[: -len(s)]
    # plurals
    s = longest(w, ("sses", "ied", "ies", "s", "us", "ss"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # past and progressive forms
    s = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(VOWEL, w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # double suffixes
    s = longest(w, STEP_2)
    if s and len(w) - len(s) >= r1:
        before = w[-len(s) - 1 : -len(s)]
        if (s != "ogi" or before == "l") and (s != "li" or before and before in LI_ENDS):
            w = w[: -len(s)] + STEP_2[s]
    s = longest(w, STEP_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP_3[s]
    s = longest(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT_END.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexeme(word: str) -> str | None:
    """What a word is found under; stop words under nothing."""
    return None if word in STOP_WORDS else stem(word)
