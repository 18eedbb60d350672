"""English stemming by the published Snowball rules (Porter's second algorithm), and the words that carry no meaning."""

from __future__ import annotations

import re

# Words that are not searched for.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Words with a stem of their own.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())

# Endings of the second and third step, and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_VOWEL = "aeiouy"
_REGION = re.compile("[aeiouy][^aeiouy]")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    after = lambda at: (m.end() if (m := _REGION.search(w, at)) else len(w))
    r1 = len(head) if head else after(0)
    return r1, after(r1)


def _ends_short(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-3] not in _VOWEL and w[-2] in _VOWEL and w[-1] not in _VOWEL + "wxY"


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words with other than ASCII letters and apostrophes are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    # A y that is a consonant is written Y.
    w = re.sub("(?<=[aeiouy])y", "Y", "Y" + w[1:] if w[:1] == "y" else w)
    r1, r2 = _regions(w)
    w = w[: -len(e)] if (e := _longest(w, ("'", "'s", "'s'"))) else w
    w = _plural(w)
    if w in KEPT:
        return w
    w = _verb(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    if (e := _longest(w, SECOND)) and len(w) - len(e) >= r1 and (e != "ogi" or w[-4:-3] == "l") and (e != "li" or w[-3:-2] and w[-3] in "cdeghkmnrt"):
        w = w[: -len(e)] + SECOND[e]
    if (e := _longest(w, THIRD)) and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + THIRD[e]
    if (e := _longest(w, FOURTH)) and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        return w[:-1]
    return w


def _verb(w: str, r1: int) -> str:
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e is None:
        return w
    base = w[: -len(e)]
    if e in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else w
    if not any(c in _VOWEL for c in base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(_DOUBLE):
        return base[:-1]
    # A short word: R1 is empty and it ends in a short syllable.
    return base + "e" if len(base) <= r1 and _ends_short(base) else base
