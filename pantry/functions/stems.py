"""Two stemmers of English words: one for the sequence model's features, one for retrieval.

Both work on words that a task keeps once it has seen them, since words repeat far more than rows do.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings and what stands for them, in the order in which they are tried.
PORTER_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
PORTER_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _letters(word: str) -> list[str]:
    """V or C for each letter; a y is V right after a consonant other than y."""
    return ["V" if c in "aeiou" or (c == "y" and i and word[i - 1] not in "aeiouy") else "C" for i, c in enumerate(word)]


def _groups(word: str) -> str:
    """Letters with equal ones together, but every y that is V by itself."""
    kinds = [(k, i if c == "y" and k == "V" else -1) for i, (k, c) in enumerate(zip(_letters(word), word))]
    return "".join(k for (k, _), _ in groupby(kinds))


def _measure(word: str) -> float:
    groups = _groups(word)
    return (len(groups) - groups.startswith("C") - groups.endswith("V")) / 2 if word else -1


def _replaced(word: str, endings: tuple) -> str:
    """The first ending before which the measure is above zero is replaced."""
    for ending, other in endings:
        if word.endswith(ending) and _measure(word[: -len(ending)]) > 0:
            return word[: -len(ending)] + other
    return word


def _without_ed_ing(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = next((e for e in ("ed", "ing") if word.endswith(e)), None)
    stem = word[: -len(ending)] if ending else ""
    if "V" not in _letters(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz":
        return stem[:-1]
    short = _measure(stem) == 1 and _letters(stem)[-3:] == ["C", "V", "C"] and stem[-1] not in "wxy"
    return stem + "e" if short else stem


@lru_cache(1 << 16)
def porter(token: str) -> str:
    """Porter's stemmer (1980), with these ways of its own: tokens of one or two characters stay as they are;
    one last s goes unless it follows another; groups of letters are as in `_groups`."""
    if len(token) < 3:
        return token
    word = token.lower()
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss") and len(word) > 2:
        word = word[:-1]
    word = _without_ed_ing(word)
    if word.endswith("y") and "V" in _groups(word)[:-1]:
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, PORTER_2), PORTER_3)
    ending = max((e for e in PORTER_4 if word.endswith(e) and len(e) < len(word)), key=len, default=None)
    if ending and _measure(word[: -len(ending)]) > 1:
        word = word[: -len(ending)]
    elif word.endswith(("sion", "tion")) and len(word) > 4 and _measure(word[:-3]) > 1:
        word = word[:-3]
    bare = word[:-1] if word.endswith("e") else word
    m = _measure(bare)
    closed = _letters(word)[-4:][:3] == ["C", "V", "C"] and len(word) > 1 and word[-2] not in "wxy"
    if m > 1 or (m == 1 and not closed):
        word = bare
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


# Words with stems of their own.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
} | dict.fromkeys(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
KEPT = ("inning", "outing", "canning", "herring", "earring")
CEED = ("proceed", "exceed", "succeed")

# Endings of steps 2 to 4 and what stands for them; steps 2 and 3 look in the first region, step 4 in the second.
ENGLISH_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ENGLISH_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
ENGLISH_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 16)
def english(token: str) -> str:
    """The Snowball project's English stemmer (Porter 2), always in lower case."""
    word = token.lower()
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word] or word
    if word.removesuffix("s") in KEPT:
        return word.removesuffix("s") if word == word.removesuffix("s") else word.removesuffix("s")
    for root in CEED:
        if word.startswith(root) and word[len(root) :] in ("", "s", "ed", "ing"):
            return root
    word = re.sub("[’‘‛]", "'", word).removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    fixed = re.match("gener|arsen|commun", word)
    first = fixed or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    r2 = second.end() if second else len(word)

    ending = _longest(word, ("'s'", "'s", "'"))
    word = word[: len(word) - len(ending or "")]
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[: -2 if len(word) > 4 else -1]
    elif ending == "s" and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]

    ending = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search("[aeiouy]", word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    ending = _longest(word, ENGLISH_2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if (ending != "ogi" or before.endswith("l")) and (ending != "li" or before[-1:] in tuple("cdeghkmnrt")):
            word = before + ENGLISH_2[ending]
    ending = _longest(word, ENGLISH_3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + ENGLISH_3[ending]
    ending = _longest(word, ENGLISH_4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    at = len(word) - 1
    if word.endswith("l") and at >= r2 and word.endswith("ll"):
        word = word[:-1]
    elif word.endswith("e") and (at >= r2 or (at >= r1 and not re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word[:-1]))):
        word = word[:-1]
    return word.replace("Y", "y")


def _stems(tokens: Column | str, one: Callable[[str], str]) -> Column:
    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [None if t is None else one(t) for t in row] for row in batch], dtype=object)

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def porter_stems(tokens: Column | str) -> Column:
    """The stem of each token; null stays null."""
    return _stems(tokens, porter)


def english_stems(tokens: Column | str) -> Column:
    """The stem of each token; null stays null."""
    return _stems(tokens, english)
