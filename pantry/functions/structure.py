"""Phrases in a tagged sentence, found by staged patterns over its tags."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from . import constants as C

# Label and tag pattern of each stage. A later stage sees what an earlier one found as one
# piece under its label.
ALTERNATIVES = (("EMIP", "<NN.*|JJ.*>+<,><NN.*|JJ.*>+<,>?<CC><DT|NN.*|JJ.*>*<NN.*>"), ("MIP", "<NN.*|JJ.*>+<CC><DT|NN.*|JJ.*>*<NN.*>"))
STARTS = (("CS_WU", "<CC><RB>?<CD|DT>+<RB>?<UNIT|SIZE>+"), ("CS_NU", "<CC><CD|DT>+<NN.*|JJ.*>"), ("CS_HALF", "<CC><HALF>"))
# NP's first group has no repetition within its repetition: the same spans, without exponential search.
EXAMPLES = (("NP", "(<NN.*|JJ.*><,>?)*<CC|DT>?<NN.*|JJ.*>*<NN.*>"), ("EX", "<JJ.*>?<IN><NP>"))
DIMENSIONAL = (("LENGTH", "<CD><LEN>"), ("PLENGTH", r"<\(><LENGTH><\)>"), ("SLENGTH", "<SYM><LENGTH>"), ("DP", "<LENGTH><SLENGTH|PLENGTH>?<IN>?<DIM>*"))


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    parts = {".": "[^<>]", "<": "(?:<(?:", ">": ")>)"}
    return re.compile(re.sub(r"\\.|[.<>]", lambda m: parts.get(m[0], m[0]), pattern))


def chunk(tags: Sequence[str], stages: Sequence[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """The phrases that stand at the top after the last stage: (label, first, past the last)."""
    pieces = [(tag, i, i + 1, False) for i, tag in enumerate(tags)]
    for label, pattern in stages:
        text = "".join(f"<{p[0]}>" for p in pieces)
        starts = {}
        at = 0
        for k, p in enumerate(pieces):
            starts[at] = k
            at += len(p[0]) + 2
        starts[at] = len(pieces)
        out, done = [], 0
        for m in _compiled(pattern).finditer(text):
            if m.end() == m.start():
                continue
            a, b = starts[m.start()], starts[m.end()]
            out += pieces[done:a]
            out.append((label, pieces[a][1], pieces[b - 1][2], True))
            done = b
        pieces = out + pieces[done:]
    return [p[:3] for p in pieces if p[3]]


def _other_conjunction(words: Sequence[str], tags: Sequence[str], a: int, b: int) -> bool:
    """Is the first conjunction something else than `or`?"""
    first = next((i for i in range(a, b) if tags[i] == "CC"), None)
    return first is not None and words[first].lower() != "or"


def alternatives(words: Sequence[str], tags: Sequence[str]) -> list[tuple[int, int]]:
    """Phrases that name one ingredient or another, without units and sizes at their start. A phrase
    of nothing else is none."""
    skipped = {*C.all_unit_words(), *C.SIZES}
    out = []
    for _, a, b in chunk(tags, ALTERNATIVES):
        if _other_conjunction(words, tags, a, b):
            continue
        while a < b and words[a].lower() in skipped:
            a += 1
        if a < b and tags[a] != "CC":
            out.append((a, b))
    return out


def sentence_starts(words: Sequence[str], feats: Sequence[str], tags: Sequence[str]) -> list[int]:
    """Where another ingredient's sentence starts within the sentence."""
    units = set(C.all_unit_words())
    kinds = ["UNIT" if (w := x.lower()) in units else "SIZE" if w in C.SIZES else "HALF" if w == "half" else t for x, t in zip(words, tags)]
    return [a for _, a, b in chunk(kinds, STARTS) if not _other_conjunction(feats, kinds, a, b)]


def examples(words: Sequence[str], tags: Sequence[str]) -> list[tuple[int, int]]:
    """Phrases that give examples: such as, as, like, e.g.; another adjective before them is left out."""
    opens = lambda i: (words[i].lower(), tags[i]) in (("as", "IN"), ("like", "IN"), ("e.g.", "IN"))
    out = []
    for label, a, b in chunk(tags, EXAMPLES):
        if label != "EX":
            continue
        such = b - a > 1 and (words[a].lower(), tags[a]) == ("such", "JJ") and (words[a + 1].lower(), tags[a + 1]) == ("as", "IN")
        if such or opens(a):
            out.append((a, b))
        elif tags[a] == "JJ" and opens(a + 1):
            out.append((a + 1, b))
    return out


def dimensions(words: Sequence[str], tags: Sequence[str]) -> list[tuple[int, int]]:
    kinds = ["LEN" if x.lower() in C.LENGTH_UNITS and t != "IN" else "DIM" if x.lower() in C.DIMENSIONS else t for x, t in zip(words, tags)]
    return [(a, b) for label, a, b in chunk(kinds, DIMENSIONAL) if label == "DP"]
