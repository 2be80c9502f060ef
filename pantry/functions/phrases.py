"""Phrases of a labelled sentence: runs of indices, names, patterns of labels, their texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What cannot start and what cannot end a phrase.
NOT_FIRST = (")", "]", "}", ",", ":", ";", "-", ".", "!", "?", "*", "&", "/", "--")
NOT_LAST = ("[", "(", "{", ",", ":", ";", "-", "&", "/", "*", "--", "+")
_FRACTION = re.compile(r"\d*#\d+\$\d+(?:-\d*#\d+\$\d+)?")


def runs(idx: Sequence[int]) -> list[list[int]]:
    """Groups of indices of which each follows the one before."""
    out: list[list[int]] = []
    for i in idx:
        if out and i == out[-1][-1] + 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def matches(labels: Sequence[str], pattern: Sequence[str], skip_others: bool = True) -> list[list[int]]:
    """Places of a pattern of labels, left to right without overlap; labels that are not in the pattern
    are passed over, if so wished. No pattern matches nowhere."""
    at = [i for i, x in enumerate(labels) if not skip_others or x in pattern]
    out, k = [], 0
    while pattern and k + len(pattern) <= len(at):
        place = at[k : k + len(pattern)]
        if [labels[i] for i in place] == list(pattern):
            out.append(place)
            k += len(pattern)
        else:
            k += 1
    return out


def trimmed(idx: Sequence[int], words: Sequence[str]) -> list[int]:
    """Without punctuation that cannot start or end a phrase, but for a last token, and without
    brackets that have no partner of their kind."""
    idx = list(idx)
    a, b = 0, len(idx)
    while b - a > 1 and words[idx[a]] in NOT_FIRST:
        a += 1
    while b - a > 1 and words[idx[b - 1]] in NOT_LAST:
        b -= 1
    idx = idx[a:b]
    lonely: set[int] = set()
    for left, right in ("()", "[]"):
        opened: list[int] = []
        for i in idx:
            if words[i] == left:
                opened.append(i)
            elif words[i] == right:
                if opened:
                    opened.pop()
                else:
                    lonely.add(i)
        lonely.update(opened)
    return [i for i in idx if i not in lonely]


def shown(word: str) -> str:
    """A marked fraction as it is read: #1$2 -> 1/2, 1#1$2 -> 1 1/2."""
    return plain(word) if _FRACTION.fullmatch(word) else word


def tidy(text: str) -> str:
    """Spaces that joining left around brackets, slashes and punctuation go."""
    text = text.replace("( ", "(").replace(" )", ")").replace(" / ", "/")
    for mark in ",:;.!?*":
        text = text.replace(" " + mark, mark)
    return text.strip()


def distinct_neighbours(parts: Sequence[str]) -> list[int]:
    """Of equal parts beside each other the last one; an empty last part goes as well."""
    return [i for i, x in enumerate(parts) if x != (parts[i + 1] if i + 1 < len(parts) else "")]


def plain(text: str) -> str:
    """Text with its marked fractions as they are read; a range's hyphen takes no space."""
    return text.replace("#", " ").replace("$", "/").strip().replace("- ", "-")


def rendered(
    idx: Sequence[int], words: Sequence[str], scores: Sequence[float], between: str = ", ", labels: Sequence[str] | None = None,
    stop_words: frozenset[str] = frozenset(), used: set[int] | None = None, show: Callable[[int], str] | None = None,
) -> tuple[str, float, int] | None:
    """Text, score to six places and first index of the runs in `idx`; null where nothing is left. The
    score is the mean of the runs' means. Runs that are a stop word, or all PUNC if there are labels, are
    left out; indices of the others are added to `used`."""
    texts, means = [], []
    starts = [idx[-1]] if idx else []
    for run in runs(idx):
        part = trimmed(run, words)
        if not part or (labels is not None and all(labels[i] == "PUNC" for i in part)):
            continue
        text = " ".join(show(i) if show else shown(words[i]) for i in part)
        if text.lower() in stop_words:
            continue
        if used is not None:
            used.update(part)
        texts.append(text)
        means.append(float(sum(Fraction(float(scores[i])) for i in part) / len(part)))
        starts.append(part[0])
    kept = distinct_neighbours(texts)
    if not kept:
        return None
    return tidy(between.join(texts[k] for k in kept)), round(float(sum(Fraction(means[k]) for k in kept) / len(kept)), 6), min(starts)


def name_groups(labels: Sequence[str]) -> list[list[int]]:
    """Runs that belong to one part of a name. A part starts at a B_ label and where NAME_MOD or NAME_VAR
    follows another label, and ends at NAME_SEP."""
    out: list[list[int]] = [[]]
    for i, x in enumerate(labels):
        fresh = x == "NAME_SEP" or x.startswith("B_") or (x in ("NAME_MOD", "NAME_VAR") and (i == 0 or labels[i - 1] != x))
        if fresh:
            out.append([])
        if x != "NAME_SEP":
            out[-1].append(i)
    return [g for g in out if g]


def names(labels: Sequence[str]) -> list[list[int]]:
    """Indices of each name: a variant goes before the next plain part, a modifier before all names
    after it; a plain part that variants have used is no name of its own."""
    done: list[list[int]] = []
    plain: list[int] = []
    used = True
    for group in reversed(name_groups(labels)):
        kind = next((labels[i].rpartition("_")[2] for i in group if labels[i] != "PUNC"), "")
        if kind in ("TOK", "MOD") and plain and not used:
            done.append(plain)
            used = True
        if kind == "TOK":
            plain, used = group, False
        elif kind == "VAR":
            done.append(group + plain)
            used = True
        elif kind == "MOD":
            done = [group + name for name in done]
    if plain and not used:
        done.append(plain)
    return done[::-1]


def number(text: str) -> Fraction | None:
    """The value of a number or marked fraction; null for any other text and for a divisor of zero."""
    try:
        if _FRACTION.fullmatch(text):
            return sum((Fraction(p.replace("$", "/")) for p in text.split("#") if p), Fraction(0))
        return Fraction(text)
    except (ValueError, ZeroDivisionError):
        return None


def by_last_tag(groups: Sequence[Sequence[int]], labels: Sequence[str], tags: Sequence[str]) -> list[list[int]]:
    """Names that end, but for PUNC, in a determiner, preposition or adjective go before the next one."""
    out: list[list[int]] = []
    held: list[int] = []
    for group in groups:
        held = [*held, *group]
        last = next((tags[i] for i in reversed(held) if labels[i] != "PUNC"), None)
        if last not in ("DT", "IN", "JJ"):
            out.append(held)
            held = []
    return [*out, held] if held else out


def without_repeats(found: Sequence[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Of equal texts one, at the first one's place; each repeat halves the way to its own score."""
    out: dict[str, tuple[str, float, int]] = {}
    for text, score, first in found:
        if text in out:
            _, other, before = out[text]
            score, first = round(float((Fraction(other) + Fraction(score)) / 2), 6), min(before, first)
        out[text] = (text, score, first)
    return list(out.values())


_PHRASE = "text:string,confidence:double,first:int"


def phrase(words: Column | str, labels: Column | str, scores: Column | str, label: str) -> Column:
    """struct<text, confidence, first> of the tokens with a label and the punctuation between them;
    null where none has it."""

    @F.pandas_udf(f"struct<{_PHRASE}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for w, x, s in batches:
            rows = []
            for one, kinds, p in zip(w, x, s):
                idx = [] if one is None or kinds is None or p is None else [i for i, k in enumerate(kinds) if k in (label, "PUNC")]
                rows.append((idx and any(kinds[i] == label for i in idx) and rendered(idx, one, p)) or (None, None, None))
            yield pd.DataFrame(rows, columns=["text", "confidence", "first"]).astype({"text": object, "confidence": "Float64", "first": "Int32"})

    found = run(words, labels, scores)
    return F.when(found["text"].isNotNull(), found)


def name_phrases(words: Column | str, labels: Column | str, scores: Column | str) -> Column:
    """array<struct<text, confidence, first>> of the names; tokens with labels of other kinds are none
    of theirs. Null input gives null."""

    @F.pandas_udf(f"array<struct<{_PHRASE}>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for w, x, s in batches:
            rows = []
            for one, kinds, p in zip(w, x, s):
                if one is None or kinds is None or p is None:
                    rows.append(None)
                    continue
                at = [i for i, k in enumerate(kinds) if "NAME" in k or k == "PUNC"]
                found = ([at[i] for i in name] for name in names([kinds[i] for i in at]))
                texts = (rendered(idx, one, p, " ") for idx in found)
                rows.append([dict(zip(("text", "confidence", "first"), t)) for t in texts if t])
            yield pd.Series(rows, dtype=object)

    return run(words, labels, scores)
