"""Amounts of a labelled sentence: quantities, units, what qualifies them, and which belong together.

Amounts are found in three rounds, each on the tokens that the ones before have left: amounts that a
container's name closes ("2 15 ounce cans"), amounts of two parts ("1 lb 2 oz", "1 cup plus 1 tbsp"), and
single ones.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

from . import constants as C
from . import phrases as P
from . import units as U

# Fixed values.
PREFIXES = ("about", "approx", "approximately", "nearly", "roughly", "~", "generous")
EACH = ("each",)
MAKES = ("yield", "make")
INDEFINITE = ("couple", "few", "many", "more", "plenty", "several", "some")
CONTAINERS = (
    "bag", "block", "bottle", "box", "bucket", "can", "carton", "container", "envelope", "jar", "loaf", "package", "packet", "piece", "sachet",
    "slice", "tin",
)
POUNDS_OR_PINTS, OUNCES = ("lb", "pound", "pt", "pint"), ("oz", "ounce")
#: Labels by letters: Q QTY, U UNIT, C COMMENT, P PUNC. Longest first.
CONTAINED = ("QQUQUQUU", "QQUQUU", "QQUU", "QUU")
#: Labels, the word that has to stand in the third or fourth place, what joins the parts, is the second taken away?
JOINED = (
    ("QUQUU", None, "", False), ("QUQU", None, "", False), ("QUCQU", "plus", " plus ", False), ("QUPQU", "+", " + ", False),
    ("QUPCQU", "plus", " plus ", False), ("QUCQU", "and", " and ", False), ("QUCQU", "minus", " minus ", True), ("QUCQU", "less", " minus ", True),
)
RANGE = re.compile(r"[\d#$]+\s*-[\d#$]+")
_NUMBER = r"0\.[0-9]+|[1-9][\d.]*|\d*#\d+\$\d+"
_TO = re.compile(rf"({_NUMBER})\s*-?\s*(?:to|or)\s*-*\s*(?={_NUMBER})")
_AND = re.compile(r"(\d+)\sand\s(\d)/(\d+)")
_SPELLED = re.compile(r"\b(" + "|".join(C.STRING_NUMBERS) + r")\b", re.IGNORECASE)

QTY, UNIT = ("QTY",), ("UNIT",)
#: Rules of a qualifier, first come first served: the token's labels, the words that have to stand at
#: distances from it, the distances of tokens that are used up.
APPROXIMATE = (
    (QTY, {-1: PREFIXES}, (-1,)),
    (QTY, {-2: PREFIXES, -1: (".",)}, (-1, -2)),
    (UNIT, {-1: PREFIXES}, (-1,)),
    (QTY + UNIT, {1: ("or",), 2: ("so",)}, (1, 2)),
)
SINGULAR = ((UNIT, {1: EACH}, (1,)), (UNIT, {1: (")", "]"), 2: EACH}, (2,)))
BOTH = ((QTY, {-2: EACH, -1: PREFIXES}, (-1, -2)), (UNIT, {1: ("or",), 2: ("so",), 3: EACH}, (1, 2, 3)))
PREPARED = ((QTY, {-2: ("to",), -1: MAKES}, (-1, -2)), (QTY, {-3: ("to",), -2: MAKES, -1: PREFIXES}, (-2, -3)))


@dataclass
class Token:
    word: str
    label: str
    score: float
    index: int
    plural: bool = False
    tag: str = ""


@dataclass
class Amount:
    quantity: str
    unit: list[str]
    scores: list[float]
    first: int
    related: bool = False
    implied: bool = False
    approximate: bool = False
    singular: bool = False
    prepared: bool = False


@dataclass(frozen=True)
class Units:
    """How units are written: left as text or resolved, by which system, and what further units there are."""

    as_text: bool = False
    system: str = "us_customary"
    custom: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        table = C.units() | dict(self.custom)
        plural: dict[str, str] = {}
        for many, one in table.items():
            plural.setdefault(one, many)
        object.__setattr__(self, "_plural", plural)
        object.__setattr__(self, "_words", re.compile(r"\b(" + "|".join(map(re.escape, sorted(plural, key=len, reverse=True))) + r")\b"))

    def plural(self, text: str) -> str:
        """Every singular unit word of the text in its plural."""
        return self._words.sub(lambda m: self._plural[m[1]], text)

    def same(self, a: str, b: str) -> bool:
        """Do two words name one unit: equal in the singular, or synonyms?"""
        table = C.units()
        a, b = (table.get(x, x).lower() for x in (a, b))
        return a == b or any(a in group and b in group for group in C.UNIT_SYNONYMS)


def mean(values: Sequence[float]) -> float:
    return float(sum(map(Fraction, values)) / len(values))


def in_digits(tokens: Sequence[Token]) -> list[Token]:
    """Number words of quantities as digits; neighbouring quantities such as `1 and 1/2` or `1 to 2` as
    one token that has their mean score and the first one's place."""
    tokens = [Token(**vars(t)) for t in tokens]
    for t in tokens:
        if t.label == "QTY":
            t.word = _SPELLED.sub(lambda m: C.STRING_NUMBERS[m[1].lower()], t.word)
    gone: set[int] = set()
    for run in P.runs([i for i, t in enumerate(tokens) if t.label == "QTY"]):
        said = " ".join(tokens[i].word for i in run)
        whole = _AND.sub(r"\1#\2$\3", said)
        if whole == said:
            whole = _TO.sub(r"\1-", said)
        if len(run) > 1 and whole != said:
            tokens[run[0]].word, tokens[run[0]].score = whole, mean([tokens[i].score for i in run])
            gone.update(run[1:])
    return [t for i, t in enumerate(tokens) if i not in gone]


def _fits(rules: tuple, tokens: Sequence[Token], i: int, used: set[int]) -> bool:
    """Does a rule hold at place i? Then what it is made of is used up. Nothing holds beyond the ends."""
    near = lambda k: tokens[i + k].word.lower() if 0 <= i + k < len(tokens) else None
    for labels, words, spent in rules:
        if 0 <= i < len(tokens) and tokens[i].label in labels and all(near(k) in many for k, many in words.items()):
            used.update(tokens[i + k].index for k in spent)
            return True
    return False


def _letters(tokens: Sequence[Token]) -> str:
    letter = {"QTY": "Q", "UNIT": "U", "COMMENT": "C", "PUNC": "P"}
    return "".join(letter.get(t.label, "-") for t in tokens)


def contained(tokens: Sequence[Token], used: set[int]) -> list[Amount]:
    """Amounts that the name of a container closes: the container's count (1 if there is none), then what
    each holds. Labels of other kinds are passed over."""
    at = [i for i, t in enumerate(tokens) if t.label in ("QTY", "UNIT")]
    letters = _letters([tokens[i] for i in at])
    out = []
    for pattern in CONTAINED:
        for m in re.finditer(pattern, letters):
            place = at[m.start() : m.end()]
            it = [tokens[i] for i in place]
            if it[-1].word not in CONTAINERS or any(t.index in used for t in it):
                continue
            used.update(t.index for t in it)
            counted = pattern.startswith("QQ")
            quantity = it[0].word if counted else "1"
            scores = [it[0].score, it[-1].score] if counted else [it[-1].score]
            outer = Amount(quantity, [it[-1].word], scores, it[0].index, approximate=_fits(APPROXIMATE, tokens, place[0], used))
            out.append(outer)
            inner = it[1 if counted else 0 : -1]
            for q, u in zip(inner[::2], inner[1::2]):  # the score is the quantity's
                out.append(Amount(q.word, [u.word], [q.score], q.index, approximate=outer.approximate, singular=True))
    return out


def joined(tokens: Sequence[Token], used: set[int]) -> list[tuple[list[Amount], str, bool]]:
    """Amounts of two parts, which share their qualifiers: (parts, what joins them, is the second taken away?)."""
    letters = _letters(tokens)
    out = []
    for pattern, word, join, less in JOINED:
        for m in re.finditer(pattern, letters):
            a, stop = m.span()
            b = a + pattern.index("Q", 1)
            if word is None:
                if tokens[a + 1].word not in POUNDS_OR_PINTS or tokens[stop - 1].word not in OUNCES:
                    continue
            elif tokens[b - 1].word.lower() != word:
                continue
            parts = [Amount(tokens[i].word, [t.word for t in tokens[i + 1 : j]], [t.score for t in tokens[i:j]], tokens[i].index) for i, j in ((a, a + 2), (b, stop))]
            # qualifiers are looked for by places in the sentence, not among the tokens left
            one, two = tokens[a].index, tokens[b].index
            prepared = _fits(PREPARED, tokens, one, used) or _fits(PREPARED, tokens, two, used)
            approximate = _fits(APPROXIMATE, tokens, one, used) or _fits(PREPARED, tokens, two, used)
            singular = _fits(SINGULAR, tokens, tokens[a + 1].index, used) or _fits(SINGULAR, tokens, tokens[stop - 1].index, used)
            both = _fits(BOTH, tokens, one, used) or _fits(BOTH, tokens, two, used)
            for part in parts:
                part.prepared, part.approximate, part.singular = prepared, approximate or both, singular or both
            out.append((parts, join, less))
            used.update(t.index for t in tokens[a:stop])
    return out


def single(tokens: Sequence[Token], used: set[int], units: Units) -> list[Amount]:
    """A quantity and the units up to the next one. `dozen` adds to the quantity before it; a unit before
    all quantities has quantity 1, unless it is plural or something like `some` stands before it."""
    after_opening = {t.index + 1 for t in tokens if t.word in ("(", "/", "[")}
    out: list[Amount] = []
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i and tokens[i - 1].label == "QTY" else None
        if t.label == "QTY" and t.word == "dozen" and before:
            out[-1].quantity += " dozen"
            out[-1].scores.append(t.score)
        elif t.label == "QTY":
            out.append(Amount(t.word, [], [t.score], t.index, related=bool(before and before.word.endswith("x")) or i in after_opening))
        elif t.label == "UNIT":
            if not out:
                implied = not t.plural and not any(x.word.lower() in INDEFINITE for x in tokens[:i])
                out.append(Amount("1" if implied else "", [], [t.score], t.index, implied=implied))
            now = out[-1]
            if t.plural and now.implied:
                now.quantity, now.implied = "", False
            now.unit.append(units.plural(t.word) if t.plural and now.quantity == "" else t.word)
            now.scores.append(t.score)
        if _fits(APPROXIMATE, tokens, i, used):
            out[-1].approximate = True
        if _fits(SINGULAR, tokens, i, used):
            out[-1].singular = True
        if _fits(BOTH, tokens, i, used):
            out[-1].approximate = out[-1].singular = True
        if _fits(PREPARED, tokens, i, used):
            out[-1].prepared = True
    return _shared(out)


def _shared(amounts: list[Amount]) -> list[Amount]:
    """Related amounts have the same qualifiers; those after a multiplier are singular."""
    heads = [i for i, a in enumerate(amounts) if not i or not a.related]
    for i, j in zip(heads, [*heads[1:], len(amounts)]):
        group, times = amounts[i:j], False
        for name in ("approximate", "singular", "prepared"):
            some = any(getattr(a, name) for a in group)
            for a in group:
                setattr(a, name, some)
        for a in group:
            a.singular |= times
            times |= a.quantity.endswith("x")
    return amounts


def _value(text: str) -> Fraction | None:
    """Null for a plain n/d, and for exponents of four digits and more, which nobody weighs out."""
    return None if "/" in text or re.search(r"[eE][+-]?\d{4}", text) else P.number(text)


def described(amount: Amount, units: Units) -> dict:
    """The amount as it is returned. Quantities are exact: a whole number, n/d, or the text if it is no
    number; `value` is the lower one as a double, else null."""
    quantity, unit = amount.quantity, " ".join(amount.unit)
    times = quantity.endswith("x")
    bare = quantity[:-1] if times else quantity
    ends = [P.number(x) for x in bare.split("-")] if RANGE.fullmatch(bare) else [_value(bare)]
    ranged = len(ends) > 1 and None not in ends
    low, high = (min(ends), max(ends)) if None not in ends else (None, None)
    known = None if units.as_text else U.resolved(unit, units.system)
    text, named = f"{quantity} {unit}".strip(), known or unit
    if not ranged and (bare != "" if low is None else low != 1):
        text, named = units.plural(text), known or units.plural(unit)
    shown = lambda x: bare if x is None else str(x)
    return {
        "quantity": shown(low), "quantity_max": shown(high), "value": None if low is None or abs(low) > 10**300 else float(low), "unit": named, "text": P.plain(text),
        "confidence": round(mean(amount.scores), 6), "first": amount.first, "approximate": amount.approximate, "singular": amount.singular, "range": ranged,
        "multiplier": times, "prepared": amount.prepared, "unit_system": U.system_of(named),
    }


def _of_parts(parts: list[dict], join: str, less: bool) -> dict:
    systems = {p["unit_system"] for p in parts}
    system = next(iter(systems)) if len(systems) == 1 else next((s for s in ("australian", "japanese") if s in systems), "other")
    confidence = mean([p["confidence"] for p in parts])
    return {"text": (join or " ").join(p["text"] for p in parts), "confidence": confidence, "first": min(p["first"] for p in parts), "unit_system": system, "joined_by": join, "subtractive": less, "parts": parts}


def amounts(tokens: Sequence[Token], used: set[int], units: Units, corrected: bool = False) -> list[dict]:
    """All amounts by first token; `used` gets the indices of what they are made of, single ones'
    quantities and units excepted. `corrected`: unit words that name one unit count once."""
    left = lambda: [t for t in tokens if t.index not in used]
    out = [_of_parts([described(a, units)], "", False) for a in contained(left(), used)]
    out += [_of_parts([described(a, units) for a in parts], join, less) for parts, join, less in joined(left(), used)]
    for a in single(left(), used, units):
        if corrected and len(a.unit) > 1 and all(units.same(u, a.unit[0]) for u in a.unit):
            a.unit = a.unit[:1]
        out.append(_of_parts([described(a, units)], "", False))
    return sorted(out, key=lambda a: a["first"])
