"""Normalisation of ingredient sentences as column expressions.

Everything but HTML entities is a chain of built-in expressions, so that it stays in the JVM; texts
without an ampersand never leave it.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

_D = r"\p{Nd}"
_SPACE = r"(?U)\s"
_FRACTION = rf"{_D}*#{_D}+\${_D}+"
_DECIMAL = rf"[{_D}.]+|{_FRACTION}"
_UNITS = "|".join(sorted({*C.all_unit_words(), "x", *C.LENGTH_UNITS}))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, step: Callable[[Column], Column]) -> Column:
    """step(c) where the step looks at its column more than once: the value is computed once, and the
    expression does not grow with the number of looks."""
    return F.get(F.transform(F.array(c), step), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often what follows looks at it: a step of its
    own, which the optimiser does not merge with others."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def remove_prices(c: Column) -> Column:
    marks = "|".join("\\" + m if m == "$" else m for m in C.CURRENCIES)
    return F.regexp_replace(c, rf"(?U)\(\s*(?:{marks})\s*[0-9.,]+\**\s*\)", "")


def replace_dashes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("—"), F.lit(" - "))


def unescape_html(c: Column) -> Column:
    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return F.when(F.contains(c, F.lit("&")), unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def replace_vulgar_fractions(c: Column) -> Column:
    for sign, text in C.VULGAR_FRACTIONS.items():
        c = F.replace(c, F.lit("-" + sign), F.lit("-" + text))
    for sign, text in C.VULGAR_FRACTIONS.items():
        c = F.replace(c, F.lit(sign), F.lit(" " + text))
    return c


def join_split_fractions(c: Column) -> Column:
    """1 and 1/2 -> 1#1$2"""
    return F.regexp_replace(c, rf"(?U)({_D}+)\sand\s({_D})/({_D}+)", r"$1#$2\$$3")


def mark_fractions(c: Column) -> Column:
    """1/2 -> #1$2, 1 1/2 -> 1#1$2, the longest first; parts that add up to 100 are a ratio."""
    c = F.replace(c, F.lit("⁄"), F.lit("/"))
    found = F.transform(F.regexp_extract_all(c, F.lit(rf"(?U)({_D}*\s*{_D}/{_D}+)"), F.lit(1)), lambda m: strip(m))
    found = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))

    def step(text: Column, m: Column) -> Column:
        parts = F.split(m, "/")
        ratio = ~F.contains(m, F.lit(" ")) & F.coalesce(F.expr("try_cast(0 as decimal(38,0))") + parts[0].try_cast("decimal(37,0)") + parts[1].try_cast("decimal(37,0)") == 100, F.lit(False))
        dollar = F.replace(m, F.lit("/"), F.lit("$"))
        new = F.when(F.contains(dollar, F.lit(" ")), F.regexp_replace(dollar, " +", "#")).otherwise(F.concat(F.lit("#"), dollar))
        return F.when(ratio, text).otherwise(F.replace(text, m, new))

    return F.when(F.contains(c, F.lit("/")), F.aggregate(found, c, step)).otherwise(c)


def split_quantities(c: Column) -> Column:
    """2cup -> 2 cup, cup2 -> cup 2, lb-1 -> lb - 1, two-cup -> two cup"""
    numbers = "|".join(C.STRING_NUMBERS)
    c = F.regexp_replace(c, rf"({_D})-?({_UNITS})(?![a-wyzA-WYZ])", "$1 $2")
    c = F.regexp_replace(c, rf"({_UNITS})({_D})", "$1 $2")
    c = F.regexp_replace(c, rf"({_UNITS})-({_D})", "$1 - $2")
    return F.regexp_replace(c, rf"(?iu)(?U)\b({numbers})\b-\b({_UNITS})\b", "$1 $2")


def drop_unit_periods(c: Column) -> Column:
    for unit in [*C.PERIOD_UNITS, *(u.capitalize() for u in C.PERIOD_UNITS)]:
        c = F.replace(c, F.lit(unit + "."), F.lit(unit))
    return c


def replace_string_ranges(c: Column) -> Column:
    """1 to 2, 4 or 5, 5- or 6- -> 1-2, 4-5, 5-6-"""
    a = rf"0\.[0-9]|[1-9][{_D}.]*?|{_FRACTION}"
    b = rf"0\.[0-9]+|[1-9][{_D}.]*?|{_FRACTION}"
    return F.regexp_replace(c, rf"(?U)({a})\s*(-)?\s*(to|or)\s*(-)*\s*(({b})(-)?)", "$1-$5")


def merge_unit_ranges(c: Column) -> Column:
    """227 g - 283.5 g -> 227-283.5 g, if the units are equal or synonyms"""
    pattern = F.lit(rf"(?iuU)(({_DECIMAL})\s([a-zA-Z]+)\s*(?:-|to|or)\s*({_DECIMAL})\s([a-zA-Z]+))")
    groups = [F.regexp_extract_all(c, pattern, F.lit(i)).alias(f"g{i}") for i in range(1, 6)]
    singular = C.units()
    classes = {w: str(n) for n, s in enumerate(C.UNIT_SYNONYMS) for w in s}
    of = {w: classes[singular.get(w, w)] for w in C.all_unit_words() if singular.get(w, w) in classes}
    table = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    words = F.array(*[F.lit(w) for w in [*C.all_unit_words(), *C.LENGTH_UNITS]])

    def step(text: Column, m: Column) -> Column:
        u, v = m["g3"], m["g5"]
        same = (u == v) | F.coalesce(table[u] == table[v], F.lit(False))
        return F.when(same & F.array_contains(words, u), F.replace(text, m["g1"], F.concat(m["g2"], F.lit("-"), m["g4"], F.lit(" "), u))).otherwise(text)

    return F.when(F.regexp_like(c, pattern), F.aggregate(F.arrays_zip(*groups), c, step)).otherwise(c)


def merge_quantity_x(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)({_DECIMAL})\s[xX]\s*", "$1x ")


def collapse_ranges(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)({_D})\s*-\s*([{_D}#])", "$1-$2")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


STEPS = (
    remove_prices, replace_dashes, unescape_html, replace_vulgar_fractions, join_split_fractions, mark_fractions, split_quantities,
    drop_unit_periods, replace_string_ranges, merge_unit_ranges, merge_quantity_x, collapse_ranges, strip,
)


def normalise(sentence: Column | str) -> Column:
    """All steps in their order; a null sentence stays null."""
    c = _column(sentence)
    for step in STEPS:
        c = bound(c, step) if step in (mark_fractions, merge_unit_ranges) else step(c)
    return c
