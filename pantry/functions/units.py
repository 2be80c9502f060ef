"""Conversion between units as column expressions: volumes, masses, lengths, and volume to mass by density."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Litres, grams and metres in a unit.
VOLUMES = {
    "liter": 1.0, "litre": 1.0, "l": 1.0, "milliliter": 0.001, "millilitre": 0.001, "ml": 0.001, "centiliter": 0.01, "cl": 0.01, "deciliter": 0.1, "dl": 0.1,
    "gallon": 3.785411784, "quart": 0.946352946, "pint": 0.473176473, "cup": 0.2365882365, "fluid_ounce": 0.0295735295625, "tablespoon": 0.01478676478125,
    "teaspoon": 0.00492892159375,
}
MASSES = {"gram": 1.0, "g": 1.0, "kilogram": 1000.0, "kg": 1000.0, "milligram": 0.001, "mg": 0.001, "pound": 453.59237, "ounce": 28.349523125, "stone": 6350.29318}
LENGTHS = {"meter": 1.0, "metre": 1.0, "m": 1.0, "centimeter": 0.01, "cm": 0.01, "millimeter": 0.001, "mm": 0.001, "inch": 0.0254, "foot": 0.3048}
SHORT = {"tbsp": "tablespoon", "tsp": "teaspoon", "c": "cup", "pt": "pint", "qt": "quart", "gal": "gallon", "floz": "fluid_ounce", "lb": "pound", "oz": "ounce", "in": "inch"}
REGIONAL = {
    "us": {},
    "metric": {"cup": 0.25, "tablespoon": 0.015, "teaspoon": 0.005},
    "aus": {"tablespoon": 0.02, "pint": 0.57},
    "jp": {"cup": 0.2},
    "imperial": {"gallon": 4.54609, "quart": 1.1365225, "pint": 0.56826125, "cup": 0.284130625, "fluid_ounce": 0.0284130625},
}
# Units that have a name of their own in another system.
ALTERNATIVES = {
    "imperial": {
        "cup": "imperial_cup", "fluid_ounce": "imperial_fluid_ounce", "quart": "imperial_quart", "pint": "imperial_pint", "gallon": "imperial_gallon",
        "tablespoon": "imperial_tablespoon", "teaspoon": "imperial_teaspoon", "ounce": "imperial_ounce", "pound": "imperial_pound",
    },
    "metric": {"cup": "metric_cup", "tablespoon": "metric_tablespoon", "teaspoon": "metric_teaspoon"},
    "australian": {"cup": "metric_cup", "pint": "aus_pint", "tablespoon": "aus_tablespoon", "teaspoon": "metric_teaspoon"},
    "japanese": {"cup": "jp_cup", "tablespoon": "metric_tablespoon", "teaspoon": "metric_teaspoon"},
    "us_customary": {},
}
# Spellings that mean a unit, and words that are no unit of measure though they look like one.
SPELLINGS = {
    "fl oz": "floz", "fluid oz": "fluid_ounce", "fl ounce": "fluid_ounce", "fluid ounce": "fluid_ounce", "C": "cup", "c": "cup", "qt": "quart",
    "Cl": "centiliter", "G": "gram", "Ml": "milliliter", "Mm": "millimeter", "Pt": "pint", "Tb": "tablespoon",
}
NO_MEASURE = ("pinch", "pinches", "bar", "bars", "link", "links", "shake", "shakes", "tin", "tins", "unit", "units", "fat")
FULL = {
    "l": "liter", "litre": "liter", "ml": "milliliter", "mL": "milliliter", "millilitre": "milliliter", "cl": "centiliter", "cL": "centiliter", "dl": "deciliter",
    "g": "gram", "kg": "kilogram", "mg": "milligram", "m": "meter", "metre": "meter", "cm": "centimeter", "centimetre": "centimeter", "mm": "millimeter",
    "millimetre": "millimeter",
}
WATER = 1000.0  # kg / m3

# Parts of a unit's name that tell its system.
METRIC_PARTS = ("g", "gram", "kg", "kilogram", "l", "liter", "litre", "ml", "milliliter", "millilitre")
CUSTOMARY_PARTS = (
    "lb", "pound", "oz", "ounce", "fluid_ounce", "st", "stone", "c", "cup", "tsp", "teaspoon", "tbsp", "tablespoon", "pt", "pint", "in", "inch",
)


_SPELLED = re.compile(r"\b(" + "|".join(SPELLINGS) + r")\b")


def resolved(unit: str, system: str = "us_customary") -> str | None:
    """The name of a volume, mass or length unit in a system; None for other units and text."""
    if "-" in unit or unit.lower() in NO_MEASURE:
        return None
    name = _SPELLED.sub(lambda m: SPELLINGS[m[1]], unit)
    name = SHORT.get(name, FULL.get(name, name))
    known = name in VOLUMES or name in MASSES or name in LENGTHS
    return ALTERNATIVES[system].get(name, name) if known else None


def system_of(unit: str) -> str:
    """As unit_system, of one unit."""
    if unit == "":
        return "none"
    name = unit
    for mark in ("imperial_", "metric_", "aus_", "jp_"):
        name = name.replace(mark, "")
    told = next((p.lower() for p in name.split() if p.lower() in METRIC_PARTS + CUSTOMARY_PARTS), None)
    if told is None:
        return "other"
    marked = (("imperial_", "imperial"), ("metric_", "metric"), ("aus_", "australian"), ("jp_", "japanese"))
    return "metric" if told in METRIC_PARTS else next((kind for mark, kind in marked if mark in unit), "us_customary")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _table(system: str) -> tuple[dict[str, float], dict[str, str]]:
    if system not in REGIONAL:
        raise ValueError(f"unknown system {system}")
    volumes = VOLUMES | REGIONAL[system]
    kinds = dict.fromkeys(volumes, "volume") | dict.fromkeys(MASSES, "mass") | dict.fromkeys(LENGTHS, "length")
    factors = volumes | MASSES | LENGTHS
    names = SHORT.items()
    return factors | {a: factors[b] for a, b in names}, kinds | {a: kinds[b] for a, b in names}


def convert(value: Column | str, source: Column | str, target: Column | str, system: str = "us", density: float = WATER) -> Column:
    """The value in another unit; between volume and mass by density. Unknown units, units of different
    kinds and null give null."""
    factors, kinds = _table(system)
    factor, kind = _map(factors), _map(kinds)
    v, a, b = (F.col(c) if isinstance(c, str) else c for c in (value, source, target))
    base = v.cast("double") * factor[a]
    pair = F.concat(kind[a], F.lit(">"), kind[b])
    scaled = F.when(kind[a] == kind[b], base).when(pair == "volume>mass", base * F.lit(density)).when(pair == "mass>volume", base / F.lit(density))
    return scaled / factor[b]


def unit_system(unit: Column | str) -> Column:
    """none, metric, us_customary, imperial, australian, japanese or other, by the first part of the
    name that tells; null stays null."""
    u = F.col(unit) if isinstance(unit, str) else unit
    parts = F.filter(F.split(F.regexp_replace(u, "imperial_|metric_|aus_|jp_", ""), r"(?U)[\s\x1c-\x1f]+"), lambda p: F.lower(p).isin(*METRIC_PARTS, *CUSTOMARY_PARTS))
    first = F.lower(F.get(parts, F.lit(0)))
    customary = F.when(F.contains(u, F.lit("imperial_")), "imperial").when(F.contains(u, F.lit("metric_")), "metric").when(F.contains(u, F.lit("aus_")), "australian")
    customary = customary.when(F.contains(u, F.lit("jp_")), "japanese").otherwise("us_customary")
    return F.when(u.isNull(), None).when(u == "", "none").when(first.isin(*METRIC_PARTS), "metric").when(first.isin(*CUSTOMARY_PARTS), customary).otherwise("other")
