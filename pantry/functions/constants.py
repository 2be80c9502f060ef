"""Word lists and tables whose content decides results."""

# Plural and singular units, lower-case forms; see units() for the capitalised ones.
UNIT_FORMS = {
    "balls": "ball", "bags": "bag", "bars": "bar", "baskets": "basket", "batches": "batch", "blocks": "block", "bottles": "bottle", "boxes": "box",
    "branches": "branch", "buckets": "bucket", "bulbs": "bulb", "bunches": "bunch", "bundles": "bundle", "c": "c", "cans": "can", "canisters": "canister",
    "chunks": "chunk", "cloves": "clove", "clusters": "cluster", "counts": "count", "cl": "cl", "cL": "cL", "cubes": "cube", "cups": "cup",
    "cutlets": "cutlet", "dashes": "dash", "dessertspoons": "dessertspoon", "dollops": "dollop", "drops": "drop", "ears": "ear", "envelopes": "envelope",
    "feet": "foot", "fl": "fl", "floz": "floz", "g": "g", "gm": "gm", "gal": "gal", "gallons": "gallon", "glasses": "glass", "grams": "gram",
    "grinds": "grind", "handfuls": "handful", "heads": "head", "jars": "jar", "jiggers": "jigger", "kg": "kg", "kilograms": "kilogram", "knobs": "knob",
    "ladles": "ladle", "lbs": "lb", "leaves": "leaf", "lengths": "length", "links": "link", "l": "l", "liters": "liter", "litres": "litre",
    "loaves": "loaf", "milliliters": "milliliter", "millilitres": "millilitre", "ml": "ml", "mL": "mL", "mugs": "mug", "ounces": "ounce", "oz": "oz",
    "packs": "pack", "packages": "package", "packets": "packet", "pairs": "pair", "pieces": "piece", "pinches": "pinch", "pints": "pint", "pods": "pod",
    "pots": "pot", "pounds": "pound", "pts": "pt", "punnets": "punnet", "racks": "rack", "rashers": "rasher", "recipes": "recipe",
    "rectangles": "rectangle", "ribs": "rib", "quarts": "quart", "qt": "qt", "sachets": "sachet", "scoops": "scoop", "sections": "section",
    "segments": "segment", "shakes": "shake", "sheets": "sheet", "shots": "shot", "shoots": "shoot", "slabs": "slab", "slices": "slice",
    "sprigs": "sprig", "squares": "square", "stalks": "stalk", "stems": "stem", "sticks": "stick", "strips": "strip", "tablespoons": "tablespoon",
    "tbsps": "tbsp", "tbs": "tb", "teaspoons": "teaspoon", "tins": "tin", "tsps": "tsp", "tubs": "tub", "tubes": "tube", "twists": "twist",
    "units": "unit", "wedges": "wedge", "vials": "vial", "wheels": "wheel",
}

LENGTH_UNITS = ("centimeter", "centimetre", "cm", "in", "inch", "inches", "millimeter", "millimetre", "mm")
DIMENSIONS = ("diameter", "inch-long", "inch-thick", "length", "long", "thick", "thickness", "wide", "width")
SIZES = (
    "big", "bite-size", "bite-sized", "extra-large", "jumbo", "large", "lg", "little", "md", "medium", "medium-large", "medium-size",
    "medium-sized", "medium-small", "medium-to-large", "miniature", "regular", "slim", "sm", "small", "small-to-medium", "smaller",
    "smallest", "thick", "thin", "tiny",
)
AMBIGUOUS_UNIT_STEMS = ("cloves", "leaves", "slabs", "wedges", "ribs")
STRING_NUMBERS = {
    "one-quarter": "1/4", "one-half": "1/2", "three-quarter": "3/4", "three-quarters": "3/4", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13",
    "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
}
VULGAR_FRACTIONS = {
    "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅙": "1/6", "⅚": "5/6", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5",
    "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "½": "1/2",
}
CURRENCIES = ("$", "£", "€", "¥", "₹")
PERIOD_UNITS = ("tsp", "tsps", "tbsp", "tbsps", "tbs", "tb", "lb", "lbs", "oz")
UNIT_SYNONYMS = (
    ("c", "cup"), ("g", "gm", "gram"), ("kg", "kilogram"), ("l", "liter", "litre"), ("ounce", "oz"), ("lb", "pound"), ("qt", "quart"),
    ("tablespoon", "tb", "tbs", "tbsp"), ("teaspoon", "tsp"),
)
STOP_WORDS = frozenset("""
a about above after again against all am an and any are aren't as at be because been before being below between but by can couldn't did didn't do
does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he her here hers herself him himself his
how i if in into is isn't it it's its itself just me mightn't more most mustn't my myself needn't no nor not now of off on once only or other our
ours ourselves out over own same shan't she she's should should've shouldn't so some such than that that'll the their theirs them themselves then
there these they this those through to too under until up very was wasn't we were weren't what when where which while who whom why will with won't
wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split())
SENTENCE_LENGTH_BUCKETS = (1, 2, 4, 8, 12, 16, 20, 32, 64)


def units() -> dict[str, str]:
    """Plural to singular with the forms that start with a capital; a form that is capital within
    (cL, mL) gives the same capitalised form as its lower-case twin."""
    return UNIT_FORMS | {k.capitalize(): v.capitalize() for k, v in UNIT_FORMS.items()}


def all_unit_words() -> list[str]:
    return sorted({*units().keys(), *units().values()})
