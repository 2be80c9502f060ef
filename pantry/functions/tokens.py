"""Tokens of a normalised sentence and what can be said of each by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

_MARKS = r"()\[\]{},/:;?!*~"
PIECES = rf"(?U)[{_MARKS}]|[^\s{_MARKS}]+"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
_FLOAT = rf"[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|[+-]?(?i:inf|infinity|nan)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(sentence: Column | str) -> Column:
    """White space, then the marks by themselves, and/or as one, and a last full stop by itself
    unless it ends something like `e.g.`; null stays null."""
    pieces = F.regexp_extract_all(_col(sentence), F.lit(PIECES), F.lit(0))
    empty = F.array().cast("array<string>")

    def join(done: Column, token: Column) -> Column:
        n = F.size(done)
        joins = (token == "or") & (n >= 2) & (F.coalesce(F.get(done, n - 1), F.lit("")) == "/") & (F.coalesce(F.get(done, n - 2), F.lit("")) == "and")
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.lit("and/or")))).otherwise(F.concat(done, F.array(token)))

    whole = lambda p: F.when(F.array_contains(p, "or") & F.array_contains(p, "/"), F.aggregate(p, empty, join)).otherwise(p)
    joined = F.get(F.transform(F.array(pieces), whole), F.lit(0))
    split = F.transform(joined, lambda t: F.when(F.endswith(t, F.lit(".")) & (F.length(t) > 1) & ~t.rlike(r"(?U)\.\w\.$"), F.array(t.substr(F.lit(1), F.length(t) - 1), F.lit("."))).otherwise(F.array(t)))
    return F.flatten(split)


def is_numeric(token: Column | str) -> Column:
    """Marked fractions, number words, `dozen`, numbers, numbers with a last x, and any of these, but
    with no sign, joined by hyphens."""
    t = _col(token)
    fraction = r"\p{Nd}*#\p{Nd}+\$\p{Nd}+"
    words = "|".join(C.STRING_NUMBERS)

    def single(p: Column) -> Column:
        return (p != "00") & p.rlike(rf"^(?:(?:{_FLOAT})x?|{fraction}|dozen|(?i:{words}))$")

    whole = t.rlike(rf"^(?:{fraction}(?:-{fraction})?|(?i:{words}))$")
    return F.when(whole, True).when(F.contains(t, F.lit("-")), F.forall(F.split(t, "-"), single)).otherwise(single(t))


def singular(token: Column | str) -> Column:
    """The singular of a unit word, null for any other token."""
    table = F.create_map(*[F.lit(x) for pair in C.units().items() for x in pair])
    return table[_col(token)]


def feature_text(token: Column | str) -> Column:
    t = _col(token)
    return F.coalesce(singular(t), F.when(is_numeric(t), F.lit("!num")), t)


def is_unit(token: Column | str) -> Column:
    values = sorted(set(C.units().values()) - set(C.LENGTH_UNITS))
    return F.lower(_col(token)).isin(values)


def is_dimension(token: Column | str) -> Column:
    return F.lower(_col(token)).isin(*C.DIMENSIONS)


def is_ambiguous_unit(token: Column | str) -> Column:
    forms = C.units()
    words = {w for p in C.AMBIGUOUS_UNIT_STEMS for w in (p, forms[p], p.capitalize(), forms[p].capitalize())} | {"gram", "glass", "Gram", "Glass"}
    return _col(token).isin(sorted(words))


def is_punctuation(token: Column | str) -> Column:
    t = _col(token)
    return (F.position(t, F.lit(ASCII_PUNCTUATION)) > 0) | (t == "--")


def is_capitalised(token: Column | str) -> Column:
    return _col(token).rlike("^[A-Z]")


def follows(tokens: Column | str, mark: str) -> Column:
    """For every token: does `mark` stand before it?"""
    at = F.array_position(_col(tokens), mark)
    return F.transform(_col(tokens), lambda t, i: (at > 0) & (at <= i))


def length_bucket(tokens: Column | str) -> Column:
    """The greatest bucket that the number of tokens reaches."""
    n = F.size(_col(tokens))
    out = F.lit(None).cast("int")
    for bucket in C.SENTENCE_LENGTH_BUCKETS:
        out = F.when(n >= bucket, F.lit(bucket)).otherwise(out)
    return out


def affixes(token: Column | str, n: int) -> tuple[Column, Column]:
    """The first and the last n characters of tokens longer than n; null for numbers and others."""
    t = _col(token)
    fits = (F.length(t) > n) & (t != "!num")
    return F.when(fits, F.substring(t, 1, n)), F.when(fits, F.right(t, F.lit(n)))


def word_shape(token: Column | str) -> Column:
    """Letters to x and X, digits to d. Accents of Latin-1 and Latin Extended-A fold by a table that
    Unicode's decomposition gives."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x180)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.category(x) == "Mn" for x in b[1:])]
    t = F.translate(_col(token), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Mn}", ""), "[a-z]", "x"), "[A-Z]", "X"), "[0-9]", "d")
