"""From an ingredient's sentence to a row: amounts, names, size, preparation, comment, purpose.

`tag_sentences` stops at the labels; `parse_labelled` is the rest, one pass over Arrow batches; `parse`
is both.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import constants as C
from ..functions import features, normalise, phrases, stems, tagging, tokens
from ..functions import units as U
from . import labelling

_PHRASE = "struct<text:string,confidence:double,first:int>"
_PART = (
    "struct<quantity:string,quantity_max:string,value:double,unit:string,text:string,confidence:double,first:int,approximate:boolean,singular:boolean,"
    "range:boolean,multiplier:boolean,prepared:boolean,unit_system:string>"
)
_AMOUNT = f"struct<text:string,confidence:double,first:int,unit_system:string,joined_by:string,subtractive:boolean,parts:array<{_PART}>>"
PARSED = f"struct<names:array<{_PHRASE}>,size:{_PHRASE},amounts:array<{_AMOUNT}>,preparation:{_PHRASE},comment:{_PHRASE},purpose:{_PHRASE}>"


@dataclass(frozen=True)
class ParseOptions:
    """`separate_names`: alternatives apart, else one name. `discard_isolated_stop_words`: a run of tokens
    that is a stop word is no text. `string_units`: units stay as text. `expect_name_in_output`: a
    sentence without a name gets the likeliest one. `custom_units`: plural to singular. `corrected`: units
    said twice count once, low-scored names of headings such as `For the sauce` are purposes, and names
    have only those units in the plural that had it."""

    separate_names: bool = True
    discard_isolated_stop_words: bool = True
    expect_name_in_output: bool = True
    string_units: bool = False
    volumetric_units_system: str = "us_customary"
    custom_units: Mapping[str, str] = field(default_factory=dict)
    corrected: bool = False

    def __post_init__(self):
        if self.volumetric_units_system not in U.ALTERNATIVES:
            raise ValueError(f"unknown system {self.volumetric_units_system}; there are {', '.join(U.ALTERNATIVES)}")

    def units(self) -> A.Units:
        capital = {k.capitalize(): v.capitalize() for k, v in self.custom_units.items()}
        return A.Units(self.string_units, self.volumetric_units_system, dict(self.custom_units) | capital)


def parsed(sentence: list[A.Token], options: ParseOptions, units: A.Units) -> dict:
    """One labelled sentence. Tokens that a field has used are not used by a later one."""
    row = A.in_digits(sentence)
    used: set[int] = set()
    amounts = A.amounts(row, used, units, options.corrected)
    words, scores = [t.word for t in row], [t.score for t in row]
    kinds = [t.label if options.separate_names or "NAME" not in t.label else "NAME" for t in row]
    stop_words = C.STOP_WORDS if options.discard_isolated_stop_words else frozenset()

    def text(idx: list[int], of_name: bool) -> tuple[str, float, int] | None:
        each = lambda i: units.plural(words[i]) if row[i].plural else phrases.shown(words[i])
        by_word = of_name and options.corrected
        found = phrases.rendered(idx, words, scores, " " if of_name else ", ", kinds, stop_words, used, each if by_word else None)
        return (found[0] if by_word else units.plural(found[0]), *found[1:]) if found else None

    def of_label(label: str) -> tuple[str, float, int] | None:
        idx = [i for i, k in enumerate(kinds) if k in (label, "PUNC") and i not in used]
        return text(idx, label == "NAME") if any(kinds[i] == label for i in idx) else None

    if options.separate_names:
        at = [i for i, k in enumerate(kinds) if ("NAME" in k or k == "PUNC") and i not in used]
        groups = [[at[i] for i in g] for g in phrases.names([kinds[i] for i in at])] if any(kinds[i] != "PUNC" for i in at) else []
        groups = phrases.by_last_tag(groups, kinds, [t.tag for t in row])
        names = phrases.without_repeats([found for g in groups if (found := text(g, True))])
    else:
        names = [found for found in [of_label("NAME")] if found]
    size, preparation, comment, purpose = (of_label(x) for x in ("SIZE", "PREP", "COMMENT", "PURPOSE"))
    heading = bool(row) and row[0].word.lower() in ("for", "to") and all("NAME" in k for k in kinds)
    if options.corrected and heading and not amounts and len(names) == 1 and purpose is None and names[0][1] < 0.6:
        purpose, names = names[0], []
    if names and preparation:
        firsts, prepared = [n[2] for n in names], preparation[2]
        for amount in amounts:
            if amount["first"] < prepared < min(firsts) or max(firsts) < prepared < amount["first"]:
                for part in amount["parts"]:
                    part["prepared"] = True
    shown = lambda p: dict(zip(("text", "confidence", "first"), p)) if p else None
    return {"names": [shown(n) for n in names], "size": shown(size), "amounts": amounts, "preparation": shown(preparation), "comment": shown(comment), "purpose": shown(purpose)}


def parse_labelled(words: Column, plural: Column, tags: Column, labels: Column, scores: Column, options: ParseOptions = ParseOptions()) -> Column:
    """The row of a sentence whose tokens (units in the singular), plural marks, tags, labels and scores
    are given as arrays. Null in any of them, or arrays of unequal length, give null."""
    units = options.units()

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, many, t, kind, score in zip(*batch):
                if any(x is None for x in (w, many, t, kind, score)) or len({len(x) for x in (w, many, t, kind, score)}) > 1:
                    out.append(dict.fromkeys(("names", "size", "amounts", "preparation", "comment", "purpose")))
                    continue
                sentence = [A.Token(a, b, float(s), i, bool(p), g) for i, (a, p, g, b, s) in enumerate(zip(w, many, t, kind, score))]
                out.append(parsed(sentence, options, units))
            yield pd.DataFrame(out, columns=["names", "size", "amounts", "preparation", "comment", "purpose"], dtype=object)

    found = run(words, plural, tags, labels, scores)
    return F.when(found["names"].isNotNull(), found)


def tag_sentences(df: DataFrame, keys: list[str], sentence: str, lexicon: DataFrame, model: labelling.Model, options: ParseOptions = ParseOptions()) -> DataFrame:
    """df with `tokens`, `tags` and `labelled`, array<struct<label, score>>. `keys` name a row."""
    once = normalise.once
    cut = once(once(df, "_text", normalise.normalise(F.col(sentence))), "tokens", tokens.tokenize("_text")).drop("_text")
    tagged = tagging.tag(cut, keys, "tokens", lexicon)
    seen = once(tagged, "_stems", stems.porter_stems(F.transform("tokens", tokens.feature_text)))
    seen = once(seen, "_features", features.sentence_features("tokens", "tags", "_stems")).drop("_stems")
    guess = 0.2 if options.expect_name_in_output else None
    return labelling.label(seen, keys, "_features", model, guess=guess).drop("_features")


def parse(df: DataFrame, keys: list[str], sentence: str, lexicon: DataFrame, model: labelling.Model, options: ParseOptions = ParseOptions()) -> DataFrame:
    """df with what `tag_sentences` adds and `parsed`; a null sentence, or one without tokens, gives null."""
    found = normalise.once(tag_sentences(df, keys, sentence, lexicon, model, options), "labelled", F.col("labelled"))
    singular = lambda t: F.coalesce(tokens.singular(t), t)
    one = F.transform("tokens", singular)
    many = F.transform("tokens", lambda t: tokens.singular(t).isNotNull() & (singular(t) != t))
    return found.withColumn("parsed", parse_labelled(one, many, F.col("tags"), F.col("labelled.label"), F.col("labelled.score"), options))
