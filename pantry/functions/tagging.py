"""Part-of-speech tags: lexicon, transformation rules, overrides."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .normalise import once

# Fixed values: (from, to, predicate, parameter), applied in this order at each position.
RULES = (
    ("VBD", "NN", "PREV-TAG", "DT"),
    ("VBP", "NN", "PREV-TAG", "DT"),
    ("VB", "NN", "PREV-TAG", "DT"),
    ("NN", "CD", "CURRENT-WORD-IS-NUMBER", "YES"),
    ("NNP", "CD", "CURRENT-WORD-IS-NUMBER", "YES"),
    ("NNS", "CD", "CURRENT-WORD-IS-NUMBER", "YES"),
    ("NNPS", "CD", "CURRENT-WORD-IS-NUMBER", "YES"),
    ("NN", "URL", "CURRENT-WORD-IS-URL", "YES"),
    ("NNS", "URL", "CURRENT-WORD-IS-URL", "YES"),
    ("NNP", "URL", "CURRENT-WORD-IS-URL", "YES"),
    ("NNPS", "URL", "CURRENT-WORD-IS-URL", "YES"),
    ("NN", "VBN", "CURRENT-WORD-ENDS-WITH", "ed"),
    ("*", "RB", "CURRENT-WORD-ENDS-WITH", "ly"),
    ("NN", "JJ", "CURRENT-WORD-ENDS-WITH", "al"),
    ("NNS", "JJ", "CURRENT-WORD-ENDS-WITH", "al"),
    ("NN", "VB", "PREV-WORD-IS", "would"),
    ("NN", "NNS", "CURRENT-WORD-ENDS-WITH", "s"),
    ("NN", "VBG", "CURRENT-WORD-ENDS-WITH", "ing"),
)

#: A bound on what is broadcast; a word takes some hundred bytes.
BROADCAST_WORDS = 1_000_000
_WHOLE = re.compile(r"\s*([+-]?(Infinity|\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)?\s*", re.ASCII)
_START = re.compile(r"\s*[+-]?(Infinity|\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", re.ASCII)


def _number(word: str) -> bool:
    """The whole word reads as a number, or it starts with one that is not zero."""
    if _WHOLE.fullmatch(word):
        return True
    start = _START.match(word)
    return bool(start) and float(start[0].replace("Infinity", "inf")) != 0


def _fits(predicate: str, wanted: str, words: Sequence[str], tags: Sequence[str], i: int) -> bool:
    word = words[i]
    match predicate:
        case "PREV-TAG":
            return i > 0 and tags[i - 1] == wanted
        case "NEXT-TAG" | "NEXT-WORD-IS-TAG":
            return i + 1 < len(tags) and tags[i + 1] == wanted
        case "PREV-WORD-IS":
            return i > 0 and words[i - 1].lower() == wanted.lower()
        case "CURRENT-WORD-IS-NUMBER":
            return _number(word) == (wanted == "YES")
        case "CURRENT-WORD-IS-URL":
            return ("." in word and re.search("[a-zA-Z]{2}", word) is not None) == (wanted == "YES")
        case "CURRENT-WORD-ENDS-WITH":  # where the ending stands nowhere before
            return 0 < len(wanted) <= len(word) and word.find(wanted) == len(word) - len(wanted)
    raise ValueError(f"unknown predicate {predicate}")


def _known(rules: Sequence[tuple]) -> list[tuple[str, str, str, str]]:
    out = list(dict.fromkeys((a, b, p, w or "") for a, b, p, w in rules))  # a repeated rule counts once
    for _, _, predicate, wanted in out:
        _fits(predicate, wanted, ["x"], ["NN"], 0)
    return out


def default_tag(token: Column | str) -> Column:
    c = F.col(token) if isinstance(token, str) else token
    return F.when(c.rlike("^[A-Z]"), F.lit("NNP")).otherwise(F.lit("NN"))


def lexicon_tags(df: DataFrame, keys: list[str], tokens: str, lexicon: DataFrame, out: str = "tags") -> DataFrame:
    """df with `out`, a tag per token: the tag of the word as written, else of the word in lower case,
    else by its capital. `keys` name a row; lexicon(word, tag), of a word's tags the least counts. A lexicon of up
    to BROADCAST_WORDS words is broadcast and looked up without a shuffle, a larger one is joined. Null tokens give null, no tokens none."""
    words = lexicon.where("word IS NOT NULL").groupBy("word").agg(F.min("tag").alias("tag"))
    known = words.limit(BROADCAST_WORDS + 1).collect()
    if len(known) <= BROADCAST_WORDS:
        shared = df.sparkSession.sparkContext.broadcast({r.word: r.tag for r in known if r.tag is not None})

        @F.pandas_udf("array<string>")
        def look(sentences: pd.Series) -> pd.Series:
            get = shared.value.get
            one = lambda t: None if t is None else get(t) or get(t.lower()) or ("NNP" if "A" <= t[:1] <= "Z" else "NN")
            return sentences.map(lambda s: None if s is None else [one(t) for t in s])

        return df.withColumn(out, look(tokens))
    each = df.select(*keys, F.posexplode(tokens).alias("_at", "_token"))
    each = each.join(words.select(F.col("word").alias("_token"), F.col("tag").alias("_exact")), "_token", "left")
    each = each.withColumn("_lower", F.lower("_token")).join(words.select(F.col("word").alias("_lower"), F.col("tag").alias("_folded")), "_lower", "left")
    tag = F.coalesce("_exact", "_folded", default_tag("_token"))
    row = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", tag.alias("_tag")))).alias("_tags"))
    found = df.join(row.select(*keys, F.col("_tags._tag").alias(out)), keys, "left")
    return found.withColumn(out, F.when(F.col(tokens).isNotNull(), F.coalesce(out, F.array().cast("array<string>"))))


def apply_rules(tokens: Column | str, tags: Column | str, rules: Sequence[tuple] = RULES) -> Column:
    """Left to right, all rules at each position: tags before it are final, tags after it are as given."""
    known = _known(rules)

    @F.pandas_udf("array<string>")
    def run(words: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for w, t in zip(words, given):
            if w is None or t is None:
                out.append(None)
                continue
            t = list(t)
            for i in range(len(w)):
                for a, b, predicate, wanted in known:
                    if (a == t[i] or a == "*") and _fits(predicate, wanted, w, t, i):
                        t[i] = b
            out.append(t)
        return pd.Series(out, dtype=object)

    return run(tokens, tags)


def override_tags(tokens: Column | str, tags: Column | str) -> Column:
    """What a sentence's numbers, short units, conjunctions and signs are tagged whatever the rules say."""
    words = F.col(tokens) if isinstance(tokens, str) else tokens
    given = F.col(tags) if isinstance(tags, str) else tags

    def one(tag: Column, i: Column) -> Column:
        w = F.get(words, i)
        low = F.lower(w)
        before = F.when(i > 0, F.get(words, i - 1))
        return (
            F.when(T.is_numeric(w), "CD").when(low.isin("c", "g"), "NN").when(low.isin("and/or", "or", "and"), "CC").when(low == "e.g.", "IN")
            .when(low == "/", "SYM").when((w == "in") & F.coalesce(T.feature_text(before) == "!num", F.lit(False)), "NN").otherwise(tag)
        )

    return F.transform(given, one)


def tag(df: DataFrame, keys: list[str], tokens: str, lexicon: DataFrame, rules: Sequence[tuple] = RULES, out: str = "tags") -> DataFrame:
    """df with `out`: lexicon, rules, overrides."""
    found = lexicon_tags(df, keys, tokens, lexicon, out)
    return once(once(found, out, apply_rules(tokens, out, rules)), out, override_tags(tokens, out))
