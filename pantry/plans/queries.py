"""Queries over the shared tables by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import features as X
from ..functions import quantities as Q
from ..functions import stems as M
from ..functions import tagging as G
from ..functions import tokens as T
from ..functions import units as U
from ..functions.normalise import normalise, once
from ..operators import labelling as L
from ..operators import nearest as N
from ..operators import parsing as Z
from ..operators import retrieval as R
from ..operators import sequences as S
from ..streaming import events as E


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, such as one small file, dealt to all of them; any
    other stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _tokens(c: str = "text"):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def vocabulary(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("text")).select(F.explode(T.tokenize("text")).alias("token"))
    return docs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def token_attributes(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokenize("text").alias("t"))
    return turns.select("conv_id", "turn", F.size("t").cast("long").alias("n"), T.length_bucket("t").alias("bucket"),
                        F.size(F.filter(F.col("t"), T.is_punctuation)).cast("long").alias("marks"), F.size(F.filter(F.col("t"), T.is_capitalised)).cast("long").alias("capitals"))


def bm25(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", _tokens().alias("tokens"))
    items = _table(spark, sf_dir, "benchmark").select("item_id", _tokens().alias("tokens"))
    found = R.bm25_top(docs, items, "doc_id", "item_id", 10)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "score")


def token_weights(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", _tokens().alias("tokens"))
    return R.token_weights(docs, "doc_id", "tokens").select("token", F.round("probability", 9).alias("probability"), F.round("weight", 6).alias("weight"))


def cosine(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("doc"), F.col("embedding").alias("v"))
    q = v.where("doc % 100 = 0").select(F.col("doc").alias("query"), "v")
    return R.ranked(N.nearest(q, v, 10), 10, ascending=True).select("query", "doc", "rank", "score")


def islands(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") > 200).alias("long"))
    return S.islands(turns, ["conv_id"], "turn", "long")


def flags(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") != "user").alias("related"), (F.length("text") > 200).alias("long"))
    return S.spread_flag(turns, ["conv_id"], "turn", "related", "long", "any_long").select("conv_id", "turn", "any_long")


def evaluation(spark, sf_dir):
    """Exact accuracy of a simple prediction on labelled rows: 97 sentences, each of the documents that share a remainder, in order."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 300).cast("int").cast("string").alias("guess"))
    rows = docs.join(_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("truth")), "doc_id")
    by = rows.groupBy((F.col("doc_id") % 97).alias("sentence")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "truth", "guess"))).alias("r"))
    found = L.accuracy(by.select(F.col("r.truth").alias("truth"), F.col("r.guess").alias("guess")), "truth", "guess")
    return found.select(F.round("sentence", 6).alias("sentence"), F.round("token", 6).alias("token"))


def tumbling(spark, sf_dir):
    return E.tumbling(_table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def normalised(spark, sf_dir):
    """A raw sentence per part, in eight shapes by its key: signs, entities, dashes, ranges, units and prices to rewrite."""
    part = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"))
    n, name = F.col("p_size").cast("string"), F.col("p_name")
    more = lambda k: (F.col("p_size") + k).cast("string")
    shapes = (
        (n, "½ cups ", name, " ($", n, ".50*)"), (n, "g &amp; ", n, "oz. ", name), (n, " to ", more(2), " tbsp. ", name), (n, " — ", name, " – chopped"),
        (n, " and 1/4 lb ", name), (n, " g - ", more(1), " g ", name), (n, " x ", n, "-ounce ", name), ("two-cup ", name, ", ", n, " - ", more(3)),
    )
    text = [F.concat(F.lit("  "), *[F.lit(x) if isinstance(x, str) else x for x in shape], F.lit(" ")) for shape in shapes]
    sentence = F.element_at(F.array(*text), (F.col("p_partkey") % 8 + 1).cast("int"))
    return part.select("p_partkey", normalise(sentence).alias("sentence"))


def unit_conversion(spark, sf_dir):
    """Quantities as cups, ounces and tablespoons, in millilitres or by water's density in grams."""
    source = F.element_at(F.array(*[F.lit(u) for u in ("cup", "oz", "tbsp")]), F.col("l_linenumber") % 3 + 1)
    target = F.when(F.col("l_linenumber") % 2 == 0, "ml").otherwise("g")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", source.alias("source"), target.alias("target"))
    return rows.select("l_orderkey", "l_linenumber", F.round(U.convert("l_quantity", "source", "target"), 4).alias("value"))


def numeric_tokens(spark, sf_dir):
    turns = _spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", T.tokenize("text").alias("t"))
    return turns.select("conv_id", "turn", F.size(F.filter(F.col("t"), T.is_numeric)).cast("long").alias("numbers"))


def tags(spark, sf_dir):
    """Tags of all words of the conversations by capitals, rules and overrides; the lexicon is an input
    that is not among the tables."""
    turns = _spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", T.tokenize("text").alias("t"))
    given = once(once(turns, "t", F.col("t")), "p", G.apply_rules("t", F.transform("t", G.default_tag)))
    each = given.select(F.explode(G.override_tags("t", "p")).alias("tag"))
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def feature_counts(spark, sf_dir):
    """How often each kind of feature stands in the conversations' tokens."""
    turns = _spread(_table(spark, sf_dir, "conversations").select("text")).select(T.tokenize("text").alias("t"))
    ruled = once(once(turns, "t", F.col("t")), "p", G.apply_rules("t", F.transform("t", G.default_tag)))
    given = once(ruled, "p", G.override_tags("t", "p"))
    return X.feature_kinds(given, "t", "p")


def stemmed(spark, sf_dir):
    """Both stems of each word of the documents, each word once."""
    words = vocabulary(spark, sf_dir).select("token", F.array("token").alias("one"))
    return words.select("token", M.porter_stems("one")[0].alias("porter"), M.english_stems("one")[0].alias("english"))


def amounts(spark, sf_dir):
    """A labelled sentence per part: its size as the quantity of a unit, its name as the name."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("cup", "oz", "clove", "tbsp")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    words = F.concat(F.array(F.col("p_size").cast("string"), unit), F.split("p_name", " "))
    labels = F.transform(words, lambda _, i: F.when(i == 0, "QTY").when(i == 1, "UNIT").when(i == 2, "B_NAME_TOK").otherwise("I_NAME_TOK"))
    same = lambda x: F.transform(words, lambda _: F.lit(x))
    found = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).select("p_partkey", Z.parse_labelled(words, same(False), same("NN"), labels, same(0.5)).alias("x"))
    part = F.col("x.amounts")[0]["parts"][0]
    return found.select("p_partkey", F.col("x.amounts")[0]["text"].alias("text"), part["value"].alias("value"), part["unit"].alias("unit"), part["unit_system"].alias("system"), F.col("x.names")[0]["text"].alias("name"))


def expressions(spark, sf_dir):
    """Balances read as degrees Fahrenheit, in Celsius, and as pounds a cup, in grams a cubic centimetre."""
    to = lambda a, b: F.round(Q.convert("c_acctbal", F.lit(a), F.lit(b))["value"], 4)
    return _table(spark, sf_dir, "customer").select("c_custkey", to("degF", "degC").alias("celsius"), to("lb per cup", "g/cm^3").alias("density"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
QUERIES = {
    "q_vocabulary": vocabulary, "q_token_attributes": token_attributes, "q_bm25": bm25, "q_token_weights": token_weights, "q_cosine": cosine,
    "q_islands": islands, "q_spread_flags": flags, "q_evaluation": evaluation, "q_tumbling": tumbling,
    "q_unit_conversion": unit_conversion, "q_numeric_tokens": numeric_tokens, "q_tags": tags, "q_feature_counts": feature_counts,
    "q_stems": stemmed, "q_amounts": amounts, "q_unit_expressions": expressions,
    "q_normalise": normalised,
}
_PIECES = r"regexp_extract_all(text, '[()\[\]{},/:;?!*~]|[^\s()\[\]{},/:;?!*~]+')"
_SPLIT = rf"flatten(list_transform({_PIECES}, lambda t: CASE WHEN ends_with(t, '.') AND length(t) > 1 AND NOT regexp_matches(t, '\.[\pL\pN_]\.$') THEN [t[:length(t) - 1], '.'] ELSE [t] END))"
_FLOAT = r"([+-]?(\p{Nd}+(_\p{Nd}+)*\.?(\p{Nd}+(_\p{Nd}+)*)?|\.\p{Nd}+(_\p{Nd}+)*)([eE][+-]?\p{Nd}+(_\p{Nd}+)*)?|[+-]?(?i:inf|infinity|nan))x?"
_WORDS = "(?i:" + "|".join(C.STRING_NUMBERS) + ")"
_MARKED = r"\p{Nd}*#\p{Nd}+\$\p{Nd}+"
_ONE = rf"(%s <> '00' AND regexp_full_match(%s, '{_FLOAT}|{_MARKED}|dozen|{_WORDS}'))"


def _numeric(x: str) -> str:
    return rf"""(regexp_full_match({x}, '{_MARKED}(-{_MARKED})?|{_WORDS}') OR (contains({x}, '-') AND len(list_filter(string_split({x}, '-'), lambda y: NOT {_ONE % ("y", "y")})) = 0)
    OR (NOT contains({x}, '-') AND {_ONE % (x, x)}))"""


ORACLE_SQL = {
    "q_vocabulary": f"SELECT token, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS token FROM documents) GROUP BY token",
    "q_token_attributes": f"""
WITH t AS (SELECT conv_id, turn, {_SPLIT} AS t FROM conversations)
SELECT conv_id, turn, len(t) AS n,
  CASE WHEN len(t) >= 64 THEN 64 WHEN len(t) >= 32 THEN 32 WHEN len(t) >= 20 THEN 20 WHEN len(t) >= 16 THEN 16 WHEN len(t) >= 12 THEN 12
       WHEN len(t) >= 8 THEN 8 WHEN len(t) >= 4 THEN 4 WHEN len(t) >= 2 THEN 2 WHEN len(t) >= 1 THEN 1 END AS bucket,
  len(list_filter(t, lambda x: contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', x) OR x = '--')) AS marks,
  len(list_filter(t, lambda x: regexp_matches(x, '^[A-Z]'))) AS capitals
FROM t""",
    "q_bm25": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), l AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
terms AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM d) GROUP BY ALL),
q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
idf AS (SELECT token, ln((SELECT count(*) FROM l) / count(*)) AS idf FROM terms GROUP BY token),
s AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (SELECT avg(n) FROM l)))), 6) AS score
      FROM q JOIN terms USING (token) JOIN idf USING (token) JOIN l USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 10""",
    "q_token_weights": f"""
WITH d AS (SELECT {_TOKENS} AS t FROM documents), c AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM d) GROUP BY token),
p AS (SELECT token, n / (SELECT sum(n) FROM c) AS p, (SELECT count(*) FROM c) AS v, (SELECT floor(avg(len(t))) FROM d) AS mean FROM c),
a AS (SELECT avg(CASE WHEN p > 1 - pow(1 - 1 / v, mean) THEN 1.0 ELSE 0.0 END) AS alpha, any_value(v) AS v FROM p),
k AS (SELECT CASE WHEN alpha > 0 THEN (1 - alpha) / (alpha * v / 2) END AS a FROM a)
SELECT token, round(p, 9) AS probability, round(coalesce(k.a / (k.a / 2 + p), 2.0), 6) AS weight FROM p, k""",
    "q_cosine": """
WITH s AS (SELECT q.vec_id AS query, v.vec_id AS doc,
    round(1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
      * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, doc) AS rank FROM s)
SELECT query, doc, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 10""",
    "q_islands": """
WITH g AS (SELECT conv_id, turn, length(text) > 200 AS long, turn - row_number() OVER (PARTITION BY conv_id, length(text) > 200 ORDER BY turn) AS i FROM conversations)
SELECT conv_id, long, min(turn) AS first, max(turn) AS last, count(*) AS n FROM g GROUP BY conv_id, long, i""",
    "q_spread_flags": """
WITH g AS (SELECT conv_id, turn, length(text) > 200 AS long,
             sum(CASE WHEN role <> 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM conversations)
SELECT conv_id, turn, max(long) OVER (PARTITION BY conv_id, k) AS any_long FROM g""",
    "q_evaluation": """
WITH r AS (SELECT doc_id % 97 AS s, (n_chars > 300)::INTEGER = quality AS ok FROM documents JOIN labels USING (doc_id)),
g AS (SELECT s, count(*) AS n, count(*) FILTER (ok) AS k FROM r GROUP BY s)
SELECT round(avg(CASE WHEN k = n THEN 1.0 ELSE 0.0 END), 6) AS sentence, round(sum(k) / sum(n), 6) AS token FROM g""",
    "q_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "q_unit_conversion": """
WITH f(k, kind, factor) AS (VALUES (0, 'volume', 0.2365882365::DOUBLE), (1, 'mass', 28.349523125::DOUBLE), (2, 'volume', 0.01478676478125::DOUBLE)),
v AS (SELECT l_orderkey, l_linenumber, kind, l_linenumber % 2 = 0 AS ml, l_quantity * factor AS base FROM lineitem JOIN f ON k = l_linenumber % 3)
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN kind = 'volume' AND ml THEN base / 0.001::DOUBLE WHEN kind = 'mass' AND ml THEN base / 1000 / 0.001::DOUBLE WHEN kind = 'volume' THEN base * 1000 ELSE base END, 4) AS value
FROM v""",
    "q_numeric_tokens": rf"""
WITH t AS (SELECT conv_id, turn, {_SPLIT} AS t FROM conversations)
SELECT conv_id, turn, len(list_filter(t, lambda x: {_numeric('x')})) AS numbers FROM t""",
    "q_tags": rf"""
WITH w AS (SELECT conv_id, turn, unnest({_SPLIT}) AS x, generate_subscripts({_SPLIT}, 1) AS i FROM conversations),
b AS (SELECT x, lag(x) OVER (PARTITION BY conv_id, turn ORDER BY i) AS p FROM w),
a AS (SELECT *, CASE WHEN regexp_matches(x, '^[A-Z]') THEN 'NNP' ELSE 'NN' END AS t,
        regexp_full_match(x, '([+-]?(Infinity|[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)')
          OR (regexp_matches(x, '^[+-]?(Infinity|[0-9]+\.?[0-9]*|\.[0-9]+)') AND regexp_matches(regexp_extract(x, '^[+-]?(Infinity|[0-9]+\.?[0-9]*|\.[0-9]+)'), '[1-9I]')) AS num,
        contains(x, '.') AND regexp_matches(x, '[a-zA-Z]{{2}}') AS url FROM b),
r1 AS (SELECT *, CASE WHEN num THEN 'CD' ELSE t END AS t1 FROM a),
r2 AS (SELECT *, CASE WHEN url AND t1 IN ('NN', 'NNP') THEN 'URL' ELSE t1 END AS t2 FROM r1),
r3 AS (SELECT *, CASE WHEN t2 = 'NN' AND strpos(x, 'ed') = length(x) - 1 AND length(x) >= 2 THEN 'VBN' ELSE t2 END AS t3 FROM r2),
r4 AS (SELECT *, CASE WHEN strpos(x, 'ly') = length(x) - 1 AND length(x) >= 2 THEN 'RB' ELSE t3 END AS t4 FROM r3),
r5 AS (SELECT *, CASE WHEN t4 = 'NN' AND strpos(x, 'al') = length(x) - 1 AND length(x) >= 2 THEN 'JJ' ELSE t4 END AS t5 FROM r4),
r6 AS (SELECT *, CASE WHEN t5 = 'NN' AND lower(p) = 'would' THEN 'VB' ELSE t5 END AS t6 FROM r5),
r7 AS (SELECT *, CASE WHEN t6 = 'NN' AND strpos(x, 's') = length(x) THEN 'NNS' ELSE t6 END AS t7 FROM r6),
r8 AS (SELECT *, CASE WHEN t7 = 'NN' AND strpos(x, 'ing') = length(x) - 2 AND length(x) >= 3 THEN 'VBG' ELSE t7 END AS t8 FROM r7),
o AS (SELECT CASE WHEN {_numeric('x')} THEN 'CD' WHEN lower(x) IN ('c', 'g') THEN 'NN' WHEN lower(x) IN ('and/or', 'or', 'and') THEN 'CC' WHEN lower(x) = 'e.g.' THEN 'IN'
        WHEN lower(x) = '/' THEN 'SYM' WHEN x = 'in' AND coalesce({_numeric('p')}, false) THEN 'NN' ELSE t8 END AS tag FROM r8)
SELECT tag, count(*) AS n FROM o GROUP BY tag""",
    "q_amounts": """
WITH u(k, one, many, unit, system) AS (VALUES (0, 'cup', 'cups', 'cup', 'us_customary'), (1, 'oz', 'oz', 'ounce', 'us_customary'),
  (2, 'clove', 'cloves', NULL, 'other'), (3, 'tbsp', 'tbsps', 'tablespoon', 'us_customary'))
SELECT p_partkey, p_size || ' ' || CASE WHEN p_size = 1 THEN one ELSE many END AS text, CAST(p_size AS DOUBLE) AS value,
  coalesce(unit, CASE WHEN p_size = 1 THEN one ELSE many END) AS unit, system, p_name AS name
FROM part JOIN u ON k = p_partkey % 4""",
    "q_normalise": """
SELECT p_partkey, CASE p_partkey % 8
  WHEN 0 THEN p_size || '#1$2 cups ' || p_name
  WHEN 1 THEN p_size || ' g & ' || p_size || ' oz ' || p_name
  WHEN 2 THEN p_size || '-' || (p_size + 2) || ' tbsp ' || p_name
  WHEN 3 THEN p_size || '  -  ' || p_name || ' - chopped'
  WHEN 4 THEN p_size || '#1$4 lb ' || p_name
  WHEN 5 THEN p_size || '-' || (p_size + 1) || ' g ' || p_name
  WHEN 6 THEN p_size || 'x ' || p_size || ' ounce ' || p_name
  ELSE 'two cup ' || p_name || ', ' || p_size || '-' || (p_size + 3) END AS sentence
FROM part""",
    "q_unit_expressions": """
SELECT c_custkey, round((c_acctbal - 32) * 5 / 9, 4) AS celsius, round(c_acctbal * (453.59237::DOUBLE / 236.5882365::DOUBLE), 4) AS density FROM customer""",
}
