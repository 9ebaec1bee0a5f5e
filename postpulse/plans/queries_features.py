"""Cleaning, time-part, sentiment and feature keys.

drop_columns, dropna_rows, fill_blank_zero, model_table, date_parts,
sentiment_score, sentiment_class, feature_table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postpulse.catalog import register
from postpulse.functions import cleaning
from postpulse.functions import sentiment as sent
from postpulse.functions.sentiment import DEFAULT_LEXICON, VALENCE_SCALE, score_texts
from postpulse.operators import features
from postpulse.plans import models
from postpulse.session import scratch_path, spread, stored
from postpulse.sources import csvio
from postpulse.sources import fixtures as fx
from postpulse.sources.tables import table


@register("drop_columns", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def q_drop_columns(spark, base):
    return cleaning.drop_strict(table(spark, base, "orders"), ["o_custkey", "o_orderdate"])


BLANKS_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice,
       nullif(o_orderpriority, '5-LOW') AS o_orderpriority
FROM orders"""


@register("dropna_rows", f"""
SELECT * FROM ({BLANKS_SQL}) b
WHERE o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL
  AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def q_dropna_rows(spark, base):
    return cleaning.drop_null_rows(fx.blank_orders(spark, base))


@register("fill_blank_zero", f"""
SELECT coalesce(o_orderkey, 0) AS o_orderkey,
       coalesce(nullif(o_orderstatus, ''), '0') AS o_orderstatus,
       coalesce(o_totalprice, 0) AS o_totalprice,
       coalesce(nullif(o_orderpriority, ''), '0') AS o_orderpriority
FROM ({BLANKS_SQL}) b""")
def q_fill_blank_zero(spark, base):
    return cleaning.fill_blank_zero(fx.blank_orders(spark, base))


TIME_SQL = """CAST(hour({t}) AS INTEGER) AS hour, CAST(isodow({t}) AS INTEGER) AS dayofweek,
       CAST(day({t}) AS INTEGER) AS day, CAST(month({t}) AS INTEGER) AS month,
       CAST(year({t}) AS INTEGER) AS year"""

MODEL_NAMES = ["subreddit", "score", "HoD", "DoW", "DoM", "month", "year"]


@register("model_table", """
SELECT event_type AS subreddit, CAST(trunc(value) AS INTEGER) AS score,
       CAST(hour(ts) AS VARCHAR) AS HoD, CAST(isodow(ts) AS VARCHAR) AS DoW,
       CAST(day(ts) AS VARCHAR) AS DoM, CAST(month(ts) AS VARCHAR) AS month,
       CAST(year(ts) AS VARCHAR) AS year
FROM events""")
def q_model_table(spark, base):
    """Feature rows written as headerless CSV, read back by position, dropped, renamed, cast."""
    layout = fx.model_rows(spark, base).select(
        "event_id", "subreddit", "user_id", F.col("score").cast("string").alias("score"),
        "HoD", "DoW", "DoM", "month", "year")
    path = scratch_path(spark, "model-table")
    csvio.write_delimited(layout, path, header=False)
    raw = csvio.read_delimited(spark, path, csvio.positional_schema(9), header=False)
    return features.model_table(raw, ["_c0", "_c2"], MODEL_NAMES)


@register("date_parts", f"""
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc, {TIME_SQL.format(t='ts')}
FROM events""")
def q_date_parts(spark, base):
    rows = fx.timed_rows(spark, base).select("event_id", "created_utc")
    return features.with_time_parts(rows)


def _lexicon_case(token: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {int(round(v * VALENCE_SCALE))}" for k, v in DEFAULT_LEXICON.items())
    return f"CASE {token} {whens} ELSE 0 END"


SCORE_SQL = f"""
scored AS (
  SELECT doc_id, text,
         coalesce(list_sum(list_transform(regexp_split_to_array(lower(text), '[^a-z]+'),
                                          lambda t: {_lexicon_case('t')})), 0) / {float(VALENCE_SCALE)} AS s
  FROM documents),
comp AS (
  SELECT doc_id, text,
         CASE WHEN text IS NULL THEN NULL ELSE round(s / sqrt(s * s + 15.0), 4) END AS compound
  FROM scored),
cls AS (
  SELECT doc_id, compound,
         CASE WHEN text IS NULL OR text = '' THEN 10
              WHEN compound > 0.6 THEN 1 WHEN compound > 0.25 THEN 2
              WHEN compound > -0.25 THEN 3 WHEN compound > -0.6 THEN 4 ELSE 5 END AS sentiment_class
  FROM comp)
"""


@register("sentiment_score", f"WITH {SCORE_SQL} SELECT doc_id, compound FROM comp")
def q_sentiment_score(spark, base):
    d = table(spark, base, "documents").select("doc_id", "text")
    return score_texts(d, "doc_id", "text").select("doc_id", "compound")


@register("sentiment_class", f"WITH {SCORE_SQL} SELECT doc_id, compound, sentiment_class FROM cls")
def q_sentiment_class(spark, base):
    d = table(spark, base, "documents").select("doc_id", "text")
    return score_texts(d, "doc_id", "text").select("doc_id", "compound", "sentiment_class")


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _rules_ctes() -> str:
    """The rule scorer over ``documents``: matches as rows, their context by list lookups."""
    r = fx.RULES
    caps = "(upper({0}) = {0} AND lower({0}) <> {0})"
    units = lambda v: int(round(v * VALENCE_SCALE))
    lex = " ".join(f"WHEN '{w}' THEN {units(v)}" for w, v in DEFAULT_LEXICON.items())
    gram = {1: "l[i]", 2: "CASE WHEN i > 1 THEN l[i - 1] || ' ' || l[i] END",
            3: "CASE WHEN i > 2 THEN l[i - 2] || ' ' || l[i - 1] || ' ' || l[i] END"}
    sized = {n: r.of_length(n) for n in (3, 2, 1) if r.of_length(n)}
    k = " ".join(f"WHEN {gram[n]} IN ({_quoted(p)}) THEN {n}" for n, p in sized.items())
    value = " ".join(f"WHEN {gram[n]} = {_quoted([w])} THEN {units(v)}"
                     for n, p in sized.items() for w, v in p.items())
    boost = " ".join(f"WHEN '{w}' THEN {b}" for w, b in r.boosters.items())
    steps = ["""
v0 AS (SELECT *, v / {scale}::DOUBLE + sign(v) * CASE WHEN mixed AND {loud} THEN {inc}::DOUBLE ELSE 0.0::DOUBLE END AS x
       FROM u)""".format(scale=VALENCE_SCALE, loud=caps.format("w[i]"), inc=sent.CAPITALS_INCREMENT)]
    for d, damp in enumerate(sent.BOOSTER_REACH, 1):
        word = f"CASE WHEN first > {d} THEN l[first - {d}] END"
        least = ("" if d > 1 else " OR (coalesce({0} = 'least', false) AND NOT coalesce("
                 "(CASE WHEN first > 2 THEN l[first - 2] END) IN ('at', 'very'), false))".format(word))
        steps.append(f"""
b{d} AS (SELECT * REPLACE (x + sign(x) * coalesce(CASE {word} {boost} END, 0) * {sent.BOOSTER * damp!r}::DOUBLE AS x) FROM v{d - 1}),
v{d} AS (SELECT * REPLACE (x * CASE WHEN coalesce({word} IN ({_quoted(r.negations)}), false){least}
                           THEN {sent.NEGATION_FACTOR}::DOUBLE ELSE 1.0::DOUBLE END AS x) FROM b{d})""")
    pattern = r.pattern().replace("'", "''")
    return f"""
w AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS w FROM documents),
l AS (SELECT *, [lower(x) FOR x IN w] AS l, len([x FOR x IN w IF {caps.format('x')}]) AS n_caps FROM w),
p AS (SELECT doc_id, w, l, n_caps > 0 AND n_caps < len(w) AS mixed,
             coalesce(list_min([i FOR i IN range(1, len(l) + 1) IF l[i] IN ({_quoted(r.contrasts)})]), 0) AS but,
             unnest(range(1, len(l) + 1)) AS i FROM l),
g AS (SELECT *, CASE {k} ELSE 0 END AS k, coalesce(CASE {value} END, CASE l[i] {lex} END) AS v FROM p),
h AS (SELECT *, lead(k, 1, 0) OVER o AS k1, lead(k, 2, 0) OVER o AS k2
      FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT *, i - greatest(k, 1) + 1 AS first FROM h WHERE v IS NOT NULL),{",".join(steps)},
t AS (SELECT doc_id, sum(CAST(floor(x * {VALENCE_SCALE} + 0.5) AS BIGINT)
        * CASE WHEN k1 >= 2 OR k2 >= 3 THEN 0 WHEN but = 0 THEN 2 WHEN first < but THEN 1 ELSE 3 END) AS n
      FROM v3 GROUP BY doc_id),
q AS (SELECT d.doc_id, d.text, coalesce(t.n, 0) / {2.0 * VALENCE_SCALE}::DOUBLE AS s,
             least(length(d.text) - length(replace(d.text, '!', '')), {sent.MAX_EXCLAMATIONS}) AS marks,
             length(d.text) - length(replace(d.text, '?', '')) AS asked
      FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id),
c AS (SELECT doc_id, text, s + sign(s) * (marks * {sent.EXCLAMATION_INCREMENT}::DOUBLE
        + CASE WHEN asked > {sent.MAX_QUESTIONS} THEN {sent.MANY_QUESTIONS}::DOUBLE
               WHEN asked > 1 THEN asked * {sent.QUESTION_INCREMENT}::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM q),
rule_comp AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL
                ELSE round(s / sqrt(s * s + {float(sent.ALPHA)}::DOUBLE), 4) END AS compound FROM c),
cls AS (SELECT doc_id, compound,
       CASE WHEN text IS NULL OR text = '' THEN 10
            WHEN compound > 0.6 THEN 1 WHEN compound > 0.25 THEN 2
            WHEN compound > -0.25 THEN 3 WHEN compound > -0.6 THEN 4 ELSE 5 END AS sentiment_class
FROM rule_comp)"""


RULES_CTES = _rules_ctes()


@register("feature_table", f"""
WITH {RULES_CTES}
SELECT c.doc_id AS id, d.source AS subreddit, c.sentiment_class,
       {TIME_SQL.format(t='epoch_ms((1601510400 + d.doc_id * 3607) * 1000)')}
FROM cls c JOIN documents d ON c.doc_id = d.doc_id""")
def q_feature_table(spark, base):
    return features.feature_table(fx.comments(spark, base), rules=fx.RULES)


@register("sentiment_rules", f"WITH {RULES_CTES} SELECT doc_id, compound, sentiment_class FROM cls")
def q_sentiment_rules(spark, base):
    """Word sum with phrases, negation, intensifiers, capitals, contrast and marks; the lexicon is
    a table."""
    lexicon = spark.createDataFrame(list(DEFAULT_LEXICON.items()), "token string, valence double")
    d = table(spark, base, "documents").select("doc_id", "text")
    return sent.rule_scores(d, "text", lexicon, fx.RULES).drop("text")


@register("sentiment_rules_narrow", f"WITH {RULES_CTES} SELECT doc_id, compound, sentiment_class FROM cls")
def q_sentiment_rules_narrow(spark, base):
    """The same from a dict: one projection, no shuffle and no id."""
    d = table(spark, base, "documents").select("doc_id", "text")
    return sent.rule_scores(d, "text", DEFAULT_LEXICON, fx.RULES).drop("text")


RAW_SQL = """
raw AS (
  SELECT doc_id, text, n_chars,
         CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 1601510400 + doc_id * 3607 END AS epoch,
         CASE WHEN doc_id % 40 = 0 THEN '0' ELSE source END AS subreddit
  FROM documents WHERE doc_id % 17 <> 3 AND doc_id % 19 <> 5)"""


def _feature_job_sql(cast: str) -> str:
    t = "epoch_ms(epoch * 1000)"
    return f"""
WITH {RULES_CTES}, {RAW_SQL}
SELECT raw.subreddit, CAST(raw.doc_id % 2 AS VARCHAR) AS gilded,
       CASE WHEN raw.doc_id % 4 = 0 THEN 'True' ELSE 'False' END AS archived,
       CAST(cls.sentiment_class AS {cast}) AS sentiment,
       CAST(raw.doc_id % 3 AS VARCHAR) AS controversiality,
       CAST(raw.n_chars % 100 AS VARCHAR) AS score,
       CAST(hour({t}) AS INTEGER) AS "HoD", CAST(isodow({t}) AS INTEGER) AS "DoW",
       CAST(day({t}) AS INTEGER) AS "DoM", CAST(month({t}) AS INTEGER) AS month,
       CAST(year({t}) AS INTEGER) AS year, CAST(raw.doc_id AS VARCHAR) AS id
FROM raw JOIN cls ON raw.doc_id = cls.doc_id"""


def _raw_features(spark, base):
    paths = csvio.write_mixed(fx.raw_comments(spark, base), scratch_path(spark, "raw-comments"))
    raw = csvio.read_exact_width(spark, paths, features.COMMENT_WIDTH, multiline=True)
    # a multi-line file is one task: its rows are scored by all of them
    return features.feature_job(spread(raw), rules=fx.RULES)


def _comment_data(spark, base):
    """(data, index names) of the comment models; bodies are scored once, not by each pass of the
    index, the tree and the error."""
    rows = stored(spark, features.comment_model_rows(_raw_features(spark, base)), "comment-rows")
    return models.prepare(rows, id_col="id")


@register("feature_job", _feature_job_sql("INTEGER"))
def q_feature_job(spark, base):
    """Raw comment CSV -> width check -> blank to 0 -> time parts -> class -> 12 columns."""
    return _raw_features(spark, base)


@register("comment_dt_rmse")
def q_comment_dt_rmse(spark, base):
    """The study's whole way: raw comments, feature job, 10 indexed features, tree, RMSE."""
    data, _ = _comment_data(spark, base)
    return models.tree_rmse(data, "dt")


@register("comment_rf_rmse")
def q_comment_rf_rmse(spark, base):
    data, _ = _comment_data(spark, base)
    return models.tree_rmse(data, "rf")


@register("comment_features")
def q_comment_features(spark, base):
    """Importance of each of the 10 features."""
    data, idx = _comment_data(spark, base)
    return models.tree_summary(data, idx, "dt")


@register("feature_stream", f"""
WITH {RULES_CTES}
SELECT c.doc_id AS id, d.source AS subreddit, c.sentiment_class,
       {TIME_SQL.format(t='epoch_ms((1601510400 + d.doc_id * 3607) * 1000)')}
FROM cls c JOIN documents d ON c.doc_id = d.doc_id""")
def q_feature_stream(spark, base):
    """The feature job as a Structured Streaming query over the landed documents file;
    returns the sink it wrote."""
    from postpulse.streaming.feature_stream import start_feature_stream
    docs = table(spark, base, "documents")
    sink = scratch_path(spark, "feature-stream-out")
    q = start_feature_stream(spark, f"{base.rstrip('/')}/documents[.]parquet", docs.schema,
                             sink, scratch_path(spark, "feature-stream-ckpt"), rules=fx.RULES)
    q.awaitTermination()
    return spark.read.parquet(sink)
