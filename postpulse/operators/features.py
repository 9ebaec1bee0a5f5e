"""Comment feature table and model table (survey N4, N5, P1-P4, P8, S10, D1-D6).

The original ran a line-at-a-time mapper (blank -> 0, time parts, per-row
sentiment, print 12 fields) and a pandas copy of it. Here it is one projection
over the comments: every output column is computed from its own row, so the
whole job is narrow (no shuffle) and stays inside whole-stage code generation
except for the array lambdas of the lexicon lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postpulse.functions.cleaning import blank_to_zero, drop_strict, rename_all, to_int
from postpulse.functions.sentiment import DEFAULT_LEXICON, Rules, rule_scores
from postpulse.functions.timeparts import time_parts

# ---- fixed values: names of the model table columns, in file order -----------
MODEL_COLUMNS = ["subreddit", "gilded", "archived", "sentiment", "controversiality",
                 "score", "HoD", "DoW", "DoM", "month", "year"]
# ------------------------------------------------------------------------------

# ---- fixed values: width of a raw comment row and the fields the job reads ----
COMMENT_WIDTH = 22
EPOCH_FIELD, SUBREDDIT_FIELD, GILDED_FIELD, ARCHIVED_FIELD = 0, 9, 11, 13
ID_FIELD, BODY_FIELD, CONTROVERSIALITY_FIELD, SCORE_FIELD = 15, 17, 19, 20
# ------------------------------------------------------------------------------

TIME_PART_NAMES = ["hour", "dayofweek", "day", "month", "year"]


def with_time_parts(df: DataFrame, epoch_col: str = "created_utc") -> DataFrame:
    """Append hour, ISO weekday, day, month, year; a missing epoch counts as 0 (1970-01-01),
    and so does a blank one when epochs are text."""
    epoch = F.col(epoch_col)
    if isinstance(df.schema[epoch_col].dataType, StringType):
        epoch = blank_to_zero(epoch)
    epoch = F.coalesce(epoch.cast("long"), F.lit(0).cast("long"))
    parts = time_parts(epoch)
    return df.select("*", *[parts[n].alias(n) for n in TIME_PART_NAMES])


def feature_table(comments: DataFrame, lexicon=None, id_col: str = "id",
                  body_col: str = "body", keep: list[str] | None = None,
                  rules: Rules | None = None) -> DataFrame:
    """Per comment: kept columns, sentiment class and time parts; the body is dropped.

    The class follows from the rule scorer.
    """
    keep = keep if keep is not None else ["subreddit"]
    scored = rule_scores(comments, body_col, DEFAULT_LEXICON if lexicon is None else lexicon, rules)
    timed = with_time_parts(scored)
    return timed.select(id_col, *keep, "sentiment_class", *TIME_PART_NAMES)


def feature_job(raw: DataFrame, lexicon=None, rules: Rules | None = None) -> DataFrame:
    """The whole comment job on raw rows ``_c0`` .. ``_c21`` (N5): blank -> 0, time parts,
    sentiment class of the body, and the model table's columns by name, then the id.

    The class looks at the body as it was read: a blank one is class 10.
    """
    body = f"_c{BODY_FIELD}"
    fields = {"id": ID_FIELD, "subreddit": SUBREDDIT_FIELD, "gilded": GILDED_FIELD,
              "archived": ARCHIVED_FIELD, "controversiality": CONTROVERSIALITY_FIELD,
              "score": SCORE_FIELD, "created_utc": EPOCH_FIELD}
    named = raw.select(F.col(body).alias("body"), *[
        blank_to_zero(F.col(f"_c{i}")).alias(n) for n, i in fields.items()])
    parts = with_time_parts(rule_scores(
        named, "body", DEFAULT_LEXICON if lexicon is None else lexicon, rules))
    renamed = parts.withColumnsRenamed({"sentiment_class": "sentiment", "hour": "HoD",
                                        "dayofweek": "DoW", "day": "DoM"})
    return renamed.select(*MODEL_COLUMNS, "id")


def comment_model_rows(features: DataFrame) -> DataFrame:
    """The feature table as the models take it: every feature is text, the score a number."""
    return features.select(*[F.col(c).cast("string").alias(c) if c != "score"
                             else to_int(F.col(c)).alias(c) for c in MODEL_COLUMNS],
                           F.col("id").cast("long").alias("id"))


def model_table(raw: DataFrame, drop_positions: list[str], names: list[str],
                score_col: str = "score", strict: bool = True) -> DataFrame:
    """Positional text table -> named model table.

    Positions are dropped strictly (an absent one raises), the remaining
    columns are renamed by position (the count must match) and the score is
    parsed to int (bad text raises; ``strict=False`` gives null).
    """
    named = rename_all(drop_strict(raw, drop_positions), names)
    return named.withColumn(score_col, to_int(F.col(score_col), strict))
