"""Community engagement ranking (survey A1-A3, J1, J2, P6, P7, P13, R1, S13).

Per community the study reports
  num_author: number of kept rows (not distinct authors), and
  num_links:  sum over its rows of the row's link total, where a link total
              is the sum of comment counts of that link over *all* communities.

Plan, chosen so that no single key can land on one task:

  rows --partial agg--> (subreddit, link): n_rows, comments      [shuffle 1]
       --window sum by link--> link_total per pair               [shuffle 2]
       --partial agg--> subreddit: sum(n_rows), sum(n_rows*link_total) [shuffle 3]

    sum_{rows r in s} total(link(r)) = sum_{links l} count(s, l) * total(l)

so the link totals are joined to one row per (community, link) pair rather
than to every post. A link with a third of all rows still arrives at its
window task as at most one row per community, and every shuffle moves
map-side partial aggregates, never raw rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.functions.cleaning import fill_blank_zero, to_int
from postpulse.sources.csvio import write_delimited
from postpulse.sources.fixtures import DELETED_AUTHOR

WIDE = "decimal(38,0)"
POST_COLUMNS = ["author", "link", "num_comments", "subreddit"]


def clean_posts(posts: DataFrame, strict: bool = True) -> DataFrame:
    """Blank -> '0' in every field, drop deleted authors, parse the comment count.

    A blank author became '0' first and is kept, as in the original mapper.
    ``strict`` raises on a non-numeric count; otherwise it is null.
    """
    filled = fill_blank_zero(posts.select(*POST_COLUMNS))
    return (filled.filter(F.col("author") != F.lit(DELETED_AUTHOR))
                  .withColumn("num_comments", to_int(F.col("num_comments"), strict)))


# ---- fixed values: width of a raw post row and the fields the job reads --------
POST_WIDTH = 95
POST_FIELDS = {"author": 2, "link": 15, "num_comments": 32, "subreddit": 47}
# ------------------------------------------------------------------------------


def posts_of_raw(raw: DataFrame) -> DataFrame:
    """The four fields of raw rows ``_c0`` .. ``_c94`` that the ranking needs."""
    return raw.select(*[F.col(f"_c{i}").alias(n) for n, i in POST_FIELDS.items()])


def link_totals(clean: DataFrame) -> DataFrame:
    """Total comments per link (A1)."""
    return clean.groupBy("link").agg(F.sum("num_comments").alias("total_comments"))


def link_pairs(clean: DataFrame) -> DataFrame:
    """One row per (community, link): rows and comments, aggregated map-side first."""
    return clean.groupBy("subreddit", "link").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("num_comments").alias("comments"))


def engagement_by_group(clean: DataFrame) -> DataFrame:
    """subreddit, num_author, num_links for every community."""
    # a blank or hot link's rows x comments pass 2**63 long before its rows do
    pairs = link_pairs(clean)
    total = F.sum(F.col("comments").cast(WIDE)).over(Window.partitionBy("link")).cast(WIDE)
    with_total = pairs.withColumn("link_total", total)
    return with_total.groupBy("subreddit").agg(
        F.sum("n_rows").alias("num_author"),
        F.sum((F.col("n_rows").cast("decimal(19,0)") * F.col("link_total")).cast(WIDE))
        .cast(WIDE).alias("num_links"))


def engagement_topk(by_group: DataFrame, k: int = 10) -> DataFrame:
    """The k most engaging communities by num_links; ties by name.

    orderBy + limit plans as a distributed top-k (TakeOrderedAndProject).
    """
    return by_group.orderBy(F.desc("num_links"), F.asc("subreddit")).limit(k)


def rows_of_groups(rows: DataFrame, groups: DataFrame, key: str = "subreddit") -> DataFrame:
    """Keep rows whose community is in ``groups`` (J2), as a left-semi join that Spark plans
    from measured sizes."""
    return rows.join(groups.select(key), key, "left_semi")


def top_groups_rows(posts: Callable[[DataFrame | None], DataFrame], k: int = 10) -> DataFrame:
    """Rows of the ``k`` most engaging communities.

    ``posts(groups)`` binds the posts; given communities, it keeps theirs only, on the side
    of its own join that names them, so the second pass filters before it joins.
    """
    top = engagement_topk(engagement_by_group(clean_posts(posts(None))), k)
    return posts(F.broadcast(top.select("subreddit").limit(k)))


ENGAGEMENT_SCHEMA = f"subreddit string, num_author long, num_links {WIDE}"


def write_engagement(by_group: DataFrame, path: str) -> str:
    """The reducer's output file: subreddit,num_author,num_links per line.

    The original printed a trailing comma (an empty fourth field); it is not kept.
    """
    return write_delimited(by_group.select("subreddit", "num_author", "num_links"), path, header=False)
