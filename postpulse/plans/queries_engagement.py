"""Engagement keys: engagement_topk, engagement_by_group, link_totals, rows_of_top_groups,
engagement_csv."""

from __future__ import annotations

from postpulse.catalog import register
from postpulse.operators import engagement as eng
from postpulse.session import scratch_path
from postpulse.sources import csvio
from postpulse.sources import fixtures as fx

# DuckDB form of the posts binding and of the cleaning step.
POSTS_SQL = """
posts AS (
  SELECT CASE WHEN l.l_suppkey % 10 = 0 THEN '[deleted]'
              ELSE CAST(l.l_suppkey AS VARCHAR) END AS author,
         CAST(l.l_orderkey AS VARCHAR) AS link,
         CAST(CAST(trunc(l.l_quantity) AS INTEGER) AS VARCHAR) AS num_comments,
         p.p_brand AS subreddit
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
kept AS (
  SELECT coalesce(nullif(author, ''), '0') AS author,
         coalesce(nullif(link, ''), '0') AS link,
         CAST(coalesce(nullif(num_comments, ''), '0') AS INTEGER) AS num_comments,
         coalesce(nullif(subreddit, ''), '0') AS subreddit
  FROM posts
  WHERE coalesce(nullif(author, ''), '0') <> '[deleted]'),
lt AS (SELECT link, sum(num_comments) AS total FROM kept GROUP BY link),
bygroup AS (
  SELECT k.subreddit, CAST(count(*) AS BIGINT) AS num_author,
         CAST(sum(lt.total) AS DECIMAL(38,0)) AS num_links
  FROM kept k JOIN lt ON k.link = lt.link GROUP BY k.subreddit)
"""


@register("engagement_by_group", f"WITH {POSTS_SQL} SELECT * FROM bygroup")
def q_engagement_by_group(spark, base):
    return eng.engagement_by_group(eng.clean_posts(fx.posts(spark, base)))


@register("engagement_topk", f"""
WITH {POSTS_SQL}
SELECT * FROM bygroup ORDER BY num_links DESC, subreddit ASC LIMIT 10""")
def q_engagement_topk(spark, base):
    return eng.engagement_topk(q_engagement_by_group(spark, base), 10)


@register("link_totals", f"""
WITH {POSTS_SQL}
SELECT link, CAST(total AS BIGINT) AS total_comments FROM lt""")
def q_link_totals(spark, base):
    return eng.link_totals(eng.clean_posts(fx.posts(spark, base)))


@register("rows_of_top_groups", f"""
WITH {POSTS_SQL},
top AS (SELECT subreddit FROM bygroup ORDER BY num_links DESC, subreddit ASC LIMIT 10)
SELECT * FROM posts WHERE subreddit IN (SELECT subreddit FROM top)""")
def q_rows_of_top_groups(spark, base):
    return eng.top_groups_rows(lambda groups: fx.posts(spark, base, groups), 10)


@register("engagement_csv", f"WITH {POSTS_SQL} SELECT * FROM bygroup")
def q_engagement_csv(spark, base):
    """Engagement table written as headerless CSV, then read back with its schema."""
    path = scratch_path(spark, "engagement")
    eng.write_engagement(q_engagement_by_group(spark, base), path)
    return csvio.read_delimited(spark, path, eng.ENGAGEMENT_SCHEMA, header=False)


JOB_SQL = POSTS_SQL.replace("SELECT coalesce(nullif(author, ''), '0') AS author", "SELECT CASE WHEN num_comments = '48' THEN '0' ELSE author END AS author").replace(
    "WHERE coalesce(nullif(author, ''), '0') <> '[deleted]'",
    "WHERE num_comments NOT IN ('49', '50') AND (num_comments = '48' OR author <> '[deleted]')")


@register("engagement_job", f"WITH {JOB_SQL} SELECT * FROM bygroup")
def q_engagement_job(spark, base):
    """Raw post CSV of 95 fields -> width check -> blank to 0 -> author filter -> ranking table."""
    paths = csvio.write_mixed(fx.raw_posts(spark, base), scratch_path(spark, "raw-posts"))
    raw = csvio.read_exact_width(spark, paths, eng.POST_WIDTH)
    return eng.engagement_by_group(eng.clean_posts(eng.posts_of_raw(raw)))
