"""Engagement edge cases (FIXTURES.md section 4) and a brute-force loop check."""

from collections import defaultdict

import pytest
from pyspark.errors import ArithmeticException, NumberFormatException, SparkRuntimeException

from postpulse.operators import engagement as eng
from postpulse.sources import fixtures as fx

SCHEMA = "author string, link string, num_comments string, subreddit string"


def _by_group(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = eng.engagement_by_group(eng.clean_posts(df)).collect()
    return {r.subreddit: (r.num_author, r.num_links) for r in out}


def test_same_link_twice_in_one_community(spark):
    got = _by_group(spark, [("a", "L1", "3", "s1"), ("b", "L1", "4", "s1")])
    assert got == {"s1": (2, 14)}


def test_same_link_in_two_communities(spark):
    got = _by_group(spark, [("a", "L1", "3", "s1"), ("b", "L1", "4", "s2")])
    assert got == {"s1": (1, 7), "s2": (1, 7)}


def test_deleted_author_removed_before_totals(spark):
    got = _by_group(spark, [("a", "L1", "3", "s1"), ("[deleted]", "L1", "100", "s1")])
    assert got == {"s1": (1, 3)}


def test_blank_author_becomes_zero_and_stays(spark):
    df = spark.createDataFrame([("", "L1", "3", "s1"), (None, "L2", "1", "s1")], SCHEMA)
    rows = eng.clean_posts(df).collect()
    assert sorted(r.author for r in rows) == ["0", "0"]


def test_blank_comment_count_is_zero(spark):
    got = _by_group(spark, [("a", "L1", "", "s1"), ("b", "L1", "5", "s1")])
    assert got == {"s1": (2, 10)}


def test_non_numeric_count_errors_or_null(spark):
    df = spark.createDataFrame([("a", "L1", "x7", "s1")], SCHEMA)
    with pytest.raises((NumberFormatException, SparkRuntimeException, ArithmeticException, Exception)):
        eng.clean_posts(df, strict=True).collect()
    assert eng.clean_posts(df, strict=False).collect()[0].num_comments is None


def _brute(rows):
    kept = []
    for a, link, c, s in rows:
        a = a if a else "0"
        c = int(c) if c else 0
        if a != "[deleted]":
            kept.append((a, link, c, s))
    totals = defaultdict(int)
    for _, link, c, _ in kept:
        totals[link] += c
    out = defaultdict(lambda: [0, 0])
    for _, link, _, s in kept:
        out[s][0] += 1
        out[s][1] += totals[link]
    return {k: tuple(v) for k, v in out.items()}


def test_matches_plain_loop_on_fixture(spark):
    posts = fx.posts(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in posts.collect()]
    got = {r.subreddit: (r.num_author, r.num_links)
           for r in eng.engagement_by_group(eng.clean_posts(posts)).collect()}
    assert got == _brute(rows)


def test_topk_orders_by_links_then_name(spark):
    posts = fx.posts(spark, "/root/testdata/sf0.001")
    by = eng.engagement_by_group(eng.clean_posts(posts))
    top = [(r.num_links, r.subreddit) for r in eng.engagement_topk(by, 10).collect()]
    full = sorted(((r.num_links, r.subreddit) for r in by.collect()), key=lambda t: (-t[0], t[1]))
    assert top == full[:10]


def test_hot_link_with_a_third_of_rows(spark):
    """One link holds a third of all rows across five communities."""
    rows = []
    for i in range(3000):
        link = "HOT" if i % 3 == 0 else f"L{i % 97}"
        rows.append((f"u{i % 13}", link, str(i % 7), f"s{i % 5}"))
    df = spark.createDataFrame(rows, SCHEMA)
    clean = eng.clean_posts(df)
    got = {r.subreddit: (r.num_author, r.num_links) for r in eng.engagement_by_group(clean).collect()}
    assert got == _brute(rows)
    # the hot link reaches the window as one row per community, not 1,000 rows
    assert eng.link_pairs(clean).filter("link = 'HOT'").count() == 5


def test_hot_link_passes_64_bits(spark):
    pairs = spark.createDataFrame([("s1", "0", 300_000_000_000, 7_500_000_000_000)],
                                  "subreddit string, link string, n_rows long, comments long")
    original = eng.link_pairs
    eng.link_pairs = lambda clean: clean
    try:
        row = eng.engagement_by_group(pairs).first()
    finally:
        eng.link_pairs = original
    assert int(row.num_links) == 300_000_000_000 * 7_500_000_000_000 > 2 ** 63
