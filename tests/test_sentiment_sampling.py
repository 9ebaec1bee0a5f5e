"""Sentiment class rules, lookup plans, and sampling against brute force."""

import hashlib
import math
from collections import defaultdict

from pyspark.sql import functions as F

from postpulse.functions.sentiment import (DEFAULT_LEXICON, Rules, rule_scores, score_texts,
                                           sentiment_class)
from postpulse.operators import sampling as smp
from postpulse.sources.tables import table


def test_class_boundaries_are_strict(spark):
    df = spark.createDataFrame([("x", c) for c in [0.6, 0.25, -0.25, -0.6, 0.61, -0.61]],
                               "t string, c double")
    got = [r.k for r in df.select(sentiment_class(F.col("t"), F.col("c")).alias("k")).collect()]
    assert got == [2, 3, 4, 5, 1, 5]


def test_blank_or_null_body_is_class_10(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "the the the")], "id long, body string")
    got = {r.id: r.sentiment_class for r in score_texts(df, "id", "body").collect()}
    assert got[1] == 10 and got[2] == 10 and got[3] == 1


def test_compound_formula(spark):
    df = spark.createDataFrame([(1, "The cat, THE dog; of")], "id long, body string")
    r = score_texts(df, "id", "body").first()
    s = 1.0 + 1.0 - 1.0
    assert r.compound == round(s / math.sqrt(s * s + 15), 4)


def test_map_and_join_plans_agree(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    a = {r.doc_id: (r.compound, r.sentiment_class) for r in score_texts(d, "doc_id", "text").collect()}
    lex = spark.createDataFrame(list(DEFAULT_LEXICON.items()), "token string, valence double")
    b = {r.doc_id: (r.compound, r.sentiment_class)
         for r in score_texts(d, "doc_id", "text", lex).collect()}
    assert a == b


def test_class_counts_at_sf001(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    counts = {r.sentiment_class: r["count"] for r in
              score_texts(d, "doc_id", "text").groupBy("sentiment_class").count().collect()}
    assert counts == {1: 558, 2: 124, 3: 112, 4: 33, 5: 173}


def _num(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def _words(seed, i):
    h = hashlib.md5(f"{seed}|{i}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16) | 1


def _brute_sample(ids_by_shard, number, size, seed):
    out = set()
    for shard, ids in ids_by_shard.items():
        reps = range(number) if len(ids) >= size else [0]
        for rep in reps:
            def key(i):
                h1, h2 = _words(seed, i)
                return ((h1 + rep * h2) % (1 << 32), i)
            chosen = sorted(ids, key=key)[:size]
            out |= {(i, shard, rep) for i in chosen}
    return out


def _sharded(spark, n=3000, shards=5):
    df = spark.range(n).withColumnRenamed("id", "rid")
    return df.withColumn("shard", smp.shard_of(F.col("rid"), shards - 1))


def test_shard_sample_exact_and_small_shards(spark):
    df = _sharded(spark)
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.shard].append(r.rid)
    size = sorted(len(v) for v in ids.values())[2]      # some shards smaller, some not
    got = {(r.rid, r.shard, r.rep) for r in smp.shard_sample(df, "rid", "shard", 3, size).collect()}
    assert got == _brute_sample(ids, 3, size, smp.SAMPLE_SEED)


def test_samples_of_repeated_ids_have_their_size(spark):
    """A third of a shard's rows repeat one id; null ids belong to small shards only."""
    rows = [(i, 0) for i in range(400)] + [(7, 0)] * 200 + [(i, 1) for i in range(1000, 1040)] + [(None, 1)]
    df = spark.createDataFrame(rows, "rid long, shard int").repartition(5)
    got = smp.shard_sample(df, "rid", "shard", 6, 120)
    per = {(r["shard"], r["rep"]): r["count"] for r in got.groupBy("shard", "rep").count().collect()}
    assert per == {(0, k): 120 for k in range(6)} | {(1, 0): 41}


def test_shard_sample_fallback_path_is_exact(spark):
    df = _sharded(spark)
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.shard].append(r.rid)
    # a negative margin leaves most samples short of candidates: all take the exact path
    got = {(r.rid, r.shard, r.rep)
           for r in smp.shard_sample(df, "rid", "shard", 3, 300, margin=-30.0).collect()}
    assert got == _brute_sample(ids, 3, 300, smp.SAMPLE_SEED)


def test_hash_split_and_shard_match_python(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    rows = df.select("k", smp.split_label(F.col("k")).alias("s"),
                     smp.shard_of(F.col("k"), 10).alias("h")).collect()
    for r in rows:
        assert r.s == ("train" if _num(smp.SPLIT_SEED, r.k) % 100 < 70 else "test")
        assert r.h == _num(smp.SHARD_SEED, r.k) % 11


def test_sort_within_key_spreads_a_hot_key(spark):
    df = spark.range(4000).select((F.when(F.col("id") < 3000, F.lit("hot"))
                                   .otherwise(F.lit("cold"))).alias("k"), F.col("id"))
    out = smp.sort_within_key(df, "k", "id", partitions=4)
    sizes = out.rdd.glom().map(len).collect()
    assert max(sizes) <= 1200            # the 3000-row key is split across partitions
    rows = out.collect()
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


def test_repeated_lexicon_token_counts_once_by_every_path(spark):
    d = spark.createDataFrame([(1, "good day")], "doc_id long, text string")
    twice = spark.createDataFrame([("good", 1.0), ("good", 0.5)], "token string, valence double")
    table = score_texts(d, "doc_id", "text", twice).first()
    words = score_texts(d, "doc_id", "text", {"good": 1.0}).first()
    assert (table.compound, table.sentiment_class) == (words.compound, words.sentiment_class)
    half = score_texts(d, "doc_id", "text", {"good": 0.00005}).first()
    assert half.compound == score_texts(d, "doc_id", "text", spark.createDataFrame(
        [("good", 0.00005)], "token string, valence double")).first().compound


def test_positions_show_a_wrong_order(spark):
    from postpulse.operators.sampling import with_position
    rows = with_position(spark.range(100).orderBy(F.desc("id"))).collect()
    assert sorted((r.position, r.id) for r in rows) == [(i, 99 - i) for i in range(100)]


LEXICON = {"good": 2.0, "über": 1.5, "bad": -2.0, "day": 0.5}


def _rules(spark, texts, rules=None, lexicon=LEXICON, ids=None):
    rows = spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "id long, body string")
    narrow = rule_scores(rows, "body", lexicon, rules).collect()
    words = spark.createDataFrame(list(lexicon.items()), "token string, valence double")
    joined = rule_scores(rows, "body", words, rules).collect()
    assert sorted(map(tuple, narrow), key=str) == sorted(map(tuple, joined), key=str)
    return [r.compound for r in sorted(narrow, key=lambda r: (r.id is None, r.id))]


def _compound(s):
    return round(s / (s * s + 15) ** 0.5, 4)


def test_rules_change_the_score(spark):
    turned = lambda v: round(v * -0.74, 4)
    cases = {
        "good": 2.0, "not good": turned(2.0), "very good": 2.293, "GOOD thing": 2.733, "GOOD": 2.0,
        "good!!": 2.0 + 2 * 0.292, "bad!!!!!!": -2.0 - 4 * 0.292, "über alles": 1.5,
        "really the good": round(2 + 0.293 * 0.95, 4), "very a b good": round(2 + 0.293 * 0.9, 4),
        "very a b c good": 2.0, "slightly bad": -1.707, "not a b good": turned(2.0),
        "not a b c good": 2.0, "good, not so bad": 2.0 + turned(-2.293),
        "not very good": turned(2.293), "very not good": round(turned(2.0) - 0.293 * 0.95, 4),
        "least good": turned(2.0), "at least good": 2.0, "good bad day": 0.5,
        "good? why?": 2.0 + 0.36, "good???? ": 2.96, "good?": 2.0,
        "good but bad": 0.5 * 2.0 - 1.5 * 2.0, "bad but very good": -1.0 + 1.5 * 2.293, "so what": 0.0}
    got = _rules(spark, list(cases))
    assert got == [_compound(v) for v in cases.values()]


def test_phrases_and_marks(spark):
    rules = Rules(phrases={"bad day": 1.0, "kind of": -0.5, "good bad day": 3.0, ":)": 2.0, ":))": 3.0, "<3": 1.2})
    cases = {"a bad day": 1.0, "very bad day": 1.293, "good bad day": 3.0, "bad bad day": -2.0 + 1.0,
             "kind of good": 2.0 - 0.5, "good :)": 4.0, ":)) :)": 5.0, "not <3": round(1.2 * -0.74, 4),
             "bad day bad day": 2.0, "BAD DAY off": 1.733}
    assert _rules(spark, list(cases), rules) == [_compound(v) for v in cases.values()]


def test_ids_play_no_part(spark):
    """Repeated and null ids, null and blank texts, equal texts."""
    texts = ["good", "good", "bad", "good", None, "", "bad"]
    ids = [1, 1, 1, None, None, 5, 2**53 + 1]
    got = sorted(map(str, _rules(spark, texts, ids=ids)))
    assert got == sorted(map(str, [0.4588, 0.4588, -0.4588, 0.4588, None, 0.0, -0.4588]))
    rows = spark.createDataFrame(list(zip(ids, texts)), "id long, body string")
    words = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    plain = [sorted(map(tuple, score_texts(rows, "id", "body", x).collect()), key=str)
             for x in (LEXICON, words)]
    assert plain[0] == plain[1] and len(plain[0]) == 7
    assert rule_scores(rows.limit(0), "body", words).count() == 0


def test_the_feature_job_shuffles_nothing(spark):
    from postpulse.operators.features import feature_table
    from postpulse.sources import fixtures as fx
    out = feature_table(fx.comments(spark, "/root/testdata/sf0.001"), rules=fx.RULES)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
