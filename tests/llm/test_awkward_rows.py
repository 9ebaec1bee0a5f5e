"""Null ids beside ids above 2^53, rows that repeat, and columns with clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from postpulse.llm import (chaining, exact_dedup, ffd_packing, langid, ngram_join, packing, quality,
                           spm_backend, suffix_dedup, token_store, toxicity)
from postpulse.llm.common import landed
from postpulse.llm.tokens import tokenizer_path
from postpulse.session import scratch_path

LARGE = [None, 2**53 + 1, 2**53 + 3]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def near_equal():
    """Two texts that differ in one of 180 words, and a third one without an id."""
    a = words(1, 180)
    b = list(a)
    b[170] = "other"
    return [(LARGE[1], " ".join(a)), (LARGE[2], " ".join(b)), (None, " ".join(words(2, 60)))]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{i}", len(t or "")) for i, (d, t) in enumerate(rows)],
                                 SCHEMA).coalesce(1)



def store(spark, df):
    path = scratch_path(spark, "store-ids")
    return token_store.read_store(spark, path, token_store.write_store(
        spark, df, path, tokenizer_path("word_bpe_49k.json"), end_id=2))


OPERATORS = {
    1: lambda s, df: suffix_dedup.removal_report(s, df),
    2: lambda s, df: ngram_join.similar_documents(s, df),
    3: lambda s, df: toxicity.score(df, toxicity.Chain([toxicity.Link("toxic", -1.0)], 0.5)),
    4: lambda s, df: packing.pack(packing.items(df, 2048), 2048),
    5: lambda s, df: quality.apply_rules(df),
    6: lambda s, df: chaining.repeated_passages(s, df),
    7: lambda s, df: exact_dedup.drop_copies(s, df),
    8: store,
    9: lambda s, df: langid.predict(df, langid.fit(df)),
    10: lambda s, df: spm_backend.encode_documents(df, tokenizer_path("piece_bpe_32k.model")),
    12: lambda s, df: ffd_packing.pack(s, df, tokenizer_path("word_bpe_49k.json"), 2),
}


@pytest.mark.parametrize("number", OPERATORS)
def test_ids_beside_a_null_are_exact(spark, number):
    df = frame(spark, near_equal())
    rows = [r.asDict() for r in OPERATORS[number](spark, df).collect()]
    assert {r["doc_id"] for r in rows} == set(LARGE)
    by = {r["doc_id"]: r for r in rows}
    if number == 1:
        assert [by[d]["n_removed"] > 1000 for d in LARGE] == [False, True, True]
    if number == 2:
        assert [by[d]["n_links"] for d in LARGE] == [0, 1, 1]
        assert [by[d]["class_id"] for d in LARGE] == [None, LARGE[1], LARGE[1]]
    if number == 6:
        assert [by[d]["other_ids"] for d in LARGE] == [[], [LARGE[2]], [LARGE[1]]]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_ids_exact(spark, stage):
    docs = landed(spark, frame(spark, near_equal()), "ids-stage")
    if stage == 0:
        out = toxicity.reject(docs, toxicity.Chain([toxicity.Link("toxic", -1.0)], 0.5))
    else:
        out = cp.STAGES[stage][1](spark, docs, "")
    want = {None, LARGE[1]} if stage == 2 else set(LARGE)
    assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns


def test_a_third_of_all_rows_is_one_row(spark):
    text = " ".join(words(3, 120))
    rows = [(7, text)] * 300 + [(i, " ".join(words(i, 120)) + " " + text) for i in range(10, 25)]
    rows += [(i, " ".join(words(i, 30))) for i in range(100, 700)]
    df = frame(spark, rows).repartition(4)
    report = suffix_dedup.removal_report(spark, df)
    got = Counter((r.doc_id, r.n_removed) for r in report.where("n_removed > 0").collect())
    size = len(text.encode())
    # the blank before the passage repeats too, and a digit before it by chance
    assert got[(7, size)] == 300 and sum(got.values()) == 315
    assert all(n == size if d == 7 else size < n < size + 8 for d, n in got)
    # one row of a text takes part in the sort
    docs = suffix_dedup.identified(df)
    runs = suffix_dedup.anchor_runs(docs.where("doc_id = 7"))
    chosen = runs.groupBy("key", "ctx").agg(F.min("rid").alias("rid"), F.min("start").alias("start"),
                                            F.first("n").alias("n")).withColumn(
        "m", F.lit(1).cast("long")).withColumn("open_windows", F.lit(1).cast("long"))
    assert suffix_dedup.with_bytes(docs, chosen, 400).count() == chosen.count()
    # packed over shards, and no bin holds the row twice
    out = packing.pack(packing.items(df, 2048), 2048, shard_items=128).where("doc_id = 7").collect()
    assert len({r.bin_id for r in out}) == len(out) == 300
    assert len({r.bin_id.split("-")[0] for r in out}) > 4


def test_training_rows_take_one_row_of_an_id(spark):
    df = frame(spark, [(1, "a b c")] * 500 + [(1, "d")] + [(i, f"x {i}") for i in range(2, 40)])
    labels = spark.createDataFrame([(i, 1.0 if i % 2 else 0.0) for i in range(1, 40)], "doc_id long, toxic double")
    rows = toxicity.training_rows(df.select("doc_id", "text"), labels, ["toxic"], 20)
    assert rows.count() == 20 and rows.select("doc_id").distinct().count() == 20
    got = langid.training_rows(df.select("doc_id", "lang", "text"), 30)
    assert got.count() == 30


CLASHES = ["__this", "__rid", "__doc", "__f", "__r", "__file", "__row", "file", "row", "rid", "whole",
           "kept_doc", "this_rid", "this_file", "starts", "text_", "span_doc", "shard", "salt"]


def test_clashing_columns_are_kept(spark):
    rows = near_equal() + [(5, near_equal()[0][1])]
    df = frame(spark, rows).select("doc_id", "text", *[F.lit(c).alias(c) for c in CLASHES])
    for out in (ngram_join.keep_one(spark, df), exact_dedup.drop_copies(spark, df),
                suffix_dedup.remove_repeats(spark, df),
                toxicity.reject(df, toxicity.Chain([toxicity.Link("toxic", -1.0)], 0.5))):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == c for r in got for c in CLASHES)
