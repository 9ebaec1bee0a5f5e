"""The order of shuffled and sorted rows is part of their keys' results."""

import hashlib

from postpulse import catalog


def _orders(spark, path):
    rows = [(k, k % 7, [None, "F", "O", "P"][k % 4], k / 2) for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, "
                          "o_totalprice double").repartition(3).write.parquet(f"{path}/orders.parquet")
    return rows


def test_shuffled_rows_carry_their_place(spark, tmp_path):
    rows = _orders(spark, tmp_path)
    key = {k: int(hashlib.md5(f"42|{k}".encode()).hexdigest()[:8], 16) for k, *_ in rows}
    got = catalog.queries()["shuffle_rows"](spark, str(tmp_path)).collect()
    assert {r.o_orderkey: r.position for r in got} == {
        k: i for i, k in enumerate(sorted(key, key=lambda k: (key[k], k)))}


def test_sorted_rows_carry_their_rank_and_null_keys_stay(spark, tmp_path):
    rows = _orders(spark, tmp_path)
    got = catalog.queries()["sort_within_key"](spark, str(tmp_path)).collect()
    assert {(r.o_orderkey, r.o_orderstatus): r["rank"] for r in got} == {
        (k, s): k // 4 for k, _, s, _ in rows}
