import hashlib
import math
import random

import numpy as np
import pytest

from postpulse.llm import bit_planes as bp

SCHEMA = "vec_id long, embedding array<double>, planes string, cluster string, n string"


@pytest.mark.parametrize("largest", [0, 1, 2, 511, 1024, 100_000, bp.LARGEST])
def test_planes_give_exact_products_and_distances(largest):
    rng = np.random.default_rng(largest)
    a = rng.integers(-largest - 1, largest + 1, (30, 64))
    b = rng.integers(-max(1, largest // 7) - 1, largest + 1, (5, 64))
    pa_, pb = bp.to_planes(a), bp.to_planes(b)
    assert (bp.from_planes(pa_) == a).all()
    assert (bp.dot_products(pa_, pb) == a @ b.T).all()
    assert (bp.norms(pa_) == (a * a).sum(axis=1)).all()
    number, distance = bp.Centroids(b.tolist()).nearest(pa_)
    want = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (number == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def plain(rows, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(
        f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    z = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(z))
    for _ in range(rounds):
        held = [[] for _ in z]
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        z = [[sum(col) // len(h) for col in zip(*h)] if h else c for h, c in zip(held, z)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in placed)
    per = {c: sum(d for _, c2, d in placed if c2 == c) for c in range(len(z))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted(((i, c, d, per[c], total, sha[c]) for i, c, d in placed), key=str)


def run(spark, rows, k=4, rounds=3, parts=3):
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA).repartition(parts)
    out = bp.cluster_vectors(spark, df, k, rounds, seed="3:").drop("cluster_size")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_rounds_equal_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(150)]
    rows += [(2**53 + 1, rows[0][1]), (2**53 + 3, rows[0][1]), (None, rows[1][1])]
    rows += [(7, rows[7][1])] * 60                                  # a third of all rows alike
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65),
             (204, [None] + [0.5] * 63), (205, [math.nan] + [0.5] * 63),
             (206, [math.inf] + [0.5] * 63), (207, [300.5] + [-0.25] * 63)]
    for rounds in (0, 1, 4):
        assert run(spark, rows, rounds=rounds) == plain(rows, 4, rounds)
    assert run(spark, rows, k=8, rounds=2, parts=1) == run(spark, rows, k=8, rounds=2, parts=7)


def test_few_empty_and_too_large(spark):
    rows = [(1, [0.0] * 64), (2, [1.0] * 64)]
    assert run(spark, rows, k=8) == plain(rows, 8, 3)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="exceeds"):
        run(spark, [(1, [1e9] * 64)])


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [0.125 * (i % 2)] * 64) for i in range(40)]
    assert run(spark, rows, k=8, rounds=4) == plain(rows, 8, 4)
