import random
from collections import defaultdict

import pytest

from postpulse.llm import ngram_join as nj
from postpulse.llm.components import components


def family(seed, copies, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(words)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 10 ** 6)}"
        yield " ".join(own)


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min([root[i], *[root[j] for j in links[i]]])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, min(ids) if sets[i] and ids else d, len(links[i])))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1024, 3])
def test_classes_and_links_equal_brute_force(spark, docs, monkeypatch, blocks):
    monkeypatch.setattr(nj, "BLOCK_CLASSES", blocks)
    texts = [t for s, n in ((1, 14), (2, 5), (3, 2), (4, 1)) for t in family(s, n)]
    rows = list(enumerate(texts))
    rows += [(50, texts[0]), (50, texts[0]), (None, texts[1]), (60, None), (61, ""), (62, "a b"),
             (63, "a  b"), (64, "c"), (65, " ".join(["w"] * 300))]
    got = nj.similar_documents(spark, docs(rows)).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=str) == brute(rows)
    kept = defaultdict(set)
    for r in got:
        if r.kept:
            kept[r.class_id].add(r.doc_id)
    assert all(len(v) == 1 for v in kept.values())
    left = {r.doc_id for r in nj.keep_one(spark, docs(rows)).collect()}
    assert left == {c for _, c, _ in brute(rows)}


def test_depth_is_shortened_until_the_recall_is_met():
    depth = nj.prefix_depth(0.8, 0.999)
    assert nj.recall_at(depth, 0.8, nj.VALUES, nj.TREES) >= 0.999
    assert nj.recall_at(depth + 1, 0.8, nj.VALUES, nj.TREES) < 0.999


def test_empty_table(spark, docs):
    assert nj.similar_documents(spark, docs([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {(r.node, r.root) for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 130)}
