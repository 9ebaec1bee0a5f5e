import re
from collections import defaultdict

import corpus_pipeline as cp
from postpulse.llm.common import landed

BASE = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(landed(spark, stage(spark, kept[-1], BASE), "test-" + name))
    assert all(x.columns == columns for x in kept[1:5])
    rows = [{r.doc_id: r.text for r in x.collect()} for x in kept[:5]]
    toxic = {r.doc_id for r in spark.read.parquet(f"{BASE}/labels.parquet").where("toxic = 1").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert len(toxic & gone) >= 0.9 * len(toxic)
    first = defaultdict(list)
    for d, t in rows[1].items():
        first[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(d)
    assert set(rows[2]) == {min(ids) for ids in first.values()}
    sets = {d: shingles(t) for d, t in rows[2].items()}
    link, ids = defaultdict(set), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                link[a].add(b)
                link[b].add(a)
    root = {d: d for d in ids}
    for _ in ids:
        for d in ids:
            root[d] = min([root[d], *[root[x] for x in link[d]]])
    assert set(rows[3]) == {d for d in ids if root[d] == d}
    seen = defaultdict(int)
    raw = {d: (t or "").encode() for d, t in rows[3].items()}
    for b in raw.values():
        for i in range(len(b) - cp.REPEAT_BYTES + 1):
            seen[hash(b[i:i + cp.REPEAT_BYTES])] += 1
    for d, b in raw.items():
        covered = bytearray(len(b))
        for i in range(len(b) - cp.REPEAT_BYTES + 1):
            if seen[hash(b[i:i + cp.REPEAT_BYTES])] > 1:
                covered[i:i + cp.REPEAT_BYTES] = b"\1" * cp.REPEAT_BYTES
        want = bytes(x for x, c in zip(b, covered) if not c).decode("utf-8", "ignore")
        assert (rows[4][d] or "") == want
    words = {d: len((t or "").encode().split()) for d, t in rows[4].items()}
    got, bins = defaultdict(int), defaultdict(int)
    for r in kept[5].collect():
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id] += r.n_tokens
    assert got == words and max(bins.values()) <= cp.CAPACITY


def test_run_gives_the_last_stage(spark):
    assert cp.run(spark, BASE).columns == ["bin_id", "doc_id", "piece", "start", "n_tokens", "source", "cluster"]


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {re.match(r"op\d+_|", x)[0] for x in names}
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
