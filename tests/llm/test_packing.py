import random
from collections import defaultdict

from postpulse.llm import packing as pk

SCHEMA = "doc_id long, text string, source string, bin_id string"


class Plain:
    """Best fit by looking at every bin."""

    def __init__(self, capacity):
        self.capacity, self.bins = capacity, []

    def place(self, length, source, cluster):
        fits = [(b[0], i) for i, b in enumerate(self.bins) if b[0] >= length
                and (source is None or source not in b[1]) and cluster not in b[2]]
        if fits:
            i = min(fits)[1]
        else:
            i = len(self.bins)
            self.bins.append([self.capacity, set(), set()])
        b = self.bins[i]
        b[0] -= length
        b[1].add(source)
        b[2].add(cluster)
        return i


def test_bitmaps_find_the_bin_that_a_full_search_finds():
    rng = random.Random(5)
    fast, slow = pk.Shard(50), Plain(50)
    for _ in range(1500):
        item = rng.randint(0, 50), rng.choice(["s0"] * 3 + ["s1", "s2", None]), rng.randint(0, 200)
        assert fast.place(*item) == slow.place(*item)


def test_every_token_once_and_no_conflict(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) + f" {i % 90}", f"s{i % 3 if i % 2 else 0}", "x")
            for i in range(400)]
    rows += [(1, None, "s1", "x"), (None, "a b", None, "x"), (7, "", "s2", "x"), rows[3], rows[3],
             (500, "long " * 333, "s0", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pk.pack(pk.items(df, 64), capacity=64, shard_items=128).collect()
    bins, docs = defaultdict(list), defaultdict(int)
    for r in out:
        bins[r.bin_id].append(r)
        docs[r.doc_id] += r.n_tokens
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= 64
        sources = [r.source for r in held if r.source is not None]
        assert len(sources) == len(set(sources))
        assert len({r.cluster for r in held}) == len(held)
    words = defaultdict(int)
    for d, t, _, _ in rows:
        words[d] += len((t or "").split())
    assert docs == words
    assert sorted(r.start for r in out if r.doc_id == 500) == [0, 64, 128, 192, 256, 320]
    assert pk.pack(pk.items(df.limit(0), 64), 64).count() == 0
