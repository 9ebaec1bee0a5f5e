import math
import random
from collections import Counter, defaultdict

import numpy as np

from postpulse.llm import langid as li

TEXTS = {"aa": ["the cat sat on the mat", "a cat and a hat, the end"],
         "bb": ["der hund lief über die straße", "die katze und der hund"]}


class Tree:
    """Counts of every context up to ORDER bytes, by hand."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        full = Counter()
        for t in texts:
            raw = b"\0" * li.ORDER + t.encode()
            for i in range(li.ORDER, len(raw)):
                full[raw[i - li.ORDER:i + 1]] += 1
        for gram, n in full.items():
            for k in range(li.ORDER + 1):
                self.seen[gram[k:-1]][gram[-1]] += n

    def bits(self, text):
        raw, total = b"\0" * li.ORDER + text.encode(), 0.0
        for i in range(li.ORDER, len(raw)):
            for k in range(li.ORDER + 1):
                here = self.seen.get(raw[i - li.ORDER + k:i])
                if here is None:
                    continue
                n, d = sum(here.values()), len(here)
                if raw[i] in here:
                    total += math.log2((n + d) / here[raw[i]])
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8.0
        return total


def test_code_lengths_are_those_of_the_trees():
    counts = {}
    for lang, texts in TEXTS.items():
        g, n = np.unique(np.concatenate([li.grams(li.as_bytes(t)) for t in texts]), return_counts=True)
        counts[lang] = g.astype(np.int64), n
    trees = li.freeze(counts)
    rng = random.Random(1)
    probe = ["the hund", "", "über", "zzzz qqq", "日本", "the cat sat on the mat"]
    probe += ["".join(rng.choice("abcdefghü ,") for _ in range(30)) for _ in range(40)]
    got = trees.code_lengths(probe)
    want = [[Tree(TEXTS[x]).bits(t) for x in trees.langs] for t in probe]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_slices_of_a_long_text_add_up(monkeypatch):
    counts = {x: (np.unique(li.grams(li.as_bytes(t[0]))).astype(np.int64),
                  np.ones(len(np.unique(li.grams(li.as_bytes(t[0])))))) for x, t in TEXTS.items()}
    trees = li.freeze(counts)
    text = "the hund " * 500
    whole = trees.code_lengths([text, "x"])
    monkeypatch.setattr(li, "SLICE", 100)
    assert np.allclose(trees.code_lengths([text, "x"]), whole)


def test_predictions_and_edge_cases(spark, docs):
    rows = [(i, x, t) for x, ts in TEXTS.items() for i, t in enumerate(ts)]
    train = spark.createDataFrame([*rows, (9, None, "zzz"), (10, "aa", None)], "doc_id long, lang string, text string")
    trees = li.fit(train)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs(
        [(1, "the cat and the hat"), (2, "der hund und die straße"), (3, None), (4, ""), (5, "123 !?"),
         (None, "the end")]), trees).collect()}
    assert got[1][0] == "aa" and got[2][0] == "bb" and got[None][0] == "aa"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert li.predict(docs([]), trees).count() == 0
    assert li.fit(train.where("lang is null")) is None
    assert li.predict(docs([(1, "text")]), None).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    from postpulse.llm.queries import op9_language_id
    base = "/root/testdata/sf0.001"
    got = op9_language_id(spark, base).join(
        spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
