import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from postpulse.llm import suffix_dedup as sd
from postpulse.llm.suffix_array import Block


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_block_marks_repeats_as_counting_does(data):
    depth = data.draw(st.sampled_from([8, 9, 16]))
    alphabet = data.draw(st.sampled_from([b"a", b"ab", b"\0\1a", bytes(range(256))]))
    strings, starts = [], []
    for _ in range(data.draw(st.integers(1, 5))):
        n = data.draw(st.integers(1, 20))
        strings.append(bytes(data.draw(st.lists(st.sampled_from(list(alphabet)), min_size=n + depth - 1,
                                                max_size=n + depth - 1))))
        starts.append(n)
    seen = Counter(s[i:i + depth] for s, n in zip(strings, starts) for i in range(n))
    want = [[seen[s[i:i + depth]] > 1 for i in range(n)] for s, n in zip(strings, starts)]
    assert [x.tolist() for x in Block(strings, starts, depth).repeated()] == want


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        covered = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(r, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((doc, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(6, 30))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [word() for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    rows += [(5, rows[5][1]), (None, rows[6][1]), (100, None), (101, ""), (102, "a" * 200),
             (103, "ab" * 90), (104, "short")]
    return rows


def check(spark, docs, rows, **options):
    got = sd.removal_report(spark, docs(rows), length=32, gram=8, **options)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in got.collect()) == brute(rows, 32)


def test_report_equals_brute_force(spark, docs):
    check(spark, docs, corpus(1))


def test_hot_anchors_are_cut_and_still_exact(spark, docs):
    """Every anchor with more than three open windows goes the way of a hot one."""
    check(spark, docs, corpus(2), hot=3)


def test_long_texts_go_in_pieces(spark, docs, monkeypatch):
    runs = sorted(sd.runs_of(b"x" * 10, sd.np.array([10]), 32, 8))
    assert runs == []
    whole = {(s + k) for _, s, n, _, _ in sd.runs_of(bytes(range(200)), sd.np.array([200]), 32, 8)
             for k in range(n)}
    assert whole == set(range(200 - 32 + 1))


def test_empty_table_and_text_removal(spark, docs):
    assert sd.removal_report(spark, docs([]), length=32, gram=8).count() == 0
    passage = "é" * 40
    rows = [(1, "one " + passage), (2, passage + " two"), (3, "three")]
    out = {r.doc_id: r.text for r in sd.remove_repeats(spark, docs(rows), length=32, gram=8).collect()}
    assert out == {1: "one ", 2: " two", 3: "three"}
