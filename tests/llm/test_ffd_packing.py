import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from postpulse.llm import ffd_packing as fp
from postpulse.llm.tokens import WordEncoder, tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def plain(lengths, capacity):
    """First fit decreasing by looking at every bin."""
    room, bins = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= lengths[i]
        bins[i] = b
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_the_first_bin_with_room(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([3, 30, 64])) for _ in range(rng.choice([1, 2, 9, 400]))]
    assert fp.first_fit_decreasing(lengths, 64) == plain(lengths, 64)
    with pytest.raises(ValueError):
        fp.Tournament(4, 10).place(11)


@pytest.mark.parametrize("lengths", [
    [1], [4095], [2049] * 100, [1] * 5000, [4095] * 30, [1366] * 31, list(range(1, 4096, 7)), []])
def test_padding_is_bounded_for_any_lengths(lengths):
    out = fp.layout(lengths, 4096, 1 / 64)
    held, got = defaultdict(list), defaultdict(list)
    for i, start, n, s, offset in out:
        held[s].append((offset, n))
        got[i].append((start, n))
    padding = 0
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= sum(lengths) / 63
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(got[i]):
            assert start == at
            at += size
        assert at == n


def check(rows, out, capacity):
    """Every id once, checksums of the library's own ids, sequences without gaps."""
    enc = WordEncoder(WORDS)
    want = defaultdict(list)
    for d, t in rows:
        ids = enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want[d].append(np.array(ids, "<u4"))
    pieces, held = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append(r)
        held[r.sequence_id].append(r)
    assert {d for d, _ in pieces} == set(want)
    for d, texts in want.items():
        for n in {len(x) for x in texts}:
            alike = [x for x in texts if len(x) == n]
            spots = sorted((r.start, r.length, r.ids_crc32) for r in pieces[d, n])
            covered = sorted((s + k) for s, length, _ in spots for k in range(length))
            assert covered == sorted(k for _ in alike for k in range(n))
            sums = {(s, length): {zlib.crc32(x[s:s + length].tobytes()) for x in alike}
                    for s, length, _ in spots}
            assert all(c in sums[s, length] for s, length, c in spots)
    padding = total = 0
    for parts in held.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= total / 63
    return len(held), padding


def test_every_id_in_one_piece(spark, docs):
    rng = random.Random(3)
    vocabulary = ["the", "of", "naïve", "tokenizer", "x1", "日本", "and", "ﬁne"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, "no id"), (2**53 + 1, "large"),
             (2**53 + 3, "large too"), (403, "long text " * 4000), (404, "y" * 30_000)]
    rows += [(5, "same row " * 20)] * 200
    for parts, items in ((3, 64), (1, 8192)):
        out = fp.pack(spark, docs(rows).repartition(parts), WORDS, 2, capacity=256, group_items=items)
        check(rows, out.collect(), 256)
    assert fp.pack(spark, docs([]), WORDS, 2).count() == 0
    with pytest.raises(ValueError):
        fp.pack(spark, docs([]), WORDS, 2, capacity=1000)


def test_equal_rows_spread_over_groups(spark, docs):
    out = fp.pack(spark, docs([(1, "a b c d e")] * 3000), WORDS, 2, capacity=64, group_items=100)
    per = out.groupBy((out.sequence_id / 2**25).cast("long").alias("g"), "doc_tokens").sum("length")
    documents = [r["sum(length)"] / r["doc_tokens"] for r in per.collect()]
    assert len(documents) == 30 and sum(documents) == 3000 and max(documents) < 200
