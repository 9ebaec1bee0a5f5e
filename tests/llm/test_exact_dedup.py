import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postpulse.llm import exact_dedup as ed
from postpulse.session import scratch_path

ROWS = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (4, "a b "), (8, None), (7, ""), (6, "c"), (6, "c"),
        (2, "x" * 5000), (1, "x" * 5000), (None, "a b"), (11, "d"), (12, "e")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(d)
    out = []
    for ids in groups.values():
        known = [d for d in ids if d is not None]
        out += [(d, min(known) if known else None, len(ids)) for d in ids]
    return sorted(out, key=str)


def digests():
    return {"sha256": ed.sha256_hex, "weak": lambda t: F.length(t).cast("string"),
            "constant": lambda t: F.lit("same")}


@pytest.mark.parametrize("name", ["sha256", "weak", "constant"])
def test_groups_by_any_digest_and_many_batches(spark, docs, name):
    path = scratch_path(spark, "dedup-test")
    docs(ROWS).repartition(5).write.parquet(path)
    got = ed.exact_groups(spark, path, digest=digests()[name], files_per_batch=1).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == brute(ROWS)
    # exactly one row of each group stays, also where a row is there twice
    assert sorted(r.doc_id for r in got if r.kept) == [1, 3, 4, 6, 7, 11, 12]
    assert sum(r.kept for r in got) == 7


def test_frame_keeps_its_columns_and_an_empty_one(spark, docs):
    out = ed.drop_copies(spark, docs(ROWS))
    assert out.columns == docs(ROWS).columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 6, 7, 11, 12]
    assert ed.drop_copies(spark, docs([])).count() == 0
