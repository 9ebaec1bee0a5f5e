"""Similarity self-join on word n-grams: a MinHash LSH forest, then exact Jaccard.

Each text is the set of its ``SHINGLE``-word shingles. Texts with equal sets are one
*class*; only classes are joined. A class has ``VALUES`` minhashes; each of ``TREES``
prefix trees orders classes by a label of ``LABEL`` of them, chosen once for the tree.
Two classes are candidates when they share a prefix of a label. The prefix starts at the
whole label and is shortened until the chance that a pair at the threshold shares it in
some tree reaches ``recall``.

Prefix groups are not expanded into pairs: each links its members to its smallest one,
and connected groups of candidates are verified as a whole, so a pair also meets when no
tree has brought just these two together. Verification counts common shingles of all
pairs of a group in blocks of bounded size, each a task of its own, and gives per class
the number of linked documents and its verified component, never the pairs.

Defined results: words are separated by blanks, case and punctuation count; a text of
one to four words has one shingle, all its words; null and empty texts have none and
link with nothing, themselves a class each; copies are linked to each other; rows that
repeat an id are rows of their own; the class id is the smallest id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import landed, map_frames, words_of
from postpulse.llm.components import components

SHINGLE = 5
VALUES, TREES, LABEL = 128, 64, 12
RECALL = 0.999
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000
CACHE = 400_000
NO_SET = 0


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def coefficients(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return (rng.integers(0, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, values, dtype=np.uint64))


def minhashes(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(items), 4096):
        part = items[lo:lo + 4096]
        least = np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return least


def labels(values: int, trees: int, label: int) -> np.ndarray:
    """Which minhashes make up each tree's label, in order."""
    rng = np.random.Generator(np.random.PCG64(21))
    return np.stack([rng.permutation(values)[:label] for _ in range(trees)])


def recall_at(depth: int, similarity: float, values: int, trees: int) -> float:
    """Chance that a pair shares a prefix of this depth in some tree."""
    total = 0.0
    for m in range(values + 1):
        chance = comb(values, m) * similarity ** m * (1 - similarity) ** (values - m)
        one = comb(m, depth) / comb(values, depth)
        total += chance * (1 - (1 - one) ** trees)
    return total


def prefix_depth(similarity: float, recall: float, values: int = VALUES, trees: int = TREES,
                 label: int = LABEL) -> int:
    """The longest prefix that reaches the recall: the whole label, shortened step by step."""
    for depth in range(label, 0, -1):
        if recall_at(depth, similarity, values, trees) >= recall:
            return depth
    raise ValueError(f"{trees} trees cannot reach recall {recall}")


def signatures(docs: DataFrame, depth: int, size: int = SHINGLE) -> DataFrame:
    """(doc_id, rid, cls, n, keys) per row of (doc_id, rid, text): the class by its set's hash,
    the number of shingles and one prefix key per tree."""
    (a, b), chosen = coefficients(VALUES), labels(VALUES, TREES, LABEL)[:, :depth]
    salt = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in frames:
            cls, n, keys = [], [], []
            for text in pdf["text"]:
                items = shingles(text, hashes, size)
                n.append(len(items))
                if not len(items):
                    cls.append(NO_SET)
                    keys.append(np.zeros(0, np.int64))
                    continue
                cls.append(xxhash.xxh64_intdigest(items.tobytes(), seed=1) - (1 << 63))
                least, key = minhashes(items, a, b), salt.copy()
                for k in range(depth):
                    key = (key ^ least[chosen[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                keys.append(key.view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "rid": pdf["rid"],
                                "cls": cls, "n": n, "keys": keys})

    return map_frames(docs, sign, "doc_id long, rid long, cls long, n int, keys array<long>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of items each two sets share (the diagonal is not meant)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[item] > 1
    owner, item = owner[keep], item[keep]
    by = np.lexsort((owner, item))
    owner, item = owner[by], item[by]
    often = times[item] > 16
    out = np.zeros((n, n), np.float32)
    # rare items: pairs of their few owners; owners ascend, so only the upper half is filled
    o, i = owner[~often], item[~often]
    flat = np.zeros(n * n, np.int64)
    for lag in range(1, 16):
        same = np.flatnonzero(i[:-lag] == i[lag:]) if len(i) > lag else []
        if not len(same):
            break
        flat += np.bincount(o[same] * n + o[same + lag], minlength=n * n)
    upper = flat.reshape(n, n).astype(np.float32)
    out += upper + upper.T
    # frequent items: products of 0/1 columns
    o, i = owner[often], item[often]
    if len(i):
        _, column = np.unique(i, return_inverse=True)
        for lo in range(0, int(column[-1]) + 1, 4096):
            part = slice(*np.searchsorted(column, [lo, lo + 4096]))
            x = np.zeros((n, 4096), np.float32)
            x[o[part], column[part] - lo] = 1.0
            out += x @ x.T
    return out


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which two sets have Jaccard similarity num / den or more."""
    common = common_counts(sets).astype(np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = common * (den + num) >= num * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(out, False)
    return out


def smallest_reachable(link: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Per row the smallest name in its connected group."""
    names = names.copy()
    while True:
        nearest = np.where(link, names[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(names, nearest)
        if (new == names).all():
            return names
        names = new


def verify(members: DataFrame, num: int, den: int) -> DataFrame:
    """(cls, links, hub, blocks) of (comp, blocks, i, j, block, cls, copies, items) rows.

    Group (i, j) of a candidate component compares its blocks i and j with each other, or
    block i with itself.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls")     # a text that several rows share
        sets = [np.frombuffer(x, "<u8") for x in pdf["items"]]
        link = linked(sets, num, den)
        if pdf["i"].iat[0] != pdf["j"].iat[0]:
            side = pdf["block"].to_numpy()
            link &= side[:, None] != side[None, :]
        names = pdf["cls"].to_numpy()
        return pd.DataFrame({"cls": names, "links": link @ pdf["copies"].to_numpy(),
                             "hub": smallest_reachable(link, names),
                             "blocks": pdf["blocks"].to_numpy()})

    return members.groupBy("comp", "i", "j").applyInPandas(
        solve, "cls long, links long, hub long, blocks long")


def similar_documents(spark: SparkSession, df: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", num: int = 4, den: int = 5, size: int = SHINGLE,
                      recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, n_links, copy_of, group_size, kept, rid.

    ``n_links`` counts the other documents with similarity num / den or more; ``class_id``
    is the smallest id of the connected group of links, ``copy_of`` that of the documents
    with the same shingles; ``kept`` marks the first document of the group (smallest id, ids
    before nulls); ``rid`` is xxhash64 of the text.
    """
    depth = prefix_depth(num / den, recall)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"),
                     text.alias("text"))
    rows = landed(spark, signatures(docs, depth, size), "join-signatures")
    classes = landed(spark, rows.where(F.col("n") > 0).groupBy("cls").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "rid")).alias("one"),
        F.min("doc_id").alias("copy_of"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")),
        "join-classes")

    # the forest: members of a shared prefix are linked to its smallest class
    leaves = classes.select("cls", F.explode("keys").alias("prefix"))
    hubs = leaves.groupBy("prefix").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n"))
    shared = leaves.join(hubs.where("n > 1"), "prefix").where("cls <> hub")
    candidates = components(spark, shared.select(F.col("cls").alias("a"), F.col("hub").alias("b"))
                            .distinct())
    members = landed(spark, classes.select("cls", "copies", "one", "n").join(
        candidates.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "cls"),
        "join-members")
    sizes = members.groupBy("comp").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES)),
        F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("long").alias("blocks"))
    members = members.join(sizes, "comp").withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.col("blocks")))

    # exact verification: the text of one document per class
    wanted = members.select("comp", "blocks", "block", "cls", "copies",
                            F.col("one.doc_id").alias("d"), F.col("one.rid").alias("r"))
    # the same join at every size: the members grow with the corpus and are never broadcast
    texts = docs.join(wanted.hint("merge"), (F.col("rid") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))

    def to_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in frames:
            items = [shingles(t, hashes, size).astype("<u8").tobytes() for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(items=items)

    sets = texts.select("comp", "blocks", "block", "cls", "copies", "text").mapInPandas(
        to_items, "comp long, blocks long, block long, cls long, copies long, items binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sets.withColumn("x", other).select(
        "comp", "blocks", "block", "cls", "copies", "items",
        F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))
    checked = landed(spark, verify(dealt, num, den), "join-checked")
    links = checked.groupBy("cls").agg(F.sum("links").alias("links"), F.min("hub").alias("hub"),
                                       F.max("blocks").alias("blocks"))
    # a group in one block is settled there; the others meet across their blocks
    across = components(spark, checked.where("blocks > 1").select(
        F.col("cls").alias("a"), F.col("hub").alias("b")))
    links = links.join(across.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "cls", "links", F.when(F.col("blocks") > 1, F.coalesce("root", "cls"))
        .otherwise(F.col("hub")).alias("root"))
    roots = classes.select("cls", "copies", "copy_of", "first").join(links, "cls", "left").select(
        "cls", "copies", "copy_of", "first", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("root", "cls").alias("root"))
    roots = landed(spark, roots, "join-roots")
    named = roots.groupBy("root").agg(F.min("copy_of").alias("class_id"),
                                      F.sum("copies").alias("group_size"),
                                      F.min("first").alias("first"))
    by_class = roots.drop("first").join(named, "root").select(
        "cls", "class_id", "group_size", "copy_of", "first",
        (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"))
    joined = rows.select("doc_id", "rid", "cls", "n").join(by_class, "cls", "left")
    alone = F.col("n") == 0
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(alone, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
                  & (F.col("rid") == F.col("first.rid")))).alias("kept"), "rid")


def keep_one(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """The rows of ``df`` whose document stands first in its class, all columns kept.

    Rows that repeat id and text stay or go together; exact deduplication tells those apart.
    """
    kept = similar_documents(spark, df, id_col, text_col, **options).where("kept").select(
        F.col("doc_id").alias("kept_doc"), F.col("rid").alias("kept_rid"))
    # the row travels as a struct, so none of its columns can clash with ours
    keyed = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("this_doc"),
                      F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
                      .alias("this_rid"))
    return keyed.join(kept, (F.col("this_rid") == F.col("kept_rid"))
                      & F.col("this_doc").eqNullSafe(F.col("kept_doc")), "left_semi").select("row.*")
