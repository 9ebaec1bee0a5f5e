"""Language identification by prediction with partial matching (PPM, escape method C).

Each language has a variable-order context tree over bytes, up to ``ORDER`` bytes deep.
A symbol seen in its context codes with n / (t + d), t symbols and d distinct ones seen
there; an unseen one pays the escape d / (t + d) and goes on in the context shortened
by its oldest byte; below the empty context all 256 bytes are alike. A text's score per
language is the exact code length of all its bytes under frozen counts.

The trees are fitted on at most ``max_docs`` documents per language (smallest hashes of
the id); counts come from a grouped aggregate. For scoring, the code lengths of every
known context and symbol are put into arrays once, so a text costs one hash lookup a
byte, whatever the number of languages.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so
is everything when no language was learned; ties go to the first name; rows without a
language teach nothing; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.llm.common import id_and_text, map_frames

ORDER = 3
UNDETERMINED = "und"
SLICE = 1 << 20       # bytes scored at a time
HASH_BITS = 21
BROADCAST_ROWS = 500_000
SALTS = 64


def grams(data: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes up to each place as one number; zeros before the start."""
    padded = np.concatenate([np.zeros(ORDER, np.uint8), data]).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for k in range(ORDER + 1):
        out |= padded[k:k + len(data)] << np.uint32(8 * (ORDER - k))
    return out


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def count_contexts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text) rows; gram is a full context and its symbol."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, texts in pdf.groupby("lang")["text"]:
                found, n = np.unique(np.concatenate([grams(as_bytes(t)) for t in texts]),
                                     return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "n": n})

    return (rows.where("lang is not null").mapInPandas(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def training_rows(docs: DataFrame, max_docs: int) -> DataFrame:
    """(lang, text) of at most ``max_docs`` documents per language."""
    ids = docs.where("lang is not null").select(
        "lang", "doc_id", F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(SALTS)).alias("salt")
    ).distinct()        # rows that repeat an id are one, added up before the shuffle
    # first within salted parts of a language, so a hot one reaches its task as the best of each
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_docs)
    ids = ids.select("lang", "doc_id").distinct()
    # languages x max_docs rows at most: below BROADCAST_ROWS the texts need no shuffle
    langs = docs.where("lang is not null").select("lang").distinct().count()
    if langs * max_docs <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, ["lang", "doc_id"], "left_semi")
    return rows.groupBy("lang", "doc_id").agg(      # the text with the smallest hash
        F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")


@dataclass
class Trees:
    """Frozen code lengths in bits, one column per language."""

    langs: list[str]
    known: np.ndarray         # grams any language has seen, ascending
    bits: np.ndarray          # [gram, language]
    contexts: np.ndarray      # full contexts any language has seen, ascending
    escape: np.ndarray        # [context, language]
    shorter: list             # per lower order: (known, bits, contexts, escape)
    table: np.ndarray         # hash -> place in known

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each symbol in its context, [place, language]."""
        place = self.table[hashed(gram)]
        miss = np.flatnonzero(self.known[place] != gram)
        out = self.bits[place]
        if len(miss):
            out[miss] = self._search(gram[miss])
        return out

    def _search(self, gram: np.ndarray) -> np.ndarray:
        levels = [(self.known, self.bits, self.contexts, self.escape), *self.shorter]
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        open_ = np.arange(len(gram))
        for k, (known, bits, contexts, escape) in enumerate(levels):
            mask = np.uint32((1 << 8 * (ORDER + 1 - k)) - 1)
            g = gram[open_] & mask
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = known[at] == g
            out[open_[hit]] += bits[at[hit]]
            open_, g = open_[~hit], g[~hit]
            if not len(open_):
                return out
            c = g >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            seen = contexts[at] == c
            out[open_[seen]] += escape[at[seen]]
        out[open_] += np.float32(8.0)
        return out

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each whole text, [text, language]."""
        total = np.zeros((len(texts), len(self.langs)))
        pending, owners, size = [], [], 0

        def flush() -> None:
            nonlocal pending, owners, size
            if size:
                starts = np.cumsum([0] + [len(p) for p in pending[:-1]])
                np.add.at(total, owners, np.add.reduceat(
                    self.lengths(np.concatenate(pending)), starts, axis=0, dtype=np.float64))
            pending, owners, size = [], [], 0

        for i, text in enumerate(texts):
            g = grams(as_bytes(text))
            for lo in range(0, len(g), SLICE):
                pending.append(g[lo:lo + SLICE])
                owners.append(i)
                size += len(pending[-1])
                if size >= SLICE:
                    flush()
        flush()
        return total


def hashed(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def freeze(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
    """Code-length arrays from per-language (grams, counts)."""
    langs = sorted(counts)
    # per order, longest first: each language's (gram, n); shorter ones by summing out the
    # oldest byte
    per_order = []
    level = {x: (g.astype(np.uint32), n.astype(np.float64)) for x, (g, n) in counts.items()}
    for k in range(ORDER + 1):
        per_order.append(level)
        mask = np.uint32((1 << 8 * (ORDER - k)) - 1)
        nxt = {}
        for x, (g, n) in level.items():
            u, inv = np.unique(g & mask, return_inverse=True)
            nxt[x] = (u, np.bincount(inv, weights=n))
        level = nxt
    levels: list = []
    for k in range(ORDER, -1, -1):                       # shortest contexts first
        own = per_order[k]
        known = np.unique(np.concatenate([g for g, _ in own.values()]))
        contexts = np.unique(known >> np.uint32(8))
        bits = np.zeros((len(known), len(langs)), np.float32)
        escape = np.zeros((len(contexts), len(langs)), np.float32)
        for j, x in enumerate(langs):
            g, n = own[x]
            c, inv = np.unique(g >> np.uint32(8), return_inverse=True)
            t, d = np.bincount(inv, weights=n), np.bincount(inv).astype(np.float64)
            escape[np.searchsorted(contexts, c), j] = np.log2((t + d) / d)
            # unseen here: the escape (none in an unseen context), then the shorter context
            bits[:, j] = escape[np.searchsorted(contexts, known >> np.uint32(8)), j]
            if levels:
                low, low_bits = levels[0][0], levels[0][1]
                mask = np.uint32((1 << 8 * (ORDER - k)) - 1)
                bits[:, j] += low_bits[np.searchsorted(low, known & mask), j]
            else:
                bits[:, j] += 8.0
            bits[np.searchsorted(known, g), j] = np.log2((t + d)[inv] / n)
        levels.insert(0, (known, bits, contexts, escape))
    known, bits, contexts, escape = levels[0]
    table = np.zeros(1 << HASH_BITS, np.int32)
    table[hashed(known)] = np.arange(len(known), dtype=np.int32)
    return Trees(langs, known, bits, contexts, escape, levels[1:], table)


def fit(docs: DataFrame, max_docs: int = 2500) -> Trees | None:
    """Trees of (doc_id, lang, text) rows; None when no row has a language and text.

    What reaches the driver is bounded by the bytes of ``max_docs`` documents per language.
    """
    got = count_contexts(training_rows(docs, max_docs)).toPandas()
    if not len(got):
        return None
    return freeze({x: (p["gram"].to_numpy(), p["n"].to_numpy()) for x, p in got.groupby("lang")})


def predict(df: DataFrame, trees: Trees | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of the best language under equal priors)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
            langs, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if trees is not None and len(texts):
                bits = trees.code_lengths(texts)
                best = bits.argmin(axis=1)
                # 2 ** -1000 is nothing already
                gap = np.minimum(bits - bits[np.arange(len(best)), best][:, None], 1000)
                langs = np.where(lettered, np.array(trees.langs, object)[best], UNDETERMINED)
                score = np.where(lettered, 1.0 / np.exp2(-gap).sum(axis=1), 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": langs,
                                "score": score})

    return map_frames(id_and_text(df, id_col, text_col), run, "doc_id long, lang_pred string, score double")
