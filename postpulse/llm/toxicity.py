"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions over the presence
of selected words and word stems; each model also sees the probabilities of the
categories before it. In training those probabilities are out of fold: the rows of a
fold get them from a model that never saw the fold.

The fit reads at most ``max_train`` labelled rows (the smallest hashes of the id, so the
choice does not depend on partitioning); scoring is one narrow pass over every text.

Defined results: a null or empty text has no features and gets the chain's base rates;
a labelled row counts only if no category label of it is null, repeated labels of one id
count once (their maximum); a category with one class only, or no labelled rows at all,
is predicted as that class's rate (0 without rows); repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import id_and_text, landed, map_frames

LETTERS = re.compile(r"[^\W\d_]+")
STEM = 4


def features_of(text: str | None) -> set[str]:
    """Distinct lower-case words, and ``word*`` stems of the longer ones."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Link:
    """One linear model of the chain."""

    category: str
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)

    def probability(self, present: set[str], before: list[float]) -> float:
        z = self.bias + sum(w * p for w, p in zip(self.earlier, before))
        small, large = ((present, self.weights) if len(present) < len(self.weights)
                        else (self.weights, present))
        z += sum(self.weights[f] for f in small if f in large)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


@dataclass
class Chain:
    links: list[Link]
    threshold: float

    def probabilities(self, text: str | None) -> list[float]:
        present, out = features_of(text), []
        for link in self.links:
            out.append(link.probability(present, out))
        return out


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str],
                  max_train: int) -> DataFrame:
    """(doc_id, text, fold, one 0/1 column per category); bounded by ``max_train`` labels."""
    agreed = labels.groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c)
                                            for c in categories])
    agreed = agreed.where(" and ".join(f"{c} is not null" for c in ["doc_id", *categories]))
    order = F.xxhash64(F.col("doc_id").cast("long"))
    sample = agreed.orderBy(order, "doc_id").limit(max_train)  # the bound of the broadcast
    # rows that repeat an id count once: the text with the smallest hash
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", *categories).agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    return rows.withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(1 << 20)))


def vocabulary(rows: DataFrame, categories: list[str], size: int, least: int = 5) -> list[str]:
    """Features that tell a category's classes apart best: ``size`` per category at most."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seen: dict[str, Counter] = {c: Counter() for c in ["", *categories]}
            for i, text in enumerate(pdf["text"]):
                found = features_of(text)
                seen[""].update(found)
                for c in categories:
                    if pdf[c].iat[i] == 1.0:
                        seen[c].update(found)
            yield pd.DataFrame({"feature": list(seen[""]), "df": list(seen[""].values()),
                                **{f"in_{c}": [seen[c][f] for f in seen[""]] for c in categories}})

    schema = "feature string, df long, " + ", ".join(f"in_{c} long" for c in categories)
    counts = rows.mapInPandas(count, schema).groupBy("feature").agg(
        F.sum("df").alias("df"), *[F.sum(f"in_{c}").alias(f"in_{c}") for c in categories])
    counts = counts.where(F.col("df") >= least).persist()
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    chosen: set[str] = set()
    for c in categories:
        pos = float(total[c] or 0)
        neg = total["n"] - pos
        if not pos or not neg:
            continue
        p, q = F.col(f"in_{c}") / pos, (F.col("df") - F.col(f"in_{c}")) / neg
        both = F.col("df") / float(total["n"])
        z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / pos + 1 / neg) + F.lit(1e-12))
        best = counts.orderBy(z.desc(), "feature").limit(size)
        chosen.update(r["feature"] for r in best.select("feature").collect())
    counts.unpersist()
    return sorted(chosen)


def fit_chain(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: list[str],
              max_train: int = 20_000, vocabulary_size: int = 300, folds: int = 5,
              reg: float = 0.002) -> Chain:
    """Fit the chain in the order of ``categories``; the last one decides the threshold."""
    rows = landed(spark, training_rows(docs, labels, categories, max_train), "toxicity-train")
    rows = rows.withColumn("fold", F.col("fold") % folds)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    n = totals["n"]
    words = vocabulary(rows, categories, vocabulary_size) if n else []
    if not words:
        rate = [(totals[c] or 0) / n if n else 0.0 for c in categories]
        return Chain([Link(c, _logit(r)) for c, r in zip(categories, rate)], 0.5)
    index = {w: i for i, w in enumerate(words)}

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = pdf.drop(columns="text")
            got["hits"] = [sorted(index[f] for f in features_of(t) if f in index)
                           for t in pdf["text"]]
            yield got

    schema = ("doc_id long, " + ", ".join(f"{c} double" for c in categories)
              + ", fold long, hits array<int>")
    train = landed(spark, rows.select("doc_id", *categories, "fold", "text")
                   .mapInPandas(hits, schema), "toxicity-train-hits")
    links: list[Link] = []
    earlier: list[str] = []
    for c in categories:
        models = {r["model"]: r for r in fit_models(train, c, earlier, len(words), folds, reg).collect()}
        full = models[folds]
        links.append(Link(c, full["bias"], {w: b for w, b in zip(words, full["weights"]) if b},
                          list(full["earlier"])))
        train = landed(spark, out_of_fold(train, c, list(earlier), models), "toxicity-chain")
        earlier.append(f"p_{c}")
    threshold = best_threshold(train, earlier[-1], categories[-1])
    return Chain(links, threshold)


def fit_models(train: DataFrame, category: str, earlier: list[str], n_words: int, folds: int,
               reg: float) -> DataFrame:
    """One row per model: model k leaves fold k out, model ``folds`` sees every row.

    Each model is one group of at most ``max_train`` rows.
    """
    models = F.array_except(F.sequence(F.lit(0), F.lit(folds)), F.array(F.col("fold").cast("int")))
    dealt = train.select(F.explode(models).alias("model"), F.col(category).alias("y"), "hits",
                         F.array(*earlier).cast("array<double>").alias("before"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), 1 + len(earlier) + n_words), dtype=np.float32)
        x[:, 0] = 1.0
        if earlier:
            x[:, 1:1 + len(earlier)] = np.array(pdf["before"].tolist(), dtype=np.float32)
        for i, found in enumerate(pdf["hits"]):
            x[i, 1 + len(earlier) + np.asarray(found, dtype=np.int64)] = 1.0
        beta = logistic(x, pdf["y"].to_numpy(np.float32), reg)
        return pd.DataFrame({"model": [int(pdf["model"].iat[0])], "bias": [float(beta[0])],
                             "earlier": [beta[1:1 + len(earlier)].tolist()],
                             "weights": [beta[1 + len(earlier):].tolist()]})

    return dealt.groupBy("model").applyInPandas(
        fit, "model int, bias double, earlier array<double>, weights array<double>")


def logistic(x: np.ndarray, y: np.ndarray, reg: float, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the bias column is not shrunk."""
    n, m = x.shape
    beta = np.zeros(m)
    shrink = np.full(m, reg * n)
    shrink[0] = 1e-6 * n
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta.astype(np.float32), -30, 30)))
        grad = x.T @ (p - y) + shrink * beta
        weight = np.maximum(p * (1 - p), 1e-5).astype(np.float32)
        hessian = np.diag(shrink)
        for lo in range(0, n, 2048):        # no second copy of all rows
            part = x[lo:lo + 2048]
            hessian += (part * weight[lo:lo + 2048, None]).T @ part
        step = np.linalg.solve(hessian.astype(np.float64), grad)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta


def out_of_fold(train: DataFrame, category: str, earlier: list[str], models: dict) -> DataFrame:
    """Adds p_<category>, each row scored by the model that left its fold out."""
    plain = {k: (r["bias"], np.array(r["weights"]), np.array(r["earlier"])) for k, r in models.items()}
    everything = max(plain)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i, (fold, found) in enumerate(zip(pdf["fold"], pdf["hits"])):
                bias, weights, chain = plain.get(int(fold), plain[everything])
                z = bias + weights[np.asarray(found, dtype=np.int64)].sum()
                z += sum(b * pdf[e].iat[i] for b, e in zip(chain, earlier))
                out.append(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
            yield pdf.assign(**{f"p_{category}": out})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema)
    return train.mapInPandas(predict, f"{schema}, p_{category} double")


def best_threshold(rows: DataFrame, p: str, label: str) -> float:
    """The out-of-fold cut with the best F0.5 (a clean text lost weighs more than a toxic one
    kept), in steps of 0.01; ties go to the middle one."""
    got = {r["step"]: (r["n"], r["pos"]) for r in rows.groupBy(
        F.least(F.floor(F.col(p) * 100), F.lit(99)).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).collect()}
    total, scores, n, pos = sum(x[1] for x in got.values()), [], 0, 0.0
    for step in range(99, 0, -1):
        n, pos = n + got.get(step, (0, 0))[0], pos + got.get(step, (0, 0))[1]
        scores.append((1.25 * pos / (n + 0.25 * total) if n + total else 0.0, step))
    top = max(s for s, _ in scores)
    best = [step for s, step in scores if s == top]
    return best[len(best) // 2] / 100 if top else 0.5


def _logit(rate: float) -> float:
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    return math.log(rate / (1 - rate))


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, p_<category> for each link, flagged."""
    names = [f"p_{link.category}" for link in chain.links]

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = [chain.probabilities(t) for t in pdf["text"]]
            got = pd.DataFrame(p, columns=names, index=pdf.index).astype("float64")
            got.insert(0, "doc_id", pdf["doc_id"])
            got["flagged"] = got[names[-1]] >= chain.threshold
            yield got

    schema = "doc_id long, " + ", ".join(f"{x} double" for x in names) + ", flagged boolean"
    return map_frames(id_and_text(df, id_col, text_col), predict, schema)


def reject(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows whose text is not flagged, all columns kept."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([chain.probabilities(t)[-1] < chain.threshold for t in texts], dtype=bool)

    return df.where(clean(F.col(text_col)))       # other columns stay in the JVM
