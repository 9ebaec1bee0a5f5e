"""Quality rules as a short-circuit cascade.

Base statistics are computed for every document. The rules then run in the order
of rejections per second, both measured on a sample of the same input; a document
leaves the cascade at the first rule that rejects it. All rules are conjunctive,
so the order changes only the cost, never the verdict.

Defined results: a null text has no words; no words means ``base_failed``; repeated
rows and repeated ids each give their own row; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import id_and_text, map_frames

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"


class Doc:
    """One text; each statistic is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self.word_chars = len(self.text) - sum(map(self.text.count, BLANK_CHARS))
        self.n_symbols = sum(map(self.text.count, SYMBOLS))
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)
        self.base_failed = self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more, its first place included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered[i:i + 3] = b"\1\1\1"
    return sum(covered)


# Each rule is true when it REJECTS. Integer comparisons, so SQL gives the same verdicts.
def short_words(d: Doc) -> bool:
    """Mean word length below 3 characters."""
    return d.word_chars < 3 * d.n_words


def long_words(d: Doc) -> bool:
    """Mean word length above 12 characters."""
    return d.word_chars > 12 * d.n_words


def symbol_heavy(d: Doc) -> bool:
    """More than one symbol for ten words."""
    return 10 * d.n_symbols > d.n_words


def repeated_lines(d: Doc) -> bool:
    """Three lines or more, and over 30 % of all lines, repeat an earlier line."""
    return d.n_dup_lines >= 3 and 10 * d.n_dup_lines > 3 * d.n_lines


def shouting(d: Doc) -> bool:
    """More than one exclamation mark for five words."""
    return 5 * d.text.count("!") > d.n_words


def capitals(d: Doc) -> bool:
    """More than 30 % of the word characters are ASCII capitals."""
    return 10 * len(d.raw.translate(None, NOT_CAPITAL)) > 3 * d.word_chars


def digits(d: Doc) -> bool:
    """More than 30 % of the word characters are ASCII digits."""
    return 10 * len(d.raw.translate(None, NOT_DIGIT)) > 3 * d.word_chars


def few_letters(d: Doc) -> bool:
    """Fewer than 70 % of the words hold an ASCII letter or a non-ASCII character."""
    return 10 * sum(1 for w in d.words if w.translate(None, NOT_LETTER)) < 7 * d.n_words


NOT_CAPITAL = bytes(i for i in range(256) if not 65 <= i <= 90)
NOT_DIGIT = bytes(i for i in range(256) if not 48 <= i <= 57)
NOT_LETTER = bytes(i for i in range(128) if not chr(i).isalpha())
RULES = (short_words, long_words, symbol_heavy, repeated_lines, shouting, capitals, digits,
         few_letters)
BY_NAME = {r.__name__: r for r in RULES}


def rule_costs(docs: DataFrame, sample_rows: int = 2000, rules=RULES) -> DataFrame:
    """Per rule: rows seen, rows rejected and seconds, over about ``sample_rows`` rows."""
    names = [r.__name__ for r in rules]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            docs_ = [d for d in map(Doc, pdf["text"]) if not d.base_failed]
            out = []
            for n in names:
                began = time.perf_counter()
                hits = sum(map(BY_NAME[n], docs_))
                out.append((n, len(docs_), hits, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["rule", "seen", "rejected", "seconds"])

    # one row per row group's footer answers the count; no text is shuffled for the sample
    fraction = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select("text").sample(fraction, seed=5)
    return (sample.mapInPandas(measure, "rule string, seen long, rejected long, seconds double")
            .groupBy("rule").agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"),
                                 F.sum("seconds").alias("seconds")))


def plan_cascade(docs: DataFrame, sample_rows: int = 2000, rules=RULES) -> list[str]:
    """Rule names by rejections per second, best first (ties by name).

    One row per rule comes to the driver. A rule the sample says nothing about goes last.
    """
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9)
            for r in rule_costs(docs, sample_rows, rules).collect()}
    return sorted((r.__name__ for r in rules), key=lambda n: (-rate.get(n, 0.0), n))


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """One row per input row: base statistics, verdict, and the rule that rejected it."""
    docs = id_and_text(df, id_col, text_col)
    order = order or plan_cascade(docs, sample_rows)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cascade = [(n, BY_NAME[n]) for n in order]
        for pdf in frames:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                d = Doc(text)
                by = "base" if d.base_failed else next((n for n, r in cascade if r(d)), None)
                out.append((doc_id, d.n_words, d.word_chars,
                            d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed,
                            by is None, by))
            yield pd.DataFrame(out, columns=COLUMNS)

    return map_frames(docs, judge, SCHEMA)


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
