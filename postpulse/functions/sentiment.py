"""Lexicon-based polarity and the 5-way sentiment class (survey N1-N3).

The per-row sentiment library of the original study is re-expressed as Spark
expressions: text -> lower-case letter tokens -> valence lookup -> sum ->
normalised compound score in [-1, 1] -> class.

A lexicon is given in one of two forms, and the form alone decides the plan:

* a dict (a few words, such as the default) becomes a literal map inside the
  projection: narrow, no shuffle;
* a table (token, valence) of any size is equi-joined with the exploded tokens and
  summed per text, whose digest brings the sum back to the rows; Spark chooses the joins
  from measured sizes.

Both give the same answer: a token listed more than once in a table counts with its
largest valence, and valences are rounded half up to four decimals.

Valences are summed as integers (valence * 10^4) so the sum is exact and does
not depend on the order in which a cluster adds the tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.session import spread

# ---- fixed values (must equal the original scoring rule) --------------------
# compound = s / sqrt(s^2 + ALPHA), rounded to 4 decimals
ALPHA = 15
# class 1 if compound > 0.6, 2 if > 0.25, 3 if > -0.25, 4 if > -0.6, else 5;
# a blank or missing text is class 10
CLASS_THRESHOLDS = (0.6, 0.25, -0.25, -0.6)
MISSING_TEXT_CLASS = 10
# -----------------------------------------------------------------------------

# ---- fixed values of the published rule-based scorer ------------------------
NEGATION_FACTOR = -0.74      # a negation among the three words before
CAPITALS_INCREMENT = 0.733   # a word in capitals in a text that is not all capitals
EXCLAMATION_INCREMENT = 0.292
MAX_EXCLAMATIONS = 4
BOOSTER = 0.293              # an intensifier before; its opposite for a damper
BOOSTER_REACH = (1.0, 0.95, 0.9)    # share of it one, two and three words before
QUESTION_INCREMENT, MAX_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
# -----------------------------------------------------------------------------

# Lexicon used by the registered queries and tests (FIXTURES.md, "lexicon").
DEFAULT_LEXICON = {"the": 1.0, "and": 0.7, "of": -1.0, "in": -0.8, "to": -0.9,
                   "la": 1.2, "der": -1.1}

TOKEN_SPLIT = "[^a-z]+"
VALENCE_SCALE = 10000


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), TOKEN_SPLIT)


def _scaled(v: float) -> int:
    return int(Decimal(repr(float(v))).scaleb(4).to_integral_value(ROUND_HALF_UP))


def lexicon_map(lexicon: dict[str, float]) -> Column:
    if not lexicon:
        return F.create_map().cast("map<string,bigint>")
    keys = F.array(*[F.lit(k) for k in lexicon])
    vals = F.array(*[F.lit(_scaled(v)).cast("long") for v in lexicon.values()])
    return F.map_from_arrays(keys, vals)


def valence_sum(text: Column, lexicon: dict[str, float]) -> Column:
    """Sum of token valences (as a double) using an in-expression map lookup."""
    m = lexicon_map(lexicon)
    scaled = F.aggregate(
        F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    return scaled / F.lit(float(VALENCE_SCALE))


def compound_from_sum(s: Column) -> Column:
    return F.round(s / F.sqrt(s * s + F.lit(float(ALPHA))), 4)


def sentiment_class(text: Column, compound: Column) -> Column:
    t1, t2, t3, t4 = CLASS_THRESHOLDS
    return (F.when(text.isNull() | (text == ""), F.lit(MISSING_TEXT_CLASS))
            .when(compound > t1, 1).when(compound > t2, 2)
            .when(compound > t3, 3).when(compound > t4, 4)
            .otherwise(5))


def lexicon_rows(lexicon: DataFrame) -> DataFrame:
    """(token, v): one row per token, the largest of its valences, as a whole number."""
    return lexicon.groupBy("token").agg(F.max("valence").alias("valence")).select(
        "token", F.round(F.col("valence").cast("decimal(20,10)") * VALENCE_SCALE).cast("long").alias("v"))


def score_texts(df: DataFrame, id_col: str, text_col: str, lexicon=None) -> DataFrame:
    """Add ``compound`` and ``sentiment_class`` to every row of ``df``.

    ``lexicon`` is a dict or a DataFrame (token string, valence double).
    """
    lexicon = DEFAULT_LEXICON if lexicon is None else lexicon
    text = F.col(text_col)
    if isinstance(lexicon, dict):
        # The lookup sum is an array lambda: give it its own projection so it is
        # evaluated once per row, not once per reference in the formula and class.
        summed = df.withColumn("_s", valence_sum(text, lexicon))
        compound = compound_from_sum(F.col("_s"))
        return (summed.withColumn("compound", F.when(text.isNull(), F.lit(None)).otherwise(compound))
                      .withColumn("sentiment_class", sentiment_class(text, F.col("compound")))
                      .drop("_s"))
    # the sum depends on the text alone, so its digest is the key: ids may repeat or be missing
    keyed = df.withColumn("_key", text_key(text))
    found = (keyed.select("_key", F.posexplode(tokens(text)).alias("_i", "token"))
             .join(lexicon_rows(lexicon), "token")
             .groupBy("_key", "_i").agg(F.max("v").alias("v")))      # equal texts count once
    sums = found.groupBy(F.col("_key").alias("_found")).agg(F.sum("v").alias("_v"))
    s = F.coalesce(F.col("_v"), F.lit(0)) / F.lit(float(VALENCE_SCALE))
    out = (keyed.join(sums, F.col("_key") == F.col("_found"), "left")
           .withColumn("compound", F.when(text.isNull(), F.lit(None)).otherwise(compound_from_sum(s)))
           .drop("_key", "_found", "_v"))
    return out.withColumn("sentiment_class", sentiment_class(text, F.col("compound")))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


WORD = "[\\p{L}']+"
#: Default word lists of the rules; all are arguments.
NEGATIONS = ("not", "no", "never", "none", "nothing", "nobody", "nowhere", "neither", "nor", "without",
             "cannot", "can't", "don't", "doesn't", "didn't", "won't", "wouldn't", "isn't", "aren't",
             "wasn't", "weren't", "shouldn't", "couldn't", "hasn't", "haven't")
BOOSTERS = {"very": 1, "really": 1, "so": 1, "extremely": 1, "absolutely": 1, "completely": 1,
            "totally": 1, "most": 1, "especially": 1, "slightly": -1, "barely": -1, "hardly": -1,
            "somewhat": -1, "partly": -1, "almost": -1}
CONTRASTS = ("but",)


@dataclass(frozen=True)
class Rules:
    """What the rule scorer knows beside single words.

    ``phrases`` are entries of two or three words (lower case, one blank between them) and marks
    without letters, such as emoticons; a few hundred at most, since they are part of the plan.
    """

    negations: tuple[str, ...] = NEGATIONS
    boosters: dict[str, int] = field(default_factory=lambda: dict(BOOSTERS))
    contrasts: tuple[str, ...] = CONTRASTS
    phrases: dict[str, float] = field(default_factory=dict)

    def marks(self) -> list[str]:
        return sorted((p for p in self.phrases if not any(map(str.isalpha, p))),
                      key=lambda p: (-len(p), p))

    def pattern(self) -> str:
        """Tokens: marks first, longest first, then words."""
        special = set("\\.^$*+?{}[]|()")
        return "|".join(["".join("\\" + c if c in special else c for c in m) for m in self.marks()]
                        + [WORD])

    def of_length(self, n: int) -> dict[str, float]:
        marks = set(self.marks())
        return {p: v for p, v in self.phrases.items()
                if (p in marks and n == 1) or (p not in marks and len(p.split(" ")) == n)}


def _gram(i: Column, n: int) -> Column:
    """The n tokens that end at place i (from 1), with blanks between; null at the start."""
    words = [F.element_at("_l", F.greatest(i - k, F.lit(1))) for k in range(n - 1, -1, -1)]
    return F.when(i >= n, F.concat_ws(" ", *words)) if n > 1 else words[0]


def _phrase(rules: Rules, i: Column) -> Column:
    """(i, k, v): words and valence of the longest phrase that ends at i, null if none does."""
    out = F.lit(None)
    for n in (1, 2, 3):
        known = rules.of_length(n)
        if known:
            at = F.try_element_at(lexicon_map(known), _gram(i, n))
            out = F.when(at.isNotNull(), F.struct(i.alias("i"), F.lit(n).alias("k"), at.alias("v"))
                         ).otherwise(out)
    return out.cast("struct<i:int,k:int,v:bigint>")


def _places(words: list[str]) -> Column:
    """Places of the tokens that are among the words."""
    return F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: (F.size("_l") > 0) & F.element_at(
        "_l", F.greatest(F.least(i, F.size("_l")), F.lit(1))).isin(words))


def _unit(rules: Rules, m: Column, at: Column) -> Column:
    """Valence of match number ``at`` in its context, in units, weighted by 1, 2 or 3 halves."""
    i = m["i"]
    first = i - m["k"] + 1
    v = m["v"].cast("double") / VALENCE_SCALE
    word = F.element_at("_w", i)
    loud = F.col("_mixed") & (F.upper(word) == word) & (F.lower(word) != word)
    v = v + F.signum(v) * F.when(loud, CAPITALS_INCREMENT).otherwise(0.0)
    back = lambda d: F.when(first > d, F.element_at("_l", F.greatest(first - d, F.lit(1))))
    signs = F.create_map(*[F.lit(x) for kv in rules.boosters.items() for x in kv])
    for d, damp in enumerate(BOOSTER_REACH, 1):
        boost = F.coalesce(F.try_element_at(signs, back(d)), F.lit(0)) if rules.boosters else F.lit(0)
        v = v + F.signum(v) * boost * (BOOSTER * damp)
        turned = F.coalesce(back(d).isin(list(rules.negations)), F.lit(False))
        if d == 1:       # "least", but not "at least" or "very least"
            turned = turned | (F.coalesce(back(1) == "least", F.lit(False))
                               & ~F.coalesce(back(2).isin("at", "very"), F.lit(False)))
        v = v * F.when(turned, NEGATION_FACTOR).otherwise(1.0)
    later = [F.try_element_at("_m", at + 1 + n) for n in (1, 2)]
    covered = F.lit(False)
    for x in later:       # a phrase that ends later and starts here or before
        covered = covered | F.coalesce(x["i"] - x["k"] < i, F.lit(False))
    weight = F.when(covered, 0).when(F.col("_but") == 0, 2).when(first < F.col("_but"), 1).otherwise(3)
    return F.floor(v * VALENCE_SCALE + 0.5).cast("long") * weight


def _with_matches(df: DataFrame, text: Column, cut, lexicon: DataFrame) -> DataFrame:
    """Adds ``_single``: (i, k, v) of the tokens that the lexicon table lists, null if none."""
    keyed = spread(df).withColumn("_key", text_key(text))
    found = (cut(keyed).select("_key", F.posexplode("_l").alias("_i", "token"))
             .join(lexicon_rows(lexicon), "token")
             .groupBy("_key", "_i").agg(F.max("v").alias("v")))      # equal texts count once
    found = found.groupBy(F.col("_key").alias("_found")).agg(F.collect_list(
        F.struct((F.col("_i") + 1).alias("i"), F.lit(1).alias("k"), "v")).alias("_single"))
    return keyed.join(found, F.col("_key") == F.col("_found"), "left").drop("_key", "_found")


def rule_scores(df: DataFrame, text_col: str, lexicon, rules: Rules | None = None) -> DataFrame:
    """Adds ``compound`` and ``sentiment_class``: the word sum with its context rules.

    Tokens are words of letters of any script and apostrophes, and the marks among the phrases.
    The longest phrase that ends at a token replaces the words (and phrases) it covers. A valence
    moves away from zero by CAPITALS_INCREMENT if its token stands in capitals in a mixed text and
    by BOOSTER for each intensifier among the three words before (towards zero for a damper; less
    for farther ones), and each negation among them multiplies it by NEGATION_FACTOR, nearest word
    first. With a contrast word ("but"), what stands before the first one counts half and the rest
    one and a half times. Exclamation marks (four at most) and question marks (from two) add to the
    sum's size. Every valence is rounded to four decimals and added as a whole number.

    ``lexicon`` is a dict of single words, then the job is one narrow projection; or a table
    (token, valence) of any size, joined with the exploded tokens, whose matches come back to the
    rows by the digest of the text. Ids play no part: rows may repeat or have none. Rows are dealt
    over all tasks first, and texts meet their matches before they are cut into tokens.
    """
    rules = rules or Rules()
    text = F.col(text_col)
    caps = lambda w: (F.upper(w) == w) & (F.lower(w) != w)

    def cut(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_w", F.regexp_extract_all(text, F.lit(rules.pattern()), F.lit(0))
                               ).withColumn("_l", F.transform("_w", F.lower))

    narrow = isinstance(lexicon, dict)
    out = cut(df) if narrow else cut(_with_matches(df, text, cut, lexicon))
    out = out.withColumn("_mixed", F.exists("_w", caps) & ~F.forall("_w", caps))
    spots = [F.nullif(F.array_position("_l", c), F.lit(0)) for c in rules.contrasts]
    first = F.least(*spots) if len(spots) > 1 else spots[0] if spots else F.lit(None)
    out = out.withColumn("_but", F.coalesce(first, F.lit(0)).cast("int"))
    # only places that may end a match are looked at any further
    ends = sorted({p if n == 1 else p.split(" ")[-1] for n in (1, 2, 3) for p in rules.of_length(n)})
    known = lambda m: m.isNotNull()
    if narrow:
        words = lexicon_map(lexicon)
        single = lambda i: F.struct(
            i.alias("i"), F.lit(1).alias("k"), F.try_element_at(words, F.element_at("_l", i)).alias("v"))
        found = lambda i: F.when(F.element_at("_l", i).isin(list(lexicon)), single(i))
        out = out.withColumn("_m", F.filter(F.transform(
            _places(sorted({*ends, *lexicon})), lambda i: F.coalesce(
                F.when(F.element_at("_l", i).isin(ends), _phrase(rules, i)), found(i))
            if ends else found(i)), known))
    else:
        matches = F.coalesce("_single", F.array().cast("array<struct<i:int,k:int,v:bigint>>"))
        if ends:
            matches = F.concat(matches, F.filter(F.transform(
                _places(ends), lambda i: _phrase(rules, i)), known))
        # by place; a mark that the lexicon lists too counts with its phrase's valence, last here
        order = lambda a, b: F.when(a["i"] != b["i"], a["i"] - b["i"]).otherwise(a["k"] - b["k"])
        out = out.withColumn("_all", F.array_sort(matches, order))
        out = out.withColumn("_m", F.filter("_all", lambda m, j: F.coalesce(
            F.try_element_at("_all", j + 2)["i"] != m["i"], F.lit(True)))).drop("_single", "_all")
    units = F.transform("_m", lambda m, j: _unit(rules, m, j))
    halves = F.aggregate(units, F.lit(0).cast("long"), lambda acc, u: acc + u)
    out = out.withColumn("_s", halves / F.lit(2.0 * VALENCE_SCALE))
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    asked = F.when(count("?") > MAX_QUESTIONS, MANY_QUESTIONS).when(
        count("?") > 1, count("?") * QUESTION_INCREMENT).otherwise(0.0)
    marks = F.least(count("!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION_INCREMENT + asked
    out = out.withColumn("_s", F.col("_s") + F.signum("_s") * marks)
    out = out.withColumn("compound", F.when(text.isNull(), F.lit(None)).otherwise(
        compound_from_sum(F.col("_s")))).drop("_w", "_l", "_mixed", "_but", "_m", "_s")
    return out.withColumn("sentiment_class", sentiment_class(text, F.col("compound")))
