"""Bagged multiway regression trees as DataFrame jobs (survey T1-T10, A7, A8, J3, S12).

The original grows each tree by recursion inside one task and has every task
hold the whole test file. Here all trees of all samples grow together, one
level per iteration, with grouped aggregates:

1. rows -> shard (md5 of id, ``max_split + 1`` shards) -> samples
   (``shard_sample``: ``sample_number`` samples of ``sample_size`` rows per
   shard, or the whole shard when it is smaller) -> tree id.
2. Samples are collapsed to *cells*: one row per (tree, attribute tuple) with
   n, sum y, sum y^2 (y shifted by the training mean). Split choice needs only
   these sufficient statistics, so a repeated tuple costs one row however many
   copies it has.
3. Per level, for every active (tree, node):
     node stats                     groupBy(tree, node)
     branch stats per attribute     explode(attr, value) -> groupBy(tree, node, attr, value)
     weighted error per attribute   sum of branch SSE / node n
     best attribute                 min(struct(relative error, attr position))
   Categorical attributes branch on every value; numeric ones at the node
   mean (< left, else right). A node is a leaf when it has at most one row,
   zero error, or no attribute with two or more branches. Cells then move to
   their child node. The moved cells are checkpointed to the shared folder
   each level, so lineage stays one level long and a lost executor
   recomputes at most one level.
4. Prediction walks groups of test tuples through every tree, level by level:
   tuples that agree on the attributes of a path are one row (``leaf_groups``).
   An unseen category follows the child of the node's smallest value. Leaves are
   added up over the trees before they meet the tuples, and tuples the rows.

Every tree has equal weight in the ensemble mean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.operators.sampling import SAMPLE_SEED, SHARD_SEED, shard_of, shard_sample

# ---- fixed values: defaults of the original job's options --------------------
MAX_SPLIT_NUMBER = 10
SAMPLE_NUMBER = 1000
SAMPLE_SIZE = 1_000_000
# a branch with at most this many rows becomes a leaf holding its mean
MIN_RECORD = 1
# ------------------------------------------------------------------------------

ROOT = ""
VALUE, MISSING = "v", "z"   # a category's branch is VALUE + category; a missing one's is MISSING
REL_DIGITS = 9          # errors are compared after rounding err / node_mse to 9 digits
TREE_SALTS = 16         # tasks that share the trees of one combination of values
ZERO_ERROR = 1e-12      # node mse below this share of its mean square of (y - shift) is zero


@dataclass(frozen=True)
class Attr:
    name: str
    kind: str = "C"     # 'C' categorical (multiway) or 'N' numeric (split at the node mean)


def sample_trees(rows: DataFrame, id_col: str, max_split: int = MAX_SPLIT_NUMBER,
                 number: int = SAMPLE_NUMBER, size: int = SAMPLE_SIZE,
                 shard_seed=SHARD_SEED, sample_seed=SAMPLE_SEED) -> DataFrame:
    """Rows with a ``tree`` column: one per sample a row is drawn into.

    A row's samples follow from its own keys and the samples' cuts, so these rows exist within
    their task only: ``to_cells`` adds them up there, and what is shuffled are cells.
    """
    sharded = rows.withColumn("shard", shard_of(F.col(id_col), max_split, shard_seed))
    s = shard_sample(sharded, id_col, "shard", number, size, sample_seed)
    return s.withColumn("tree", (F.col("shard") * F.lit(number) + F.col("rep")).cast("long"))


def target_shift(rows: DataFrame, target: str) -> float:
    """Mean target of the training rows (one scalar read on the driver).

    Cells hold sums of y - shift: with the shift near the data's mean,
    sum(y^2) no longer dwarfs the spread, so error sums keep their digits even
    for targets with a large mean and a small variance.
    """
    v = rows.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return float(v) if v is not None else 0.0


def to_cells(samples: DataFrame, attrs: list[Attr], target: str, shift: float = 0.0) -> DataFrame:
    y = F.col(target).cast("double") - F.lit(float(shift))
    return samples.groupBy("tree", *[a.name for a in attrs]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2"))


def _mean_col(i: int) -> str:
    return f"_mean{i}"


def node_stats(active: DataFrame, attrs: list[Attr]) -> DataFrame:
    """(tree, node): N, mean, mse and the mean of every numeric attribute."""
    aggs = [F.sum("n").alias("N"), F.sum("s1").alias("S1"), F.sum("s2").alias("S2")]
    for i, a in enumerate(attrs):
        if a.kind == "N":
            # over the rows that have the number
            held = F.when(F.col(a.name).isNotNull(), F.col("n"))
            aggs.append((F.sum(F.col(a.name) * F.col("n")) / F.sum(held)).alias(_mean_col(i)))
    st = active.groupBy("tree", "node").agg(*aggs)
    mean = F.col("S1") / F.col("N")
    return (st.withColumn("mean", mean)
              .withColumn("mse", F.greatest(F.col("S2") / F.col("N") - mean * mean, F.lit(0.0))))


def _category(name: str) -> Column:
    """A categorical value as branch text; a missing value is a branch of its own, after all
    others and equal to none of them."""
    return F.coalesce(F.concat(F.lit(VALUE), F.col(name).cast("string")), F.lit(MISSING))


def _branch_value(a: Attr, mean_col: Column | None) -> Column:
    """Branch of a row: its category, or 'L'/'R' against the node mean (a missing
    number goes right, like a value that is not below the mean)."""
    if a.kind == "N":
        return F.when(F.col(a.name) < mean_col, F.lit("L")).otherwise(F.lit("R"))
    return _category(a.name)


def branch_stats(active: DataFrame, stats: DataFrame, attrs: list[Attr]) -> DataFrame:
    """(tree, node, attr_pos, value): n, s1, s2, sse for every attribute."""
    numeric = [i for i, a in enumerate(attrs) if a.kind == "N"]
    src = active
    if numeric:
        src = active.join(stats.select("tree", "node", *[_mean_col(i) for i in numeric]),
                          ["tree", "node"])
    pairs = F.array(*[
        F.struct(F.lit(i).alias("attr_pos"),
                 _branch_value(a, F.col(_mean_col(i)) if a.kind == "N" else None).alias("value"))
        for i, a in enumerate(attrs)])
    ex = src.select("tree", "node", "n", "s1", "s2", F.explode(pairs).alias("b"))
    br = ex.groupBy("tree", "node", F.col("b.attr_pos").alias("attr_pos"),
                    F.col("b.value").alias("value")).agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    return br.withColumn("sse", F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"),
                                           F.lit(0.0)))


def best_splits(branches: DataFrame, stats: DataFrame) -> DataFrame:
    """(tree, node) -> attr_pos, err: lowest size-weighted error, first attribute on ties (T4).

    Attributes with a single branch at the node are not candidates.
    """
    per_attr = branches.groupBy("tree", "node", "attr_pos").agg(
        F.count(F.lit(1)).alias("k"), F.sum("sse").alias("SSE"), F.min("value").alias("vmin"))
    splittable = stats.filter(_splittable()).select("tree", "node", "N", "mse")
    cand = (per_attr.filter(F.col("k") >= 2).join(splittable, ["tree", "node"])
            .withColumn("err", F.col("SSE") / F.col("N"))
            .withColumn("key", F.round(F.col("err") / F.col("mse"), REL_DIGITS)))
    best = cand.groupBy("tree", "node").agg(F.min(F.struct("key", "attr_pos", "err", "vmin")).alias("b"))
    return best.select("tree", "node", F.col("b.attr_pos").alias("attr_pos"), F.col("b.err").alias("err"),
                       F.col("b.vmin").alias("vmin"))


def _child(node: Column, attr_pos: Column, value: Column) -> Column:
    """Id of the child reached from ``node`` by ``attr_pos`` = ``value``.

    A digest of parent id, position and value: parent ids have a fixed length and positions
    are digits, so different branches give different texts whatever the value holds.
    """
    return F.md5(F.concat(node, F.lit("|"), attr_pos.cast("string"), F.lit("|"), value))


def _splittable() -> Column:
    return (F.col("N") > MIN_RECORD) & (F.col("mse") > F.lit(ZERO_ERROR) * F.col("S2") / F.col("N"))


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder.

    Writing a checkpoint runs the plan a second time unless it is persisted,
    so persist for the duration of the write and drop the copy afterwards.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


@dataclass
class BaggedModel:
    nodes: DataFrame   # tree, node, depth, n, prediction, is_leaf, attr_pos, split_cond, default_child
    edges: DataFrame   # tree, node, value, child
    attrs: list[Attr]
    trees: DataFrame   # tree
    shift: float = 0.0  # added back to every node mean


def fit_cells(cells: DataFrame, attrs: list[Attr], max_depth: int | None = None,
              shift: float = 0.0) -> BaggedModel:
    """Grow every tree of ``cells`` level by level."""
    from postpulse.session import shared_dir
    shared_dir(cells.sparkSession)
    names = [a.name for a in attrs]
    active = _checkpoint(cells.withColumn("node", F.lit(ROOT)))
    # Per-level tables are one level deep (they read this level's checkpointed
    # `active`), so they are only persisted; the loop state is checkpointed.
    held = []
    try:
        return _grow(cells, active, attrs, names, max_depth, shift, held)
    finally:
        for h in held:
            h.unpersist()


def _grow(cells, active, attrs, names, max_depth, shift, held) -> BaggedModel:
    node_parts, edge_parts = [], []
    depth = 0
    while True:
        stats = node_stats(active, attrs)
        final = max_depth is not None and depth >= max_depth
        if final:
            best = stats.select("tree", "node", F.lit(None).cast("int").alias("attr_pos"),
                                F.lit(None).cast("double").alias("err"),
                                F.lit(None).cast("string").alias("vmin")).limit(0)
            branches = None
        else:
            branches = branch_stats(active, stats, attrs).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(branches)
            best = best_splits(branches, stats)
        numeric = [i for i, a in enumerate(attrs) if a.kind == "N"]
        cond = F.lit(None).cast("double")
        for i in numeric:
            cond = F.when(F.col("attr_pos") == i, F.col(_mean_col(i))).otherwise(cond)
        decided = (stats.join(best, ["tree", "node"], "left")
                   .select("tree", "node", F.lit(depth).alias("depth"), F.col("N").alias("n"),
                           (F.col("mean") + F.lit(float(shift))).alias("prediction"),
                           F.col("attr_pos").isNull().alias("is_leaf"),
                           "attr_pos", cond.alias("split_cond"),
                           # an unseen category follows the child of the smallest value
                           _child(F.col("node"), F.col("attr_pos"), F.col("vmin")).alias("default_child")))
        decided = decided.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(decided)
        if branches is not None:
            inner = decided.filter(~F.col("is_leaf")).select("tree", "node", "attr_pos")
            edges = (branches.join(inner, ["tree", "node", "attr_pos"])
                     .select("tree", "node", "value",
                             _child(F.col("node"), F.col("attr_pos"), F.col("value")).alias("child")))
            edge_parts.append(edges)
        node_parts.append(decided)
        inner = decided.filter(~F.col("is_leaf")).select("tree", "node", "attr_pos", "split_cond")
        if branches is None or inner.isEmpty():
            break
        values = F.array(*[_branch_value(a, F.col("split_cond")) for a in attrs])
        moved = (active.join(inner, ["tree", "node"])
                 .withColumn("_v", F.element_at(values, F.col("attr_pos") + 1))
                 .withColumn("node", _child(F.col("node"), F.col("attr_pos"), F.col("_v")))
                 .select("tree", *names, "n", "s1", "s2", "node"))
        active = _checkpoint(moved)
        depth += 1
    nodes = node_parts[0]
    for p in node_parts[1:]:
        nodes = nodes.unionByName(p)
    if edge_parts:
        edges = edge_parts[0]
        for p in edge_parts[1:]:
            edges = edges.unionByName(p)
    else:
        edges = cells.sparkSession.createDataFrame([], "tree long, node string, value string, child string")
    # one flat table each (written once from the persisted per-level tables),
    # so prediction joins read a plain scan per level
    nodes = _checkpoint(nodes)
    edges = _checkpoint(edges)
    trees = nodes.filter(F.col("node") == ROOT).select("tree")
    return BaggedModel(nodes=nodes, edges=edges, attrs=attrs, trees=trees, shift=shift)


def fit(rows: DataFrame, id_col: str, attrs: list[Attr], target: str,
        max_split: int = MAX_SPLIT_NUMBER, number: int = SAMPLE_NUMBER, size: int = SAMPLE_SIZE,
        max_depth: int | None = None) -> BaggedModel:
    """Sample, collapse to cells and grow all trees."""
    shift = target_shift(rows, target)
    cells = to_cells(sample_trees(rows, id_col, max_split, number, size), attrs, target, shift)
    return fit_cells(cells, attrs, max_depth, shift)


def _cut(names: list[str], used: Column) -> list[Column]:
    """Each attribute where its bit of ``used`` is set, else null."""
    return [F.when(used.bitwiseAND(F.lit(1 << i)) != 0, F.col(n)) for i, n in enumerate(names)]


def leaf_groups(model: BaggedModel, tuples: DataFrame) -> DataFrame:
    """(tree, used, attributes, prediction, leaf_n): the leaf of every group of tuples.

    Tuples that agree on the attributes a path has looked at move as one row: ``used`` has a bit
    per attribute, the others are null. A tree starts as one row; a split on an attribute joins
    the distinct tuples cut to the path's attributes and the new one, so the rows of a tree are
    the value combinations its paths tell apart, never all tuples (a numeric attribute tells
    all its values apart). The combinations wanted at a level, one per set of attributes and
    next attribute, are a scalar subquery bounded by the number of attributes. Few combinations
    meet many trees near the roots: trees are salted into ``TREE_SALTS`` there.
    """
    attrs = model.attrs
    names = [a.name for a in attrs]
    types = dict(tuples.select(*names).dtypes)
    nodes = model.nodes.select("tree", "node", "is_leaf", "prediction", F.col("n").alias("leaf_n"),
                               "attr_pos", "split_cond", "default_child")
    max_depth = model.nodes.agg(F.max("depth")).first()[0] or 0
    values = F.array(*[_branch_value(a, F.col("split_cond")) for a in attrs])
    state = model.trees.select("tree", F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("used"),
                               *[F.lit(None).cast(types[n]).alias(n) for n in names])
    done = []
    for level in range(max_depth + 1):
        at = _checkpoint(state.join(nodes, ["tree", "node"]))
        done.append(at.filter(F.col("is_leaf")).select("tree", "used", *names, "prediction", "leaf_n"))
        if level == max_depth:
            break
        inner = at.filter(~F.col("is_leaf")).drop("prediction", "leaf_n", "is_leaf")
        wanted = inner.agg(F.collect_set(F.struct("used", "attr_pos"))).scalar()
        grown = F.expr("w.used | shiftleft(1L, w.attr_pos)")
        steps = (tuples.withColumn("w", F.explode(wanted))
                 .select(F.col("w.used").alias("_used"), F.col("w.attr_pos").alias("_pos"),
                         grown.alias("_grown"),
                         *[c.alias(f"_k{i}") for i, c in enumerate(_cut(names, F.col("w.used")))],
                         *[c.alias(f"_v{i}") for i, c in enumerate(_cut(names, grown))]).distinct()
                 .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TREE_SALTS - 1)))))
        same = [F.col(n).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(names)]
        met = inner.withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(TREE_SALTS)).cast("int")).join(
            steps, [F.col("used") == F.col("_used"), F.col("attr_pos") == F.col("_pos"),
                    F.col("salt") == F.col("_salt"), *same])
        state = (met.select("tree", "node", "attr_pos", "split_cond", "default_child",
                            F.col("_grown").alias("used"),
                            *[F.col(f"_v{i}").alias(n) for i, n in enumerate(names)])
                 .withColumn("value", F.element_at(values, F.col("attr_pos") + 1))
                 .join(model.edges, ["tree", "node", "value"], "left")
                 .select("tree", F.coalesce(F.col("child"), F.col("default_child")).alias("node"),
                         "used", *names))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def distinct_tuples(rows: DataFrame, names: list[str]) -> DataFrame:
    """The distinct attribute tuples, computed once for all levels."""
    return _checkpoint(rows.select(*names).distinct())


def _of_groups(tuples: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Every tuple with the columns of the groups it belongs to; one join key per set of
    attributes that some path used."""
    sets = groups.agg(F.collect_set("used")).scalar()
    cut = tuples.withColumn("_used", F.explode(sets))
    cut = cut.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(_cut(names, F.col("_used")))])
    g = groups.withColumnsRenamed({n: f"_g{i}" for i, n in enumerate(names)})
    same = [F.col(f"_k{i}").eqNullSafe(F.col(f"_g{i}")) for i in range(len(names))]
    return cut.join(g, [F.col("_used") == F.col("used"), *same]).select(
        *names, *[c for c in groups.columns if c not in (*names, "used")])


def predict_tuples(model: BaggedModel, tuples: DataFrame) -> DataFrame:
    """(tree, attribute tuple) -> prediction, leaf size for every tree and distinct tuple.

    That is a row per tuple and tree; ``ensemble_mean`` does without.
    """
    names = [a.name for a in model.attrs]
    distinct = distinct_tuples(tuples, names)
    return _of_groups(distinct, leaf_groups(model, distinct), names)


def predict_rows(model: BaggedModel, rows: DataFrame, id_col: str) -> DataFrame:
    """(tree, id, prediction, leaf_n): every tree's prediction for every row."""
    names = [a.name for a in model.attrs]
    per_tuple = predict_tuples(model, rows)
    return _join_tuples(rows.select(id_col, *names), per_tuple, names).select(
        "tree", id_col, "prediction", "leaf_n")


GRID = 1_000_000.0      # ensemble means add up predictions as whole millionths


def ensemble_mean(model: BaggedModel, rows: DataFrame, id_col: str,
                  prediction: Column | None = None) -> DataFrame:
    """(id, prediction): equal-weight mean over trees.

    Leaves that stand for the same combination of values are added up over all trees; a
    distinct tuple then adds its combinations, one per set of attributes that paths used, and
    the means are joined to the rows: no row per tuple and tree exists. Predictions (or the
    given expression of prediction and leaf_n) are added as whole millionths and divided once:
    the sum is exact, whatever order a cluster adds it in.
    """
    names = [a.name for a in model.attrs]
    p = F.col("prediction") if prediction is None else prediction
    units = F.floor(p * F.lit(GRID) + 0.5).cast("long")
    distinct = distinct_tuples(rows, names)
    sums = leaf_groups(model, distinct).groupBy("used", *names).agg(
        F.sum(units).alias("units"), F.count(F.lit(1)).alias("n_trees"))
    per_tuple = _of_groups(distinct, _checkpoint(sums), names).groupBy(*names).agg(
        (F.sum("units").cast("double") / (F.sum("n_trees") * F.lit(GRID))).alias("prediction"),
        F.sum("n_trees").alias("n_trees"))
    return _join_tuples(rows.select(id_col, *names), per_tuple, names).select(
        id_col, "prediction", "n_trees")


def _join_tuples(rows: DataFrame, per_tuple: DataFrame, names: list[str]) -> DataFrame:
    """Rows joined to per-tuple results on the attribute tuple, null-safe, so a
    row with a missing attribute keeps the prediction of its default branch."""
    t = per_tuple.select(*[F.col(n).alias(f"_t_{n}") for n in names],
                         *[c for c in per_tuple.columns if c not in names])
    cond = [rows[n].eqNullSafe(t[f"_t_{n}"]) for n in names]
    return rows.join(t, cond).drop(*[f"_t_{n}" for n in names])
