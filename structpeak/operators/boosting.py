"""Boosted regression trees on a feature array, grown from histograms, with predictions out of fold.

Features are cut once at their quantiles. A level of a tree is one grouped sum over (model, node, feature, bin): tasks
add up their own rows first, so what is shuffled depends on the parameters and never on the data. The chosen splits (one a
node) reach the driver, and all rows meet them as a broadcast table of one row a model. ``folds`` models leave one fold out each, one more
takes every labelled row; all of them grow in the same passes. A labelled row is predicted by the model that has never seen its entity,
any other row by the full one.

A row without a label is never learned from, one without a feature array is predicted by no tree (its prediction is the model's mean).
NULL values fall into the lowest bin, NaN into the highest. Rows with equal keys are rows of their own. Without labelled rows every
prediction is NULL; a fold whose other folds are empty has no prediction either.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structpeak.operators.hotkeys import TASK_ROWS, small_enough
from structpeak.operators.ordering import exact_quantiles
from structpeak.operators.sampling import fold_assignment
from structpeak.session import durable

RESERVED = ("_entity", "_bins", "_model", "_forest")
_TREES = "array<struct<feature: array<int>, cut: array<int>, value: array<double>>>"


@dataclass(frozen=True)
class Boosting:
    """``rounds`` trees of ``depth`` levels over ``bins`` quantile bins; ``smallest`` rows stay on each side of a split."""

    rounds: int = 20
    depth: int = 2
    bins: int = 16
    rate: float = 0.3
    smallest: int = 5

    def __post_init__(self) -> None:
        if self.rounds < 1 or self.depth < 1 or self.bins < 2 or self.smallest < 1:
            raise ValueError("rounds, depth and smallest begin at 1, bins at 2")


@dataclass
class Forest:
    """Trees of one model. Node ``i`` has the children ``2i`` and ``2i + 1``; the root is 1."""

    mean: float
    trees: list[tuple[list[int], list[int], list[float]]] = field(default_factory=list)


def bin_edges(df: DataFrame, features: str, bins: int, spread: bool | None = None) -> list[list[float]]:
    """Quantiles that cut every feature into ``bins`` parts; a feature without values has none."""
    long = df.select(F.posexplode(features).alias("_feature", "_value"))
    cuts = {f"q{i}": i / bins for i in range(1, bins)}
    spread = not small_enough(df, TASK_ROWS) if spread is None else spread
    found = {r["_feature"]: list(r)[1:] for r in exact_quantiles(long, ["_feature"], "_value", cuts, spread).collect()}  # one row a feature
    return [[e for e in found.get(i, []) if e is not None] for i in range(max(found, default=-1) + 1)]


def binned(features: str, edges: list[list[float]]) -> Column:
    """The bin of every feature: how many of its edges are smaller."""
    held = F.array(*[F.array(*map(F.lit, e)).cast("array<double>") for e in edges]) if edges else F.array().cast("array<array<double>>")
    return F.transform(features, lambda x, i: F.size(F.filter(F.get(held, i), lambda e: e < x)))


def _leaf(tree: Column, bins: Column, levels: int) -> Column:
    """Node that a row reaches after so many levels."""
    if not levels:
        return F.lit(1)

    def down(node: Column, _: Column) -> Column:
        right = F.get(bins, F.get(tree["feature"], node)) > F.get(tree["cut"], node)
        return node * 2 + F.when(right, 1).otherwise(0)

    return F.aggregate(F.array(*[F.lit(i) for i in range(levels)]), F.lit(1), down)


def predicted(forest: Column, bins: Column, config: Boosting) -> Column:
    """Mean of the model plus its trees' shares."""
    share = F.aggregate(forest["trees"], F.lit(0.0), lambda s, t: s + config.rate * F.get(t["value"], _leaf(t, bins, config.depth)))
    return forest["mean"] + F.coalesce(share, F.lit(0.0))


def _forest_rows(spark, forests: dict[int, Forest]) -> DataFrame:
    """``model, forest``: one row a model."""
    rows = [(m, (f.mean, f.trees)) for m, f in forests.items()]
    return spark.createDataFrame(rows, f"model int, forest struct<mean: double, trees: {_TREES}>")


def best_splits(rows: DataFrame, config: Boosting) -> DataFrame:
    """``model, node, feature, cut, left, right`` from rows ``model, node, bins, rest``: the split that explains most of each node.

    Splits are ranked by the share of the node's squares they explain (nine decimals, ties to the first feature and
    lowest bin). Where no split explains anything, all rows go left and both sides hold the node's mean.
    """
    long = rows.select("model", "node", "rest", F.posexplode("bins").alias("feature", "bin"))
    hist = long.groupBy("model", "node", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("s"), F.sum(F.col("rest") * F.col("rest")).alias("q"))
    whole = Window.partitionBy("model", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select("model", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}_l") for c in "ns"], *[F.sum(c).over(whole).alias(c) for c in "nsq"])
    n_r, s_r = F.col("n") - F.col("n_l"), F.col("s") - F.col("s_l")
    gain = F.col("s_l") * F.col("s_l") / F.col("n_l") + F.try_divide(s_r * s_r, n_r) - F.col("s") * F.col("s") / F.col("n")
    fits = (F.col("n_l") >= config.smallest) & (n_r >= config.smallest) & (F.col("q") > 0)
    share = F.when(fits, F.round(F.try_divide(gain, F.col("q")), 9)).otherwise(F.lit(-1.0))
    order = F.struct(share.alias("share"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    sides = F.struct("feature", "bin", "n_l", "s_l", "n", "s", n_r.alias("n_r"), s_r.alias("s_r"), share.alias("share"))
    best = hist.groupBy("model", "node").agg(F.max_by(sides, order).alias("x")).select("model", "node", "x.*")
    cuts = F.col("share") > 0
    mean = F.col("s") / F.col("n")
    return best.select(
        "model", "node", "feature", F.when(cuts, F.col("bin")).otherwise(config.bins).alias("cut"),
        F.when(cuts, F.col("s_l") / F.col("n_l")).otherwise(mean).alias("left"),
        F.when(cuts, F.try_divide(F.col("s_r"), F.col("n_r"))).otherwise(mean).alias("right"),
    )


def fit_forests(rows: DataFrame, folds: int, config: Boosting) -> dict[int, Forest]:
    """Forests of the models 0 to ``folds`` from rows ``fold, target, bins``; model ``folds`` leaves nothing out.

    Rows are read ``rounds * depth`` times and should be stored. A model without rows is absent.
    """
    spark = rows.sparkSession
    models = F.filter(F.array(*[F.lit(i) for i in range(folds + 1)]), lambda m: m != F.col("fold"))
    seen = rows.where(F.col("target").isNotNull() & F.col("bins").isNotNull()).select(F.explode(models).alias("model"), "target", "bins")
    forests = {r["model"]: Forest(r["mean"]) for r in seen.groupBy("model").agg(F.avg("target").alias("mean")).collect()}  # one row a model
    for _ in range(config.rounds if forests else 0):
        with_forest = seen.join(F.broadcast(_forest_rows(spark, forests)), "model")  # a row a model
        rest = with_forest.withColumn("rest", F.col("target") - predicted(F.col("forest"), F.col("bins"), config))
        grown = {m: ([0] * 2**config.depth, [config.bins] * 2**config.depth, [0.0] * 2 ** (config.depth + 1)) for m in forests}
        for level in range(config.depth):
            held = F.broadcast(spark.createDataFrame([(m, t) for m, t in grown.items()], f"model int, tree {_TREES[6:-1]}"))
            at = rest.join(held, "model").select("model", _leaf(F.col("tree"), F.col("bins"), level).alias("node"), "bins", "rest")
            for r in best_splits(at, config).collect():  # a row a model and node
                feature, cut, value = grown[r["model"]]
                feature[r["node"]], cut[r["node"]] = r["feature"], r["cut"]
                value[2 * r["node"]], value[2 * r["node"] + 1] = r["left"], r["right"]
        for m, tree in grown.items():
            forests[m].trees.append(tree)
    return forests


def boosted_out_of_fold(
    df: DataFrame, features: str, label: str, folds: int, seed: int, config: Boosting = Boosting(), entity: str = "entity",
) -> DataFrame:
    """``df`` with ``fold`` (NULL without a label) and ``predicted``; these names, and those in ``RESERVED``, must be free.

    Entities are dealt to folds, so no row's prediction knows a label of its entity. Edges come from the features of all labelled rows.
    A NaN label is no label.
    """
    taken = {"fold", "predicted", *RESERVED} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be overwritten")
    target = F.col(label).cast("double")
    has_label = target.isNotNull() & ~F.isnan(target) & F.col(features).isNotNull()
    df = durable(df)  # whatever made the features runs once
    known = df.where(has_label)
    edges = bin_edges(known, features, config.bins)
    dealt = fold_assignment(known, folds, seed, entity).withColumnRenamed(entity, "_entity")
    placed = df.join(dealt, has_label & df[entity].eqNullSafe(dealt["_entity"]), "left").drop("_entity")
    stored = durable(placed.withColumn("_bins", binned(features, edges)))
    # a fold number that no row has stands for "left out of nothing"
    rows = stored.select(F.coalesce("fold", F.lit(folds + 1)).alias("fold"), F.when(has_label, target).alias("target"), F.col("_bins").alias("bins"))
    held = F.broadcast(_forest_rows(df.sparkSession, fit_forests(rows, folds, config)).withColumnsRenamed({"model": "_model", "forest": "_forest"}))
    out = stored.join(held, F.coalesce("fold", F.lit(folds)) == held["_model"], "left")
    return out.select(*df.columns, "fold", predicted(F.col("_forest"), F.col("_bins"), config).alias("predicted"))
