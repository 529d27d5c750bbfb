"""Boosted trees as arrays of splits: scored, staged and rolled forward inside column expressions.

Training is Spark ML's. The trained model is read once as a table of nodes (its size depends on rounds and depth, not on data)
and becomes literals of an expression, which can then stand inside a fold, where a model's ``transform`` cannot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newstide.operators.forecast import fit_trees, forecast_window
from newstide.session import scratch_path


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees one after the other; a leaf has feature -1. ``roots`` and ``weights`` are by tree."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]
    roots: tuple[int, ...]
    weights: tuple[float, ...]
    depth: int

    def first(self, rounds: int) -> Forest:
        """The forest after so many rounds of boosting."""
        return replace(self, roots=self.roots[:rounds], weights=self.weights[:rounds])

    def terms(self, x: Column) -> Column:
        """What each tree adds for a flat vector, in the order of training. A missing value goes right."""

        def down(node: Column, _: Column) -> Column:
            split = F.get(F.lit(list(self.feature)), node)
            onward = F.when(F.get(x, split) <= F.get(F.lit(list(self.threshold)), node), F.get(F.lit(list(self.left)), node))
            return F.when(split < 0, node).otherwise(onward.otherwise(F.get(F.lit(list(self.right)), node)))

        steps = F.sequence(F.lit(1), F.lit(max(self.depth, 1)))
        leaf = lambda root: F.aggregate(steps, root, down)
        trees = F.lit(list(self.roots)), F.lit(list(self.weights))
        return F.zip_with(*trees, lambda root, weight: weight * F.get(F.lit(list(self.value)), leaf(root)))

    def score(self, x: Column) -> Column:
        return F.aggregate(self.terms(x), F.lit(0.0), lambda s, t: s + t)

    def plain(self, x: Sequence[float]) -> float:
        """The same score of one vector of numbers."""
        total = 0.0
        for root, weight in zip(self.roots, self.weights, strict=True):
            node = root
            while self.feature[node] >= 0:
                node = self.left[node] if x[self.feature[node]] <= self.threshold[node] else self.right[node]
            total += weight * self.value[node]
        return total


def forest(spark: SparkSession, model: GBTRegressionModel) -> Forest:
    """The splits of a trained model, read from the table that Spark saves it as."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    roots, at = [], {}
    for k, n in enumerate(nodes):
        at[n.treeID, n.id] = k
        if n.id == 0:
            roots.append(k)
    child = lambda n, c: at[n.treeID, c] if c >= 0 else -1
    return Forest(
        feature=tuple(n.split.featureIndex for n in nodes),
        threshold=tuple(n.split.leftCategoriesOrThreshold[0] if n.split.featureIndex >= 0 else 0.0 for n in nodes),
        left=tuple(child(n, n.leftChild) for n in nodes),
        right=tuple(child(n, n.rightChild) for n in nodes),
        value=tuple(n.prediction for n in nodes),
        roots=tuple(roots),
        weights=tuple(model.treeWeights),
        depth=max(t.depth for t in model.trees),
    )


def round_losses(seq: DataFrame, trees: Forest, by: Sequence[str] = ("split",)) -> DataFrame:
    """Mean squared error after each round of boosting, by group: ``by``, round (from 1), n, loss.

    Each row is scored once; all rounds are averages of one partial aggregation, so rows are not repeated.
    """
    rounds = len(trees.roots)
    terms = trees.terms(F.flatten("x"))
    staged = F.aggregate(
        terms,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("errors")),
        lambda s, t: F.struct((s["sum"] + t).alias("sum"), F.concat(s["errors"], F.array(F.pow(s["sum"] + t - F.col("y"), F.lit(2)))).alias("errors")),
    )["errors"]
    errors = seq.select(*by, staged.alias("_e"))
    losses = errors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get("_e", F.lit(k))).alias(f"_l{k}") for k in range(rounds)])
    listed = F.array(*[F.struct(F.lit(k + 1).alias("round"), F.col(f"_l{k}").alias("loss")) for k in range(rounds)])
    return losses.select(*by, "n", F.explode(listed).alias("r")).select(*by, "r.round", "n", "r.loss")


def best_rounds(losses: DataFrame, split: str = "validation") -> int:
    """The number of rounds with the least loss on a part of the rows, the smaller on a tie."""
    return losses.where(F.col("split") == split).agg(F.min(F.struct("loss", "round"))["round"].alias("r")).first()["r"]


def fit_best_trees(seq: DataFrame, **params) -> tuple[Forest, DataFrame]:
    """Trees trained on the ``train`` rows of ``seq`` and cut after the round with the least loss on its ``validation`` rows.

    Also returns the losses by split and round. Without validation rows all rounds are kept.
    """
    trees = forest(seq.sparkSession, fit_trees(seq.where(F.col("split") == "train"), **params))
    losses = round_losses(seq, trees)
    return trees.first(best_rounds(losses) or len(trees.roots)), losses


def score_rows(seq: DataFrame, trees: Forest, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    return seq.select(*by, d, F.col("y").alias("actual"), trees.score(F.flatten("x")).alias("predicted"))


def forecast_trees(window: DataFrame, trees: Forest, horizon: int, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """The recursive forecast of a forest that all series share."""
    return forecast_window(window, lambda x: trees.score(F.flatten(x)), horizon, by, d)
