"""Tree models: a regression tree with exact splits (REG8) and MLlib's random forest (ML1)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statfold.operators.position import running_sum


@dataclass
class Node:
    """One node; ``feature`` is None for a leaf. Rows with ``feature <= threshold`` go to child ``2 * id + 1``."""
    id: int
    depth: int
    n: int
    total: float                    # sum of the label less its overall mean
    feature: str | None = None
    threshold: float | None = None
    gain: float = 0.0               # fall of the sum of squares


class RegressionTree:
    """A fitted tree; ``nodes`` by id (root 0, children ``2 * id + 1`` and ``2 * id + 2``)."""

    def __init__(self, features: list[str], label: str, mean: float, nodes: dict[int, Node]):
        self.features, self.label, self.mean, self.nodes = features, label, mean, nodes

    def value(self, node: Node) -> float:
        return self.mean + (node.total / node.n if node.n else 0.0)

    def _walk(self, at: int, leaf) -> Column:
        node = self.nodes[at]
        if node.feature is None:
            return leaf(node)
        return F.when(F.col(node.feature).cast("double") <= F.lit(node.threshold), self._walk(2 * at + 1, leaf)).otherwise(
            self._walk(2 * at + 2, leaf))

    def node_of(self) -> Column:
        """The leaf that a row falls into (a null feature goes right)."""
        return self._walk(0, lambda n: F.lit(n.id))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self._walk(0, lambda n: F.lit(float(self.value(n)))))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n.id, n.depth, n.n, float(self.value(n)), n.feature, n.threshold, float(n.gain))
                for n in sorted(self.nodes.values(), key=lambda n: n.id)]
        return spark.createDataFrame(rows, "node int, depth int, n long, value double, feature string, "
                                           "threshold double, gain double")


def _best_splits(rows: DataFrame, features: list[str], nodes: list[Node], least: int) -> dict[int, tuple]:
    """{node: (gain, feature, last value of the left side, rows left, total left)} of the best exact split.

    ``rows``: _node, _y and the features. Every feature's values are counted once (equal values are one run, summed
    where they are read), the runs of all nodes and features are sorted together over range partitions, and running
    sums along them give both sides of every possible split. No value is binned and no node is gathered.
    """
    long = rows.select("_node", "_y", F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("u"))
    runs = long.groupBy("_node", F.col("u.f").alias("f"), F.col("u.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"))
    summed = running_sum(runs, ["_node", "f", "v"], ["n", "s"], ["cn", "cs"])
    groups = F.broadcast(summed.groupBy("_node", "f").agg(   # one row a node and feature
        F.min_by(F.struct((F.col("cn") - F.col("n")).alias("n"), (F.col("cs") - F.col("s")).alias("s")), "v").alias("before"),
        F.sum("n").alias("all_n"), F.sum("s").alias("all_s")))
    left_n, left_s = F.col("cn") - F.col("before.n"), F.col("cs") - F.col("before.s")
    split = summed.join(groups, ["_node", "f"]).select(
        "_node", "f", "v", left_n.alias("ln"), left_s.alias("ls"), (F.col("all_n") - left_n).alias("rn"),
        (F.col("all_s") - left_s).alias("rs"), "all_n", "all_s").where((F.col("ln") >= least) & (F.col("rn") >= least))
    gain = F.col("ls") ** 2 / F.col("ln") + F.col("rs") ** 2 / F.col("rn") - F.col("all_s") ** 2 / F.col("all_n")
    # gains that differ only by rounding count as equal: the first feature and smallest value win
    shown = F.round(gain, 12 - int(math.ceil(math.log10(max(1.0, sum(n.n for n in nodes))))))
    best = split.groupBy("_node").agg(F.max_by(
        F.struct(gain.alias("gain"), "f", "v", "ln", "ls"), F.struct(shown, -F.col("f"), -F.col("v"))).alias("b")).collect()
    return {r["_node"]: tuple(r["b"]) for r in best}


def regression_tree(train: DataFrame, features: Sequence[str], label: str, max_depth: int = 4,
                    min_leaf_fraction: float = 0.1) -> RegressionTree:
    """REG8: ``DecisionTreeRegressor(max_depth=4, min_samples_leaf=0.1)`` with exact splits.

    Each level is one pass: the split of every node that lowers the sum of squares most, between two neighbouring
    values of a feature, with at least ``ceil(min_leaf_fraction * rows)`` rows on either side. Thresholds are half way
    between the two values; of equal gains the first feature and the smallest value win. Rows with a null or NaN
    feature or label take no part.
    """
    features = list(features)
    keep = F.lit(True)
    for c in [*features, label]:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    data = train.where(keep).select(F.col(label).cast("double").alias("_label"), *features)
    first = data.agg(F.count(F.lit(1)).alias("n"), F.avg("_label").alias("m"), F.stddev_pop("_label").alias("sd")).first()
    n, mean = int(first["n"]), float(first["m"] or 0.0)
    scale = float(first["sd"] or 0.0) or 1.0   # sums of scaled labels, so that rounding is alike for any unit
    least = max(1, math.ceil(min_leaf_fraction * n))
    tree = RegressionTree(features, label, mean, {0: Node(0, 0, n, 0.0)})
    open_ = [tree.nodes[0]] if n >= 2 * least else []
    data = data.withColumn("_y", (F.col("_label") - F.lit(mean)) / F.lit(scale))
    for depth in range(max_depth):
        if not open_:
            break
        rows = data.withColumn("_node", tree.node_of()).where(F.col("_node").isin([x.id for x in open_]))
        found = {k: b for k, b in _best_splits(rows, features, open_, least).items() if b[0] > 1e-12 * n}
        if not found:
            break
        # the threshold lies half way to the next value in the node
        following = rows.agg(*[F.min(F.when((F.col("_node") == k) & (F.col(features[b[1]]).cast("double") > F.lit(b[2])),
                                            F.col(features[b[1]]).cast("double"))).alias(f"n{k}")
                               for k, b in found.items()]).first()
        open_ = []
        for k, (gain, f, v, ln, ls) in found.items():
            node = tree.nodes[k]
            node.feature, node.gain = features[f], gain * scale * scale
            node.threshold = _between(v, float(following[f"n{k}"]))
            left = Node(2 * k + 1, depth + 1, int(ln), ls * scale)
            right = Node(2 * k + 2, depth + 1, node.n - int(ln), node.total - ls * scale)
            tree.nodes |= {left.id: left, right.id: right}
            open_ += [x for x in (left, right) if x.n >= 2 * least]
    return tree


def _between(low: float, high: float) -> float:
    """The middle, or ``low`` where no number lies between."""
    middle = float(np.float64(low) / 2 + np.float64(high) / 2)
    return middle if low <= middle < high else low


def random_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, seed: int = 42):
    """ML1: ``RandomForestClassifier(n_estimators=100)``; string labels are indexed first."""
    idx = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    vec = VectorAssembler(inputCols=list(features), outputCol="_features")
    rf = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, seed=seed)
    return Pipeline(stages=[idx, vec, rf]).fit(train)
