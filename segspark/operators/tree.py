"""One regression tree over several outputs at once, grown level by level from histograms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

#: Bins of an input. One with at most so many distinct values is searched at every value, another at quantiles.
BINS = 256
#: A split must take away so large a share of a node's variance.
LEAST = 1e-12


@dataclass
class Node:
    """means of the outputs; where it splits, rows whose input lies below the threshold go to the first child and all others (nulls and NaN too) to the second."""

    means: list[float]
    column: str | None = None
    threshold: float = 0.0
    children: list[int] = field(default_factory=list)


class JointTree:
    """A binary tree over numeric inputs whose splits take away the most variance summed over all outputs; ties go to the first input, then to the lower threshold."""

    def __init__(self, inputs: list[str], outputs: list[str], depth: int, bins: int = BINS):
        self.inputs, self.outputs, self.depth, self.bins = inputs, outputs, depth, bins
        self.nodes: dict[int, Node] = {}

    def _edges(self, rows: DataFrame, column: str) -> list[float]:
        """The least values of the bins, in order: bounded in number, whatever the table."""
        known = rows.where(F.col(column).isNotNull() & ~F.isnan(column))
        values = [r[0] for r in known.select(column).distinct().limit(self.bins + 1).collect()]
        if len(values) > self.bins:
            values = known.approxQuantile(column, [i / self.bins for i in range(self.bins)], 0.1 / self.bins)
        return sorted(set(values))

    def _walk(self, node: int, leaf) -> Column:
        """leaf(number) of the leaf that a row comes to."""
        own = self.nodes.get(node)
        if own is None or own.column is None:
            return leaf(node)
        return F.when(F.col(own.column) < own.threshold, self._walk(own.children[0], leaf)).otherwise(self._walk(own.children[1], leaf))

    def fit(self, rows: DataFrame) -> JointTree:
        """Grow the tree. Each level is one aggregation of rows by (node, input, bin): counts and sums of the outputs, added up within each task first. At most nodes x inputs x bins rows
        are left, over which splits are compared by windows of one input's bins; a row a node reaches the driver."""
        cast = {c: F.col(c).cast("double") for c in (*self.inputs, *self.outputs)}
        rows = rows.select(*(v.alias(c) for c, v in cast.items())).where(" AND ".join(f"`{c}` IS NOT NULL" for c in self.outputs))
        edges = {c: self._edges(rows, c) for c in self.inputs}
        for c in self.inputs:
            if len(edges[c]) > 1:
                rows = Bucketizer(splits=[-float("inf"), *edges[c][1:], float("inf")], inputCol=c, outputCol=f"_bin_{c}", handleInvalid="keep").transform(rows)
            else:
                rows = rows.withColumn(f"_bin_{c}", F.when(F.col(c).isNotNull() & ~F.isnan(c), 0.0))
            rows = rows.withColumn(f"_bin_{c}", F.coalesce(f"_bin_{c}", F.lit(float(len(edges[c])))))  # nulls and NaN beyond all values
        rows = stash(rows, "binned")
        outputs = range(len(self.outputs))
        sums = [F.count("*").alias("n"), *(F.sum(c).alias(f"s{j}") for j, c in enumerate(self.outputs)), *(F.sum(F.col(c) * F.col(c)).alias(f"q{j}") for j, c in enumerate(self.outputs))]
        self.nodes, level = {}, [0]
        for depth in range(self.depth + 1):
            at = rows.withColumn("_node", self._walk(0, F.lit)).where(F.col("_node").isin(level))
            if not depth:
                total = at.agg(*sums).first()
                if not total.n:
                    return self
                self.nodes[0] = Node([total[f"s{j}"] / total.n for j in outputs])
            if depth == self.depth or not level:
                break
            bins = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_bin_{c}").cast("int").alias("bin")) for k, c in enumerate(self.inputs)])
            counted = at.select("_node", F.inline(bins), *self.outputs).groupBy("_node", "k", "bin").agg(*sums)
            upto = Window.partitionBy("_node", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            whole = Window.partitionBy("_node", "k")
            names = ["n", *(f"s{j}" for j in outputs)]
            seen = counted.select("_node", "k", "bin", *(F.sum(c).over(upto).alias(f"l{c}") for c in names), *(F.sum(c).over(whole).alias(c) for c in (*names, *(f"q{j}" for j in outputs))))
            seen = seen.where("ln < n")
            square = lambda s, n: F.col(s) * F.col(s) / F.col(n)
            gain, variance = F.lit(0.0), F.lit(0.0)
            for j in outputs:
                rest = F.col(f"s{j}") - F.col(f"ls{j}")
                gain = gain + square(f"ls{j}", "ln") + rest * rest / (F.col("n") - F.col("ln")) - square(f"s{j}", "n")
                variance = variance + F.col(f"q{j}") - square(f"s{j}", "n")
            share = F.round(F.when(variance > 0, gain / variance).otherwise(0.0), 12)
            best = seen.withColumn("share", share).groupBy("_node").agg(F.max_by(F.struct("share", "k", "bin", *names, *(f"l{c}" for c in names)), F.struct("share", -F.col("k"), -F.col("bin"))).alias("b"))
            level = []
            for node, b in best.collect():
                column = self.inputs[b.k]
                if b.share <= LEAST:
                    continue
                own, sides = self.nodes[node], [2 * node + 1, 2 * node + 2]
                own.column, own.children = column, sides
                own.threshold = edges[column][b.bin + 1] if b.bin + 1 < len(edges[column]) else float("inf")
                self.nodes[sides[0]] = Node([b[f"ls{j}"] / b.ln for j in outputs])
                self.nodes[sides[1]] = Node([(b[f"s{j}"] - b[f"ls{j}"]) / (b.n - b.ln) for j in outputs])
                level += sides
        return self

    def predict(self, rows: DataFrame, prefix: str = "pred_") -> DataFrame:
        """rows with the means of the leaf that each comes to, as one expression; null where nothing was fitted."""
        for j, c in enumerate(self.outputs):
            rows = rows.withColumn(f"{prefix}{c}", self._walk(0, lambda node, j=j: F.lit(self.nodes[node].means[j] if node in self.nodes else None).cast("double")))
        return rows
