"""Graphs stored for many passes: nodes and edges in the same buckets, so that a layer moves nothing but its sums."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, stash
from .segment import hubs
from .sparse import coalesce_edges


def _save(rows: DataFrame, table: str, key: str, buckets: int, then: list[str], path: str | None, merge: bool = False) -> None:
    """rows as a table in buckets of key, one file a bucket, sorted within; edges are merged where they lie if merge says so, without an exchange of their own."""
    dealt = rows.repartition(buckets, key)
    writer = (coalesce_edges(dealt) if merge else dealt).write.bucketBy(buckets, key).sortBy(key, *then).mode("overwrite")
    (writer.option("path", f"{path}/{table}") if path else writer).saveAsTable(table)


@dataclass
class StoredGraph:
    """Tables of a graph: nodes(id, x) in buckets of id, edges(src, dst, w) in as many buckets of src, and apart from them the edges whose source is a hub, in buckets of dst.

    Any product or layer takes it in the place of edges. Vectors that are spread by id over as many partitions, such as nodes and what a layer returns, meet the edges without an exchange, and
    products are summed up in each task before they move to their destination: one exchange a layer, none between layers. Edges never move. Vectors that a Python function
    has mapped (layers.linear) are dealt by id once more, because Spark no longer knows where they are. A hub has no bucket of its own: its edges
    are dealt by destination, and hubs, of which there are fewer than segment.SHARE * spark.sql.shuffle.partitions, send their vectors to all tasks. Where there are hubs the vectors are written, in
    their buckets, before they are sent, so that no plan computes them twice.
    """

    name: str
    buckets: int
    nodes: DataFrame
    edges: DataFrame
    hub_edges: DataFrame
    hubs: DataFrame

    @classmethod
    def save(cls, nodes: DataFrame, edges: DataFrame, name: str, buckets: int | None = None, path: str | None = None, merge: bool = False) -> StoredGraph:
        """Write the tables name_nodes, name_edges, name_hub_edges and name_hubs, to the warehouse or to folders in path.

        buckets should be what spark.sql.shuffle.partitions is for the passes to come (as it is now, if not given); other numbers are right as well, but cost an exchange a layer. Weights that are
        missing or null are 1. Edges without a source or destination meet nothing and go. With merge the weights of repeated edges are added up.
        """
        spark = nodes.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        weight = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
        edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", weight.alias("w"))
        found = stash(hubs(edges, "src").select("src"), "hubs")
        small = F.broadcast(found)
        _save(nodes.select("id", "x"), f"{name}_nodes", "id", buckets, [], path)
        _save(edges.join(small, "src", "left_anti"), f"{name}_edges", "src", buckets, ["dst"], path, merge)
        _save(edges.join(small, "src", "left_semi"), f"{name}_hub_edges", "dst", buckets, ["src"], path, merge)
        _save(found, f"{name}_hubs", "src", 1, [], path)
        return cls.open(spark, name)

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> StoredGraph:
        """The graph of tables that save() wrote."""
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}_nodes").collect()}
        return cls(name, int(described["Num Buckets"]), *(spark.table(f"{name}_{part}") for part in ("nodes", "edges", "hub_edges", "hubs")))

    @cached_property
    def has_hubs(self) -> bool:
        return not self.hubs.isEmpty()

    def messages(self, nodes: DataFrame) -> DataFrame:
        """(src, dst, w, x): every edge with the vector of nodes(id, x) at its source; sources without one go."""
        x = (self.cut(nodes) if self.has_hubs else nodes).select(F.col("id").alias("src"), "x")
        own = self.edges.join(x, "src").select("src", "dst", "w", "x")
        if not self.has_hubs:
            return own
        few = x.join(F.broadcast(self.hubs), "src", "left_semi")
        return own.union(self.hub_edges.join(F.broadcast(few), "src").select("src", "dst", "w", "x"))

    def cut(self, nodes: DataFrame) -> DataFrame:
        """nodes(id, x), written in the graph's buckets: cuts lineage between layers and keeps vectors where their edges are."""
        return self.keep(nodes.select("id", "x"))

    def keep(self, rows: DataFrame) -> DataFrame:
        """rows(id, ...), written in the graph's buckets."""
        path = scratch(rows.sparkSession, "layer")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        _save(rows, table, "id", self.buckets, [], path)
        return rows.sparkSession.table(table)

    def drop(self) -> None:
        """Delete the tables."""
        for part in ("nodes", "edges", "hub_edges", "hubs"):
            self.nodes.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
