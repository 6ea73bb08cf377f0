"""Link graphs: nodes, degrees, transition weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from rankloom.session import cut


ROW_BITS = 33  # of monotonically_increasing_id: the place of a row in its partition


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in range partitions, sorted and written once, with their partition `__p` and place `__at` in it.

    Range bounds are sampled, so two runs of one plan may part the rows differently. The rows are therefore cut
    before anything is counted, and counts and rows come from the same stored partitions.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    place = F.col("__m").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return kept.withColumns({"__p": F.shiftright("__m", ROW_BITS).cast("int"), "__at": place}).drop("__m")


def before_partition(parts: DataFrame, amount: Column, name: str) -> DataFrame:
    """(__p, name): the sum of an aggregate over all earlier partitions; one row a partition, so one small window."""
    sums = parts.groupBy("__p").agg(amount.alias("__s"))
    before = F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("__p", F.coalesce(before, F.lit(0)).alias(name)))


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Add 0, 1, 2, ... in ascending order of the columns; no task sees all rows."""
    rows = ranged(df, order)
    first = before_partition(rows, F.count("*"), "__first")
    return rows.join(first, "__p").withColumn(name, (F.col("__first") + F.col("__at")).cast("long")).drop("__p", "__at", "__first")


def code(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.xxhash64(name))


@dataclass(frozen=True)
class Graph:
    """nodes: id; edges: src, dst, weight. Repeated edges and self-loops are kept. endpoints: the nodes are the edges' own."""

    nodes: DataFrame
    edges: DataFrame
    endpoints: bool = False

    @staticmethod
    def of(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """Nodes are the distinct endpoints unless given; edges then keep only targets among the nodes."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        edges = edges.select("src", "dst", "weight")
        endpoints = nodes is None
        if nodes is None:
            nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        else:
            edges = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        return Graph(nodes.select("id"), edges.select("src", "dst", "weight"), endpoints)

    def out_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))

    def weighted_out_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("weighted_out_degree"))

    def transitions(self, weighted: bool = False) -> DataFrame:
        """src, dst, w: the chance of going from src to dst, repeated edges added; weights count if asked.

        Under `weighted`, sources whose weights sum to nothing have no transitions.
        """
        amount = F.sum("weight") if weighted else F.count("*")
        pairs = self.edges.groupBy("src", "dst").agg(amount.alias("m"))
        total = pairs.groupBy("src").agg(F.sum("m").alias("total")).where("total > 0")
        return pairs.join(total, "src").select("src", "dst", (F.col("m") / F.col("total")).alias("w"))

    def counted(self, weighted: bool, n_parts: int) -> DataFrame:
        """src, dst, m, total with m / total = w of `transitions`, in n_parts partitions by src and sorted by it, from one shuffle."""
        amount = F.sum("weight") if weighted else F.count("*")
        pairs = self.edges.where("src is not null").repartition(n_parts, "src").groupBy("src", "dst").agg(amount.alias("m"))
        return pairs.withColumn("total", F.sum("m").over(Window.partitionBy("src"))).where("total > 0").sortWithinPartitions("src")

    def coded(self) -> Graph | None:
        """The graph with 64-bit codes (`code`) for names; None if ids are no strings, or two of them share a code."""
        if self.nodes.schema["id"].dataType != StringType():
            return None
        nodes = self.nodes.select(code("id").alias("id"))
        if not nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return None
        return Graph(nodes, self.edges.select(code("src").alias("src"), code("dst").alias("dst"), "weight"), self.endpoints)

    def in_degree(self, weighted: bool = False) -> DataFrame:
        """Sum of the transition weights into each node that has any."""
        return self.transitions(weighted).groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("in_degree"))

    def dangling(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")

    def summary(self) -> DataFrame:
        """n_nodes, n_edges, n_dangling, density in one row."""
        sources = self.edges.select("src").distinct().agg(F.count("*").alias("n_sources"))
        out = self.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(self.edges.agg(F.count("*").alias("n_edges"))).crossJoin(sources)
        n = F.col("n_nodes").cast("double")
        return out.select("n_nodes", "n_edges", (F.col("n_nodes") - F.col("n_sources")).alias("n_dangling"), (F.col("n_edges") / F.greatest(n * n, F.lit(1.0))).alias("density"))
