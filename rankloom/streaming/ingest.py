"""Edges and triples as streams: running degrees, and an edge table that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.graph import Graph
from rankloom.operators.pagerank import PageRank, pagerank


def stream_edges(spark: SparkSession, folder: str, schema: str = "src long, dst long") -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def running_out_degree(edges: DataFrame) -> DataFrame:
    """Out-degree so far; for the update or complete output mode, without a watermark, as counts never close."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))


def append_edges(edges: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch once to a Parquet folder: its own sub-folder is overwritten if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(edges: DataFrame, before: DataFrame | None, p: float = 0.15, tol: float = 1e-8) -> PageRank:
    """PageRank of the grown edge table, started from the scores before; new nodes start at 0."""
    return pagerank(Graph.of(edges), p, tol, start=before)
