"""Edge lists: text files of two ids a line, literal edges, adjacency rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from a text file. Blank lines, lines that begin with #, and lines whose first two fields are not
    whole numbers are skipped; further fields are ignored. A missing path raises FileNotFoundError.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    return parse_edges(lines)


def parse_edges(lines: DataFrame) -> DataFrame:
    """The same for a frame of lines in a column `value`."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = lines.select(line.alias("line")).where("line <> '' and not startswith(line, '#')").select(F.split("line", r"\s+").alias("f"))
    whole = r"^[+-]?[0-9]+$"
    fields = parts.where(F.size("f") >= 2).select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
    fields = fields.where(F.col("a").rlike(whole) & F.col("b").rlike(whole))
    return fields.select(F.expr("try_cast(a as bigint)").alias("src"), F.expr("try_cast(b as bigint)").alias("dst")).dropna()


def literal_edges(spark: SparkSession, pairs: Iterable[tuple]) -> DataFrame:
    rows = list(pairs)
    kind = "string" if rows and isinstance(rows[0][0], str) else "long"
    return spark.createDataFrame(rows, f"src {kind}, dst {kind}")


def adjacency_edges(adjacency: DataFrame, node: str = "url", targets: str = "outlinks") -> DataFrame:
    """One row for each listed link of (node, array of targets)."""
    return adjacency.select(F.col(node).alias("src"), F.explode(targets).alias("dst"))
