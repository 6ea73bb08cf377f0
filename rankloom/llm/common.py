"""Shared helpers: durable intermediate tables, prefix sums without a single task, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.session import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"


ROWS_OF_BATCH = 200


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand Python at most ROWS_OF_BATCH rows at a time, as whole texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_OF_BATCH:
        spark.conf.set(key, str(ROWS_OF_BATCH))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    _WRITTEN.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def finished(build: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """The stored result of `build`, with all tables that were written on the way to it removed."""
    first = len(_WRITTEN)
    out = stored(build(), name)
    keep = _WRITTEN[-1]
    for path in _WRITTEN[first:-1]:
        drop_path(spark, path)
    _WRITTEN[first:] = [keep]
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored(df: DataFrame) -> None:
    """Remove a table that `stored` wrote and no later plan reads."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        drop_path(df.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, keys: list[str], cell: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Add `out`: the sum of `amount` over the rows of the same keys that come before, in the order (cell, order).

    Cells are summed first and only they are accumulated per key, so that no task sorts a whole key.
    """
    sums = df.groupBy(*keys, cell).agg(F.sum(amount).alias("__sum"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    on = [df[k].eqNullSafe(sums[k]) for k in [*keys, cell]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = df.join(sums, cond).drop(*[sums[k] for k in [*keys, cell]])
    inner = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("__before") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).drop("__before")


HOT_KEYS = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Inner join of rows with a table of one row for each key, where a key may hold a large part of all rows.

    right has `__rows`, how many rows of `left` a key has at most, and rows is their number in all. Keys with more
    than 1 / HOT_KEYS of them, of which there cannot be more than HOT_KEYS, are broadcast, so their rows stay where
    they are; only the others are shuffled. Null keys have no partner.
    """
    hot = F.col("__rows") * HOT_KEYS > rows
    few, many = F.broadcast(right.where(hot).drop("__rows")), right.where(~hot).drop("__rows")
    return left.join(few, keys).unionByName(left.join(few.select(*keys), keys, "left_anti").join(many, keys))


def documents_apart(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """Rows as (key, text, row): `key` is never null and names one text; `row` holds all columns.

    Where every row has a doc_id of its own the key is the doc_id, which one grouped count tells. Otherwise rows
    without a doc_id, and those of a doc_id that repeats, get a number for each distinct (doc_id, text), above all
    doc_ids; that first number is returned too.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counts = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    twice = stored(counts.where("n > 1 or id is null").select("id"), "repeated")
    if twice.isEmpty():
        drop_stored(twice)
        return plain.withColumnRenamed("id", "key"), None
    ends = docs.agg(F.min(F.col("doc_id").cast("long")).alias("lo"), F.max(F.col("doc_id").cast("long")).alias("hi")).first()
    text = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.unhex(F.lit("")))
    known = twice.withColumn("again", F.lit(True))
    marked = plain.withColumn("t", text).join(known.withColumnRenamed("id", "id2"), F.col("id").eqNullSafe(F.col("id2")), "left").drop("id2")
    some = marked.where("again").select("id", "t").distinct().withColumn("cell", F.pmod(F.xxhash64("id", "t"), F.lit(1024)))
    first = (ends["hi"] if ends["hi"] is not None else -1) + 1
    if first > 2**62:
        raise ValueError("doc_ids above 2**62 must not repeat")
    number = stored(numbered(some, [], "cell", [F.col("id"), F.col("t")], F.lit(1), "number").select("id", "t", "number"), "numbers")
    number = number.select(F.col("id").alias("id2"), F.col("t").alias("t2"), "number")
    found = marked.join(number, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")), "left")
    key = F.when(F.col("number").isNotNull(), F.col("number") + first).otherwise(F.col("id"))
    return found.select(key.alias("key"), "text", "row"), first


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum and a join; every
    round is written to the shared folder. Nodes without edges are not listed; self-loops and nulls are ignored.
    """
    spark = edges.sparkSession
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur, before = stored(cur, "cc"), None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = stored(small.where("u <> v").distinct(), "cc")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(cur)
        cur = nxt
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
