"""Breadth-first distances, simple paths, predecessor counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.graph import dense_index
from rankloom.session import cut, drop_cut, having, kept, unsized


FEW = 100_000  # ends of a frontier that are broadcast to the edges


def moves_from(edges: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """The edges (src, dst) that can start at one of the n rows of `ends` (src): of a few, no edge is shuffled for it."""
    return edges.join(F.broadcast(ends.distinct()), "src", "left_semi") if n <= FEW else edges


def hops(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """Least number of directed edges from any seed of a source: (source, id, hop).

    seeds: (source, id), or (id) for one common source 0. Each round joins the frontier with the edges and drops what
    was met before; unreachable nodes are absent. What was met is kept in few tables, as small ones are put together.
    """
    single = "source" not in seeds.columns
    if single:
        seeds = seeds.withColumn("source", F.lit(0))
    edges = edges.select("src", "dst")
    frontier = cut(seeds.select("source", "id").distinct().withColumn("hop", F.lit(0)))
    parts = [(frontier, frontier.count())]
    at = 0
    while most is None or at < most:
        at += 1
        frontier, n = parts[-1][0].where(F.col("hop") == at - 1), parts[-1][1]
        moves = moves_from(edges, frontier.select(F.col("id").alias("src")), n)
        nxt = frontier.join(moves, frontier["id"] == moves["src"]).select("source", F.col("dst").alias("id")).distinct()
        fresh = cut(nxt.join(together([p for p, _ in parts]).select("source", "id"), ["source", "id"], "left_anti").withColumn("hop", F.lit(at)))
        met = fresh.count()
        if not met:
            break
        parts = merged([*parts, (fresh, met)])
    seen = together([p for p, _ in parts])
    return seen.drop("source") if single else seen


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged(parts: list[tuple[DataFrame, int]]) -> list[tuple[DataFrame, int]]:
    """Tables and their rows, the last ones written together until each has twice the rows of the next: there are at
    most log2(rows) of them then, and each row is written about as often."""
    first = len(parts) - 1
    while first and parts[first - 1][1] < 2 * sum(n for _, n in parts[first:]):
        first -= 1
    if first == len(parts) - 1:
        return parts
    old = parts[first:]
    one = cut(together([p for p, _ in old]).coalesce(max(p.rdd.getNumPartitions() for p, _ in old)))
    for p, _ in old:
        drop_cut(p)
    return [*parts[:first], (one, sum(n for _, n in old))]


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 5, distinct_edges: bool = False) -> DataFrame:
    """All paths without a repeated node between the pairs (start, goal): (start, goal, path).

    Paths stop at their goal and have at most max_hops + 1 edges; parallel edges give repeated paths unless
    `distinct_edges`. A pair of equal names has the one-node path.
    """
    moves = edges.select("src", "dst")
    moves = moves.distinct() if distinct_edges else moves
    open_ = pairs.select("start", "goal", F.array("start").alias("path"))
    done = cut(open_.where("start = goal"))
    open_ = cut(open_.where("start <> goal"))
    for _ in range(max_hops + 1):
        reach = moves_from(moves, open_.select(F.element_at("path", -1).alias("src")), open_.count())
        step = open_.withColumn("last", F.element_at("path", -1)).join(reach, F.col("last") == F.col("src"))
        step = step.where(~F.array_contains("path", F.col("dst"))).select("start", "goal", F.concat("path", F.array("dst")).alias("path"), "dst")
        step = cut(step)
        done = done.unionByName(step.where("dst = goal").drop("dst"))
        open_ = step.where("dst <> goal").drop("dst")
        if open_.isEmpty():
            break
    return done


SOURCES_OF_WORD = 64
# Plans that tell how their rows are dealt, and joins on more columns than those they are dealt by.
IN_PLACE = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def predecessor_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """id, between: over all sources, how many edges lead to id from a node one hop nearer; normalised to sum 1.

    edges may list targets outside the graph; sources: id. The searches run together: a row of the state holds, for
    a node and 64 sources, a bit for each that has met the node, and the edges counted so far. Edges and state keep
    their partitioning, so a round is one job with one shuffle, of what the nodes met in the round before send.
    """
    spark = edges.sparkSession
    numbered = dense_index(sources.select("id").distinct(), ["id"], "n")
    bits = numbered.groupBy("id", F.floor(F.col("n") / SOURCES_OF_WORD).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(n % {SOURCES_OF_WORD}))")).alias("fresh"))
    pairs = edges.where("src is not null and dst is not null")
    n_parts = rounds_parts(spark, pairs.count())
    zero = F.lit(0).cast("long")
    with having(spark, IN_PLACE | {"spark.sql.shuffle.partitions": str(n_parts)}):  # Spark deals a table of fewer parts anew
        # Written before they are kept, or the plan of every round would list all that the edges came from.
        written = cut(pairs.repartition(n_parts, "src").groupBy("src", "dst").agg(F.count("*").alias("m")).sortWithinPartitions("src"))
        moves, _ = kept(unsized(written))
        nodes = moves.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(bits.select("id")).repartition(n_parts, "id").distinct()
        state = nodes.crossJoin(F.broadcast(bits.select("word").distinct())).join(bits, ["id", "word"], "left")
        fresh = F.coalesce("fresh", zero)
        state = cut(state.repartition(n_parts, "id").select("id", "word", fresh.alias("seen"), fresh.alias("fresh"), zero.alias("c")))
        while True:
            sent = unsized(state).where("fresh <> 0").select(F.col("id").alias("src"), F.col("word").alias("w"), F.col("fresh").alias("f")).join(moves.hint("merge"), "src")
            sent = sent.select(F.col("dst").alias("to"), "w", "f", "m").repartition(n_parts, "to")
            new = F.col("f").bitwiseAND(F.bitwise_not("seen"))
            step = unsized(state).drop("fresh").join(sent, (F.col("id") == F.col("to")) & (F.col("word") == F.col("w")), "left").withColumn("f", F.coalesce(new, zero))
            step = step.groupBy("id", "word", "seen", "c").agg(F.bit_or("f").alias("fresh"), F.coalesce(F.sum(F.bit_count("f") * F.col("m")), zero).alias("more"))
            met = Observation()
            step = step.select("id", "word", F.col("seen").bitwiseOR(F.col("fresh")).alias("seen"), "fresh", (F.col("c") + F.col("more")).alias("c"))
            old, state = state, cut(step.observe(met, F.count(F.when(F.col("fresh") != 0, 1)).alias("n")))
            drop_cut(old)
            if not met.get["n"]:
                break
    moves.unpersist()
    drop_cut(written)
    counts = unsized(state).groupBy("id").agg(F.sum("c").cast("double").alias("c")).where("c > 0")
    total = counts.agg(F.sum("c").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("id", (F.col("c") / F.col("t")).alias("between"))


ROWS_OF_PART = 20_000


def rounds_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for rounds over a table of so many rows: few for a small one, as each round starts a task for each."""
    cores = spark.sparkContext.defaultParallelism
    return max(min(cores, -(-rows // 1000)), -(-rows // ROWS_OF_PART), 1)
