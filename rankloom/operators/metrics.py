"""Metrics of score vectors, convergence traces and retrieved lists, each one row or a tall table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.statistics import correlation, entropy, gini, kendall, pearson_p, spearman
from rankloom.operators.graph import Graph, dense_index
from rankloom.session import cut


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id", F.col("score").alias("a")).join(b.select("id", F.col("score").alias("b")), "id")


def correctness(scores: DataFrame, truth: DataFrame, p: float = 0.15) -> DataFrame:
    """l1, rmse, linf, sum_deviation, non_negative_rate, floor_rate, pearson, pearson_p, worst_node (least id on ties)."""
    rows = aligned(scores, truth)
    gap = F.abs(F.col("a") - F.col("b"))
    n = scores.agg(F.count("*").alias("n"))
    row = rows.crossJoin(F.broadcast(n)).agg(
        F.count("*").alias("__n"),
        F.sum(gap).alias("l1"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.max(gap).alias("linf"),
        F.abs(F.sum("a") - 1).alias("sum_deviation"),
        F.avg((F.col("a") >= 0).cast("double")).alias("non_negative_rate"),
        F.avg((F.col("a") >= p / F.col("n") - 1e-15).cast("double")).alias("floor_rate"),
        correlation("a", "b").alias("pearson"),
        F.min_by("id", F.struct(F.negative(F.round(gap, 15)), "id")).alias("worst_node"),
    )
    return with_p_value(row, "pearson", "__n", "pearson_p").drop("__n")


def with_p_value(row: DataFrame, r: str, n: str, name: str) -> DataFrame:
    """Add the two-sided p-value of a one-row table's correlation."""
    row = cut(row)
    first = row.first()
    return row.withColumn(name, F.lit(pearson_p(row.sparkSession, first[r], first[n])).cast("double"))


def convergence(trace: DataFrame, p: float = 0.15) -> DataFrame:
    """n_iterations, final_residual, empirical_rate, theoretical_rate, rate_ratio, auc_residual, below_1e3, below_1e6, below_1e8.

    The rate is e to the slope of ln(residual) over its place among the positive residuals; with three or fewer it is
    1 - p. A trace has one row for each iteration, so its windows are small.
    """
    steps = trace.withColumn("before", F.lag("residual").over(Window.orderBy("iter")))
    positive = trace.where("residual > 0").withColumn("i", F.row_number().over(Window.orderBy("iter")) - 1)
    fit = positive.agg(F.when(F.count("*") > 3, F.exp(F.regr_slope(F.ln("residual"), F.col("i").cast("double")))).alias("empirical_rate"))
    first = lambda t: F.min(F.when(F.col("residual") < t, F.col("iter")))
    sums = steps.agg(
        F.count("*").alias("n_iterations"), F.max_by("residual", "iter").alias("final_residual"), F.coalesce(F.sum((F.col("residual") + F.col("before")) / 2), F.lit(0.0)).alias("auc_residual"),
        first(1e-3).alias("below_1e3"), first(1e-6).alias("below_1e6"), first(1e-8).alias("below_1e8"),
    )
    out = sums.crossJoin(fit).withColumn("empirical_rate", F.coalesce("empirical_rate", F.lit(1 - p))).withColumn("theoretical_rate", F.lit(1 - p))
    return out.withColumn("rate_ratio", F.col("empirical_rate") / F.col("theoretical_rate"))


def positions(scores: DataFrame, name: str) -> DataFrame:
    """id and 1-based place by falling score, ties by id."""
    keyed = scores.select("id", (-F.round("score", 12)).alias("__k"))
    return dense_index(keyed, ["__k", "id"], "__i").select("id", (F.col("__i") + 1).alias(name))


def ranking(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """overlap, tau, tau_p, rho, rho_p, ndcg, displacement of the ranking by a against that by b; ndcg's gains are b over its largest."""
    pa, pb = positions(a, "pa"), positions(b, "pb")
    rows = aligned(a, b).join(pa, "id").join(pb, "id").persist()
    top = rows.where(F.col("pa") <= k)
    most = rows.agg(F.max("b").alias("most"))
    gains = rows.where((F.col("pa") <= k) | (F.col("pb") <= k)).crossJoin(F.broadcast(most)).withColumn("g", F.col("b") / F.col("most"))
    part = lambda c: F.sum(F.when(F.col(c) <= k, F.col("g") / F.log2(F.col(c) + 1.0)))
    return (
        top.agg((F.sum((F.col("pb") <= k).cast("int")) / F.lit(float(k))).alias("overlap"), F.avg(F.abs(F.col("pa") - F.col("pb"))).alias("displacement"))
        .crossJoin(kendall(rows, "pa", "pb").select("tau", F.col("p").alias("tau_p")))
        .crossJoin(with_p_value(spearman(rows.select(F.round("a", 12).alias("u"), F.round("b", 12).alias("v")), "u", "v"), "rho", "n", "rho_p").select("rho", "rho_p"))
        .crossJoin(gains.agg((part("pa") / part("pb")).alias("ndcg")))
    )


def structure(scores: DataFrame) -> DataFrame:
    """entropy, gini, alpha, r2, top1_percent, top10_percent, top_node, max_over_mean of a score vector.

    The power law is the regression of ln(rank) on ln(score) over positive scores, null below ten of them.
    """
    n = scores.count()
    rows = positions(scores, "rank").join(scores, "id")
    # Ranks of positive scores are those of all scores, as the others come last.
    fits = rows.where("score > 0").agg(
        F.when(F.count("*") >= 10, -F.regr_slope(F.ln("rank"), F.ln("score"))).alias("alpha"), F.when(F.count("*") >= 10, F.regr_r2(F.ln("rank"), F.ln("score"))).alias("r2")
    )
    share = lambda k: F.sum(F.when(F.col("rank") <= max(1, k), F.col("score")))
    sums = rows.agg(
        entropy(F.col("score")).alias("entropy"), share(n // 100).alias("top1_percent"), share(n // 10).alias("top10_percent"), F.max("score").alias("top_node"),
        (F.max("score") / F.avg("score")).alias("max_over_mean"),
    )
    return sums.crossJoin(gini(scores, "score")).crossJoin(fits)


def degree_correlation(graph: Graph, scores: DataFrame) -> DataFrame:
    """n, spearman, spearman_p, pearson, pearson_p of the score with the weighted in-degree, 0 for nodes that nothing links to."""
    rows = scores.join(graph.in_degree(), "id", "left").fillna(0.0, ["in_degree"]).select(F.round("score", 12).alias("s"), F.round("in_degree", 12).alias("d")).persist()
    both = spearman(rows, "s", "d").select("n", F.col("rho").alias("spearman")).crossJoin(rows.agg(correlation("s", "d").alias("pearson")))
    return with_p_value(with_p_value(both, "spearman", "n", "spearman_p"), "pearson", "n", "pearson_p")


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """method, n, value, p: Pearson's, Spearman's and Kendall's (tau-b) correlation of two columns with two-sided p-values."""
    rows = cut(df.select(a, b).dropna())
    n = F.count("*")
    parts = [
        with_p_value(rows.agg(n.alias("n"), correlation(a, b).alias("value")), "value", "n", "p").withColumn("method", F.lit("pearson")),
        with_p_value(spearman(rows, a, b).withColumnRenamed("rho", "value"), "value", "n", "p").withColumn("method", F.lit("spearman")),
        kendall(rows, a, b).withColumnRenamed("tau", "value").withColumn("method", F.lit("kendall")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("method", "n", "value", "p")


def retrieval(found: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """mrr, hit@k, precision@k, recall@k as a tall table (metric, value); relevant: entity_name.

    Precision divides by k even if fewer rows came; recall by the size of the relevant set.
    """
    total = relevant.distinct().agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("n_relevant"))
    rows = found.join(relevant.distinct().withColumn("r", F.lit(1)), "entity_name", "left").fillna(0, ["r"])
    asked = [F.coalesce(1.0 / F.min(F.when(F.col("r") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        hits = F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0))
        asked += [(hits > 0).cast("double").alias(f"hit@{k}"), (hits / F.lit(float(k))).alias(f"precision@{k}"), (hits / F.first("n_relevant")).alias(f"recall@{k}")]
    wide = rows.crossJoin(F.broadcast(total)).agg(*asked)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias("value")) for c in wide.columns]))
    return wide.select(pairs.alias("x")).select("x.metric", "x.value")


def hop_decay(found: DataFrame) -> DataFrame:
    """hop_distance, n, mean_score, std_score of the reachable results."""
    return found.where("hop_distance is not null").groupBy("hop_distance").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def personalisation(found: DataFrame, seeds: list[str]) -> DataFrame:
    """fidelity (rank correlation of score and nearness, null below three), seed_ratio, mean_hop_top10."""
    reach = found.where("hop_distance is not null").select(F.round("score", 12).alias("s"), (-F.col("hop_distance")).alias("h"))
    seed = F.col("entity_name").isin(seeds)
    sums = found.agg(
        (F.avg(F.when(seed, F.col("score"))) / F.avg(F.when(~seed, F.col("score")))).alias("seed_ratio"), F.avg(F.when(F.col("rank") <= 10, F.col("hop_distance"))).alias("mean_hop_top10")
    )
    return spearman(reach, "s", "h").select(F.when(F.col("n") > 2, F.col("rho")).alias("fidelity")).crossJoin(sums)


def bland_altman(a: DataFrame, b: DataFrame) -> DataFrame:
    """bias, lower, upper: mean difference and 1.96 population deviations about it."""
    d = F.col("a") - F.col("b")
    return aligned(a, b).agg(F.avg(d).alias("bias"), (F.avg(d) - 1.96 * F.stddev_pop(d)).alias("lower"), (F.avg(d) + 1.96 * F.stddev_pop(d)).alias("upper"))


def ccdf(scores: DataFrame) -> DataFrame:
    """score, ccdf: the share of positive scores that are at least as large, by place."""
    positive = scores.where("score > 0")
    n = positive.agg(F.count("*").alias("n"))
    return positions(positive, "rank").join(positive, "id").crossJoin(F.broadcast(n)).select("id", "score", (F.col("rank") / F.col("n")).alias("ccdf"))


def mass_curve(scores: DataFrame) -> DataFrame:
    """rank, mass: the sum of the rank best scores; partition sums first, so no task adds up all rows."""
    rows = positions(scores, "rank").join(scores, "id")
    block = F.floor((F.col("rank") - 1) / 4096)
    sums = rows.groupBy(block.alias("b")).agg(F.sum("score").alias("s"))
    before = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = F.sum("score").over(Window.partitionBy("b").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("b", block).withColumn("inside", inside).join(before, "b").select("rank", (F.col("before") + F.col("inside")).alias("mass"))


@dataclass(frozen=True)
class Scale:
    """Time of an iterative run over a graph, and what follows from it."""

    seconds: float
    iterations: int
    nodes: int
    edges: int

    @staticmethod
    def measure(run: Callable, nodes: int, edges: int, *args, **kwargs) -> tuple[object, Scale]:
        """Runs and times `run`; its result must have `iterations`."""
        began = time.perf_counter()
        out = run(*args, **kwargs)
        return out, Scale(time.perf_counter() - began, out.iterations, nodes, edges)

    def as_dict(self) -> dict[str, float]:
        return {
            "nodes": self.nodes, "edges": self.edges, "iterations": self.iterations, "seconds": self.seconds, "ms_per_iteration": 1000 * self.seconds / max(self.iterations, 1), "edges_per_second": self.edges * self.iterations / max(self.seconds, 1e-12),
            "scalability_index": self.seconds / max(self.nodes + self.edges, 1), "csr_mb": (12 * self.edges + 4 * (self.nodes + 1) + 16 * self.nodes) / 1e6,
        }
