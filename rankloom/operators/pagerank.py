"""PageRank: power iteration, sweeps over the teleport chance, personalisation, closed form."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankloom.operators.graph import Graph, code
from rankloom.session import cut, drop_cut, kept

MOST_DIRECT_NODES = 50_000
MOST_DENSE_NODES = 3000
HUB_EDGES = 5_000_000


@dataclass(frozen=True)
class PageRank:
    """scores: id, score; residuals: the L1 change of each iteration."""

    scores: DataFrame
    residuals: list[float] = field(default_factory=list)
    converged: bool = True

    @property
    def iterations(self) -> int:
        return len(self.residuals)

    def trace(self) -> DataFrame:
        spark = self.scores.sparkSession
        return spark.createDataFrame([(i + 1, r) for i, r in enumerate(self.residuals)], "iter int, residual double")

    def top_k(self, k: int) -> DataFrame:
        return self.scores.orderBy(F.round("score", 12).desc(), "id").limit(k)


def _checked(p: float) -> float:
    if not 0 < p <= 1:
        raise ValueError("the teleport chance must be in (0, 1]")
    return p


@dataclass(frozen=True)
class Moves:
    """Transitions by source, sorted, and apart from them those of hubs: sources of more than HUB_EDGES targets.

    A hub's edges stay spread as they came; there are so few hubs (edges / HUB_EDGES at most) that their scores are
    broadcast to them.
    """

    plain: DataFrame
    hubs: DataFrame | None

    @staticmethod
    def of(graph: Graph, weighted: bool, n_parts: int) -> Moves:
        level = StorageLevel.MEMORY_AND_DISK
        every, _ = kept(graph.counted(weighted, n_parts), level)
        large = cut(every.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB_EDGES).select("src"))
        if large.isEmpty():
            return Moves(every, None)
        hubs = every.join(F.broadcast(large), "src", "left_semi").repartition(n_parts).persist(level)
        plain = every.join(F.broadcast(large), "src", "left_anti").repartition(n_parts, "src").sortWithinPartitions("src").persist(level)
        hubs.count(), plain.count()
        every.unpersist()
        return Moves(plain, hubs)

    def sums(self, ranks: DataFrame, keys: list[str]) -> DataFrame:
        """What arrives at each target (dst, keys, y); added up by target before it is shuffled."""
        part = lambda moves, some: some.join(moves, some["id"] == moves["src"]).select("dst", *keys, (F.col("m") / F.col("total") * F.col("score")).alias("y"))
        got = part(self.plain, ranks)
        if self.hubs is not None:
            few = ranks.join(F.broadcast(self.hubs.select(F.col("src").alias("id")).distinct()), "id", "left_semi")
            got = got.unionByName(part(self.hubs, F.broadcast(few)))
        return got.groupBy("dst", *keys).agg(F.sum("y").alias("y"))

    def every(self) -> DataFrame:
        return self.plain if self.hubs is None else self.plain.unionByName(self.hubs)

    def unpersist(self) -> None:
        self.plain.unpersist()
        if self.hubs is not None:
            self.hubs.unpersist()


def _prepared(graph: Graph, weighted: bool, leak: DataFrame | None) -> tuple[Moves, DataFrame, int]:
    """Transitions by src, and nodes with a dangling flag, both kept in storage with the join's partitioning."""
    n_parts = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = Moves.of(graph, weighted, n_parts)
    has_out = moves.every().select(F.col("src").alias("id")).distinct().withColumn("dangling", F.lit(False))
    if graph.endpoints and not weighted:  # all of them are in the transitions, which are kept
        nodes = moves.every().select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    else:
        nodes = graph.nodes
    nodes = nodes.join(has_out, "id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True)))
    if leak is not None:
        nodes = nodes.join(leak.select("id", F.lit(True).alias("leaks")).distinct(), "id", "left").withColumn("dangling", F.col("dangling") & F.col("leaks").isNull()).drop("leaks")
    nodes, n = kept(nodes.repartition(n_parts, "id"))
    return moves, nodes, n


def pagerank(
    graph: Graph,
    p: float = 0.15,
    tol: float = 1e-8,
    max_iter: int = 200,
    weighted: bool = False,
    start: DataFrame | None = None,
    teleport: DataFrame | None = None,
    leaking: DataFrame | None = None,
) -> PageRank:
    """r' = (1 - p) (A r + D / N) + p v, until the L1 change is below tol; D is the mass on dangling nodes.

    v is uniform, or `teleport` (id, v) normalised, which is then also the start; `start` (id, score) is normalised.
    `leaking` lists nodes without links inside the graph whose mass is to vanish rather than to be spread. tol 0 runs
    max_iter iterations. Each iteration is one job: contributions are summed by target before they are shuffled, the
    edges stay where they are, and the change and the dangling mass come back with the job. Without convergence the
    last scores are returned with a warning.
    """
    _checked(p)
    named = graph
    graph, teleport, start, leaking = _coded(graph, teleport, start, leaking)
    moves, nodes, n = _prepared(graph, weighted, leaking)
    if not n or not max_iter:
        uniform = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("score"))
        return PageRank(_named(uniform, graph, named), [], False)
    base = nodes.withColumn("v", F.lit(1.0 / n))
    if teleport is not None:
        total = teleport.agg(F.sum("v")).first()[0]
        base = nodes.join(teleport.groupBy("id").agg(F.sum("v").alias("t")), "id", "left").select("id", "dangling", (F.coalesce("t", F.lit(0.0)) / F.lit(total)).alias("v"))
    ranks = base.withColumn("score", F.col("v") if teleport is not None else F.lit(1.0 / n))
    if start is not None:
        total = start.agg(F.sum("score")).first()[0]
        ranks = base.join(start.select("id", F.col("score").alias("s")), "id", "left").select("id", "dangling", "v", (F.coalesce("s", F.lit(0.0)) / F.lit(total)).alias("score"))
    ranks = cut(ranks)
    lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("score")))).first()[0] or 0.0
    residuals: list[float] = []
    for _ in range(max_iter):
        sums = moves.sums(ranks, [])
        after = (1 - p) * (F.coalesce("y", F.lit(0.0)) + F.lit(lost / n)) + p * F.col("v")
        step = ranks.join(sums, ranks["id"] == sums["dst"], "left").select("id", "dangling", "v", after.alias("score"), F.abs(after - F.col("score")).alias("change"))
        seen = Observation()
        step = step.observe(seen, F.sum("change").alias("change"), F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0)).alias("lost"))
        old, ranks = ranks, cut(step.drop("change"))
        drop_cut(old)
        residuals.append(seen.get["change"])
        lost = seen.get["lost"] or 0.0
        if residuals[-1] < tol:
            break
    moves.unpersist()
    nodes.unpersist()
    done = residuals[-1] < tol
    if not done and tol > 0:
        warnings.warn(f"no convergence in {max_iter} iterations: {residuals[-1]:.3g}", stacklevel=2)
    return PageRank(_named(ranks.select("id", "score"), graph, named), residuals, done)


def _coded(graph: Graph, *tables: DataFrame | None) -> tuple:
    """The graph and tables with an `id`, names replaced by 64-bit codes where that is exact.

    Edges, scores and what is sent along the edges then take 8 bytes an end instead of a name.
    """
    coded = graph.coded()
    if coded is None:
        return graph, *tables
    return coded, *[t if t is None else t.withColumn("id", code("id")) for t in tables]


def _named(scores: DataFrame, graph: Graph, named: Graph) -> DataFrame:
    if graph is named:
        return scores
    names = named.nodes.select(F.col("id").alias("name"), code("id").alias("id"))
    return scores.join(names, "id").select(F.col("name").alias("id"), "score")


def linear(graph: Graph, p: float = 0.15, teleport: DataFrame | None = None, dense: int = MOST_DENSE_NODES) -> DataFrame:
    """The solution that `direct` gives, for a graph of any size: beyond `dense` nodes no task holds the system.

    Both systems are then solved by x = right + (1 - p) A x over the partitioned edges, each step one job. What is left
    after a step is at most (1 - p) / p times its change; it runs until that is 1e-14 of the whole. Without a teleport
    vector b is a multiple of a, so that only one system is solved.
    """
    _checked(p)
    small = direct(graph, p, teleport, dense, dense)
    if small is not None:
        return small
    named = graph
    graph, teleport = _coded(graph, teleport)
    moves, nodes, n = _prepared(graph, False, None)
    if not n:
        return _named(nodes.select("id", F.lit(0.0).alias("score")), graph, named)
    even = nodes.withColumn("right", F.lit((1 - p) / n))
    if teleport is None:
        b = _fixed_point(moves, even, p)
        a = b.withColumn("score", F.col("score") * F.lit(p / (1 - p))) if p < 1 else nodes.withColumn("score", F.lit(1.0 / n))
        both = a.select("id", "dangling", F.col("score").alias("a")).withColumn("b", F.col("a") * F.lit((1 - p) / p))
    else:
        total = teleport.agg(F.sum("v")).first()[0]
        restart = nodes.join(teleport.groupBy("id").agg(F.sum("v").alias("t")), "id", "left")
        restart = restart.select("id", "dangling", (F.coalesce("t", F.lit(0.0)) * F.lit(p / total)).alias("right"))
        a, b = _fixed_point(moves, restart, p), _fixed_point(moves, even, p)
        both = a.select("id", "dangling", F.col("score").alias("a")).join(b.select("id", F.col("score").alias("b")), "id")
    lost = F.col("dangling")
    s = both.agg(*[F.sum(c).alias(c) for c in "ab"], *[F.coalesce(F.sum(F.when(lost, F.col(c))), F.lit(0.0)).alias(f"d{c}") for c in "ab"]).first()
    share = s["da"] / (1 - s["db"])
    moves.unpersist()
    return _named(both.select("id", ((F.col("a") + F.col("b") * F.lit(share)) / F.lit(s["a"] + s["b"] * share)).alias("score")), graph, named)


def _fixed_point(moves: Moves, nodes: DataFrame, p: float) -> DataFrame:
    """id, dangling, right, score with score = right + (1 - p) A score; nodes: id, dangling, right."""
    x = cut(nodes.withColumn("score", F.col("right")))
    for _ in range(1 if p == 1 else math.ceil(math.log(1e-18) / math.log(1 - p))):
        sums = moves.sums(x, [])
        after = F.col("right") + (1 - p) * F.coalesce("y", F.lit(0.0))
        step = x.join(sums, x["id"] == sums["dst"], "left").select("id", "dangling", "right", after.alias("score"), F.abs(after - F.col("score")).alias("change"))
        seen = Observation()
        old, x = x, cut(step.observe(seen, F.sum("change").alias("change"), F.sum("score").alias("all")).drop("change"))
        drop_cut(old)
        if (1 - p) / p * seen.get["change"] <= 1e-14 * seen.get["all"]:
            break
    return x


def sweep(graph: Graph, chances: list[float], tol: float = 1e-8, max_iter: int = 200) -> tuple[DataFrame, DataFrame]:
    """Scores (p, id, score) and trace (p, iter, residual) for several teleport chances at once.

    The chance is a key of the ranks, so all share each iteration's one pass over the edges; those that converged
    stay as they are.
    """
    for p in chances:
        _checked(p)
    spark = graph.nodes.sparkSession
    moves, nodes, n = _prepared(graph, False, None)
    grid = spark.createDataFrame([(float(p),) for p in chances], "p double")
    ranks = cut(nodes.crossJoin(F.broadcast(grid)).select("id", "p", "dangling", F.lit(1.0 / max(n, 1)).alias("score")))
    lost0 = ranks.agg(F.sum(F.when(F.col("dangling") & (F.col("p") == chances[0]), F.col("score")))).first()[0] or 0.0
    lost = dict.fromkeys(map(float, chances), lost0)
    active, done, trace = list(map(float, chances)), [], []
    for i in range(max_iter):
        mass = F.create_map(*[F.lit(x) for p in active for x in (p, lost[p] / n)])
        sums = moves.sums(ranks, ["p"]).withColumnRenamed("p", "p2")
        after = (1 - F.col("p")) * (F.coalesce("y", F.lit(0.0)) + mass[F.col("p")]) + F.col("p") / F.lit(float(n))
        step = ranks.join(sums, (ranks["id"] == sums["dst"]) & (ranks["p"] == sums["p2"]), "left").select("id", "p", "dangling", after.alias("score"), F.abs(after - F.col("score")).alias("change"))
        seen = Observation()
        asked = []
        for k, p in enumerate(active):
            mine = F.col("p") == p
            asked += [F.sum(F.when(mine, F.col("change"))).alias(f"c{k}"), F.sum(F.when(mine & F.col("dangling"), F.col("score")).otherwise(0.0)).alias(f"d{k}")]
        ranks = cut(step.observe(seen, *asked).drop("change"))
        got = seen.get
        ended = []
        for k, p in enumerate(active):
            trace.append((p, i + 1, got[f"c{k}"]))
            lost[p] = got[f"d{k}"] or 0.0
            if got[f"c{k}"] < tol:
                ended.append(p)
        if ended:
            done.append(ranks.where(F.col("p").isin(ended)))
            active = [p for p in active if p not in ended]
            ranks = ranks.where(F.col("p").isin(active) if active else F.lit(False))
        if not active:
            break
    moves.unpersist()
    nodes.unpersist()
    if active:
        done.append(ranks)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("p", "id", "score"), spark.createDataFrame(trace, "p double, iter int, residual double")


def solved(src: np.ndarray, dst: np.ndarray, w: np.ndarray, p: float, right: np.ndarray, dense: int) -> np.ndarray:
    """Columns x with (I - (1 - p) A) x = right for A[dst, src] = w, whose columns sum to 1 at most.

    Up to `dense` rows by elimination; beyond by the sparse fixed point x = right + (1 - p) A x, whose error shrinks
    by 1 - p a step: it runs until no digit of a double is left to change.
    """
    n = len(right)
    if n <= dense:
        a = np.zeros((n, n))
        np.add.at(a, (dst, src), w)
        return np.linalg.solve(np.eye(n) - (1 - p) * a, right)
    x = right.copy()
    steps = 1 if p == 1 else math.ceil(math.log(1e-18) / math.log(1 - p))
    for _ in range(steps):
        moved = np.stack([np.bincount(dst, weights=w * x[src, k], minlength=n) for k in range(right.shape[1])], axis=1)
        new = right + (1 - p) * moved
        change = np.abs(new - x).sum()
        x = new
        if change <= 1e-17 * np.abs(x).sum():
            break
    return x


def direct(graph: Graph, p: float = 0.15, teleport: DataFrame | None = None, most: int = MOST_DIRECT_NODES, dense: int = MOST_DENSE_NODES) -> DataFrame | None:
    """The solution of the linear system, for graphs of at most `most` nodes, which one task holds; else None.

    With M = I - (1 - p) A, where dangling nodes have empty columns, and d the dangling indicator, the scores are
    a + b (d a) / (1 - d b) for M a = p v and M b = ((1 - p) / N) e; they are clipped at 0 and normalised.
    """
    _checked(p)
    nodes = graph.nodes
    if not 0 < nodes.count() <= most:
        return None
    key = nodes.schema["id"].dataType.simpleString()
    if teleport is not None:
        nodes = nodes.join(teleport.groupBy("id").agg(F.sum("v").alias("v")), "id", "left").fillna(0.0, ["v"])
    else:
        nodes = nodes.withColumn("v", F.lit(1.0))
    rows = nodes.select("id", F.col("id").alias("dst"), F.lit(0.0).alias("w"), "v").unionByName(graph.transitions().select(F.col("src").alias("id"), "dst", "w", F.lit(None).cast("double").alias("v")))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame[frame["v"].notna()].sort_values("id").reset_index(drop=True)
        at = pd.Series(range(len(ids)), index=ids["id"])
        moves = frame[frame["v"].isna()]
        n = len(ids)
        src, dst, w = at[moves["id"]].to_numpy(), at[moves["dst"]].to_numpy(), moves["w"].to_numpy()
        v = ids["v"].to_numpy() / ids["v"].sum()
        d = (np.bincount(src, weights=w, minlength=n) == 0).astype(float)
        both = solved(src, dst, w, p, np.stack([p * v, np.full(n, (1 - p) / n)], axis=1), dense)
        r = both[:, 0] + both[:, 1] * (d @ both[:, 0]) / (1 - d @ both[:, 1])
        r = np.clip(r, 0, None)
        return pd.DataFrame({"id": ids["id"], "score": r / r.sum()})

    return rows.groupBy(F.lit(0).alias("__g")).applyInPandas(solve, f"id {key}, score double")


def compare_direct(graph: Graph, scores: DataFrame, p: float = 0.15, top: int = 10, most: int = MOST_DIRECT_NODES) -> DataFrame:
    """l1, linf and top-`top` overlap of scores against the closed form, or one row with `error` set."""
    exact = direct(graph, p, most=most)
    spark = scores.sparkSession
    if exact is None:
        return spark.createDataFrame([(None, None, None, "the graph is too large for the closed form")], "l1 double, linf double, overlap double, error string")
    both = scores.join(exact.withColumnRenamed("score", "exact"), "id")
    gap = F.abs(F.col("score") - F.col("exact"))
    best = lambda c: both.orderBy(F.round(c, 12).desc(), "id").limit(top).select("id")
    shared = best("score").join(best("exact"), "id", "left_semi").agg((F.count("*") / F.lit(float(top))).alias("overlap"))
    return both.agg(F.sum(gap).alias("l1"), F.max(gap).alias("linf")).crossJoin(shared).withColumn("error", F.lit(None).cast("string"))
