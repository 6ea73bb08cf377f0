"""Crawl ordering: heuristics as column expressions, the two-signal prioritiser."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.robots import gate
from rankloom.functions.statistics import min_max
from rankloom.functions.urls import with_signals

QWA = {"pr": 0.45, "rep": 0.30, "tld": 0.15, "dep": 0.10}


@dataclass(frozen=True)
class Web:
    """urls: url; links: src, dst as listed, targets outside the graph included; pageranks: url, score; robots: domain, content or None."""

    urls: DataFrame
    links: DataFrame
    pageranks: DataFrame
    robots: DataFrame | None = None

    def measured(self) -> DataFrame:
        """Each url with pagerank (0 if unknown), out_degree over all listed links, and the url signals."""
        out = self.links.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("out_degree"))
        rows = self.urls.join(self.pageranks.select("url", F.col("score").alias("pagerank")), "url", "left").join(out, "url", "left")
        return with_signals(rows.fillna(0, ["out_degree"]).fillna(0.0, ["pagerank"]))

    def normalised(self) -> DataFrame:
        """The same with every ranking signal scaled over all urls, before any gate; 0.5 where all are equal."""
        columns = {"pagerank": "pr_norm", "out_degree": "out_norm", "reputation": "rep_norm", "tld_score": "tld_norm", "depth": "dep_norm"}
        return min_max(self.measured(), columns, 0.5)


@dataclass(frozen=True)
class Heuristic:
    """name; score and reason as expressions over `Web.normalised`; whether robots.txt gates the urls."""

    name: str
    score: Callable[[], Column]
    reason: Callable[[], Column]
    gated: bool = False


def _random() -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("42"), F.col("url"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def _fixed(pattern: str, *columns: str) -> Callable[[], Column]:
    return lambda: F.format_string(pattern, *[F.col(c) for c in columns])


def quality_weighted(weights: dict[str, float] | None = None, name: str = "H4_QWA") -> Heuristic:
    """PageRank, reputation, top-level domain and depth, weighted; weights given replace the usual ones."""
    w = QWA | (weights or {})
    score = lambda: w["pr"] * F.col("pr_norm") + w["rep"] * F.col("rep_norm") + w["tld"] * F.col("tld_norm") + w["dep"] * F.col("dep_norm")
    return Heuristic(name, score, _fixed("PR=%.3f rep=%.2f tld=%.2f depth=%.2f", "pr_norm", "reputation", "tld_score", "depth"), True)


def heuristics() -> dict[str, Heuristic]:
    """The five, by name."""
    every = [
        Heuristic("H0_Random", _random, lambda: F.lit("random baseline")),
        Heuristic("H1_PurePageRank", lambda: F.col("pr_norm"), _fixed("PR=%.5f (authority from inbound links)", "pagerank")),
        Heuristic("H2_HubAuthority", lambda: 0.60 * F.col("pr_norm") + 0.40 * F.col("out_norm"), _fixed("PR_norm=%.3f × hub_norm=%.3f", "pr_norm", "out_norm")),
        Heuristic("H3_PR_Robots", lambda: F.col("pr_norm"), _fixed("PR_norm=%.3f (robots-permitted)", "pr_norm"), True),
        quality_weighted(),
    ]
    return {h.name: h for h in every}


def ranked(web: Web, which: Heuristic, k: int | None = None, normal: DataFrame | None = None) -> DataFrame:
    """The urls by falling score, ties by url: heuristic, rank, url, score, reason and the signals.

    With k only the k best are sorted out and numbered; k None or 0 means all, numbered over range partitions.
    """
    rows = web.normalised() if normal is None else normal
    rows = gate(rows, web.robots) if which.gated else rows
    rows = rows.withColumns({"score": which.score(), "reason": which.reason()}).withColumn("__key", F.round("score", 12))
    order = [F.col("__key").desc(), F.col("url")]
    if k:
        out = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        from rankloom.operators.graph import dense_index

        out = dense_index(rows.withColumn("__neg", -F.col("__key")), ["__neg", "url"], "__i").withColumn("rank", (F.col("__i") + 1).cast("int")).drop("__neg", "__i")
    return out.drop("__key").withColumn("heuristic", F.lit(which.name))


def signals_map() -> Column:
    """The signals behind a quality-weighted score as a map: scaled (`_norm`) and raw ones."""
    names = {"pr_norm": "pr_norm", "rep_norm": "rep_norm", "tld_norm": "tld_norm", "dep_norm": "dep_norm", "pr_raw": "pagerank", "rep_raw": "reputation", "tld_raw": "tld_score"}
    return F.create_map(*[x for n, c in names.items() for x in (F.lit(n), F.col(c).cast("double"))])


def all_ranked(web: Web, k: int | None = None) -> DataFrame:
    """The five rankings one above the other, from one computation of the signals."""
    normal = web.normalised().persist()
    out = None
    for h in heuristics().values():
        part = ranked(web, h, k, normal)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Prioritizer:
    """PageRank and out-degree, scaled over the permitted urls only (0 where all are equal), weighted."""

    web: Web
    w_pr: float = 0.75
    w_out: float = 0.25
    check_robots: bool = False
    thresholds: tuple[float, float, float] = field(default=(0.7, 0.4, 0.6))

    def scored(self) -> DataFrame:
        rows = self.web.measured().select("url", "pagerank", "out_degree")
        rows = gate(rows, self.web.robots) if self.check_robots else rows
        rows = min_max(rows, {"pagerank": "pr_norm", "out_degree": "od_norm"}, 0.0)
        very, some, hub = self.thresholds
        # The phrases of a reason.
        reason = F.concat_ws(
            "; ",
            F.lit("robots.txt permits AI crawlers"),
            F.when(F.col("pr_norm") > very, "very high PageRank authority").when(F.col("pr_norm") > some, "moderate PageRank authority"),
            F.when(F.col("od_norm") > hub, "high out-degree hub"),
        )
        priority = self.w_pr * F.col("pr_norm") + self.w_out * F.col("od_norm")
        return rows.withColumns({"priority": priority, "reason": reason, "robots_ok": F.lit(True)})

    def top_k(self, k: int = 10) -> DataFrame:
        rows = self.scored()
        return rows.orderBy(F.round("priority", 12).desc(), "url").limit(k).select("priority", "url", "pagerank", "out_degree", "robots_ok", "reason")

    def policy(self) -> str:
        return (
            f"1. Urls whose robots.txt bars AI crawlers are left out.\n2. The rest are ranked by {self.w_pr:.0%} PageRank (authority) and {self.w_out:.0%} out-degree (hubs).\n"
            "PageRank stands for editorial endorsement, which goes with accurate and well-kept pages; robots.txt is a hard filter, so all that is returned is permitted."
        )
