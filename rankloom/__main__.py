"""python -m rankloom rank [--data EDGES] [--p P] [--out FOLDER] | crawl [--pages PARQUET] [--k K] [--p P] [--out FOLDER]"""

from __future__ import annotations

import argparse
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import crawl, experiments, metrics
from rankloom.operators.graph import Graph
from rankloom.operators.pagerank import pagerank, sweep
from rankloom.session import session
from rankloom.sources.edges import literal_edges, read_edge_list
from rankloom.sources.sinks import Publisher, console, sweep_pivot

SMALL = [(0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (5, 0)]


def rank(spark: SparkSession, data: str | None, p: float, out: str, chances: list[float], tol: float = 1e-8) -> list[str]:
    """Scores of an edge list, or, with a warning, of a graph of six nodes where the file is missing, and their metric tables."""
    try:
        edges = read_edge_list(spark, data) if data else literal_edges(spark, SMALL)
    except FileNotFoundError as missing:
        warnings.warn(f"{missing}: scores are those of a graph of six nodes", stacklevel=2)
        edges = literal_edges(spark, SMALL)
    graph = Graph.of(edges.persist())
    size = graph.summary().first()
    done, scale = metrics.Scale.measure(pagerank, size["n_nodes"], size["n_edges"], graph, p, tol, 300)
    base = pagerank(graph, 0.10, tol, 300)
    _, trace = sweep(graph, chances, tol, 300)
    tables = Publisher(spark, out)
    tables.add_table("correctness", "Correctness", metrics.correctness(done.scores, base.scores, p)).add_table("convergence", "Convergence", metrics.convergence(done.trace(), p))
    tables.add_table("ranking", "Ranking", metrics.ranking(done.scores, base.scores)).add_table("structure", "Structure", metrics.structure(done.scores))
    tables.add_table("scale", "Scale", spark.createDataFrame([tuple(scale.as_dict().values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in scale.as_dict().items())))
    rows = trace.groupBy("p").agg(F.count("*").alias("iterations"), F.max_by("residual", "iter").alias("residual"))
    tall = rows.select("p", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("iterations", "residual")])).alias("x")).select("p", "x.*")
    tables.add_figure("sweep", sweep_pivot(tall.withColumn("p", F.format_string("p_%.2f", "p")), "p")).add_figure("ccdf", metrics.ccdf(done.scores)).add_figure("trace", trace)
    print(console(done.top_k(20), ["id", "score"]))
    return tables.publish()


def pages_web(spark: SparkSession, pages: DataFrame, p: float) -> crawl.Web:
    """Urls of a table (url, html) and their references resolved against scheme and host."""
    base = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    refs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="(/[^"]*)"'), 1)
    links = pages.select(F.col("url").alias("src"), base.alias("base"), F.explode(refs).alias("ref")).select("src", F.concat("base", "ref").alias("dst")).persist()
    urls = pages.select("url").where("url is not null").distinct().persist()
    scores = pagerank(Graph.of(links, urls.select(F.col("url").alias("id"))), p, 1e-10).scores
    return crawl.Web(urls, links, scores.select(F.col("id").alias("url"), "score"))


def order(spark: SparkSession, pages: str, k: int, p: float, out: str) -> list[str]:
    """The k urls to crawl next, and the experiments as tables."""
    web = pages_web(spark, spark.read.parquet(pages), p)
    prior = crawl.Prioritizer(web)
    print(prior.policy())
    print(console(prior.top_k(k), ["priority", "url", "reason"], 55, k))
    results = Publisher(spark, out)
    for name, frame in experiments.run_all(web).items():
        results.add_figure(name, frame)
    return results.publish()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rankloom", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("rank")
    one.add_argument("--data")
    two = jobs.add_parser("crawl")
    two.add_argument("--pages", required=True)
    two.add_argument("--k", type=int, default=10)
    for x in (one, two):
        x.add_argument("--p", type=float, default=0.15)
        x.add_argument("--out", default=str(Path.cwd() / "results"))
    args = parser.parse_args(argv)
    spark = session()
    if args.job == "rank":
        paths = rank(spark, args.data, args.p, args.out, experiments.CHANCES)
    else:
        paths = order(spark, args.pages, args.k, args.p, args.out)
    print("\n".join(paths))


if __name__ == "__main__":
    main()
