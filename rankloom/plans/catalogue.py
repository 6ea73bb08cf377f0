"""The queries, each beside the same in DuckDB SQL."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import robots as robots_
from rankloom.functions import statistics as st
from rankloom.functions import urls
from rankloom.operators import crawl, metrics
from rankloom.operators import experiments as ex
from rankloom.operators import pagerank as pr
from rankloom.operators import retrieval as rt
from rankloom.operators import traverse as tv
from rankloom.operators.graph import Graph, dense_index
from rankloom.plans import sql as q
from rankloom.plans import tables as tb
from rankloom.session import checkpoint_folder
from rankloom.sources import edges as se
from rankloom.sources import sinks
from rankloom.sources import triples as tr
from rankloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


PART, TRADE, EVENT = q.graph(tb.PART_EDGES), q.graph(tb.TRADE_EDGES), q.graph(tb.EVENT_EDGES)
P15, P10 = q.iterate("a", 10, 0.15), q.iterate("b", 10, 0.10)
SEED_LIST = ", ".join(map(tb.quoted, tb.SEEDS))

# --- graphs ---------------------------------------------------------------------------------------------------------


@query(tb.PART_EDGES)
def edge_list(spark, sf):
    return tb.part_graph(spark, sf).edges.select("src", "dst")


@query(f"SELECT src AS id FROM ({tb.PART_EDGES}) UNION SELECT dst FROM ({tb.PART_EDGES})")
def node_universe(spark, sf):
    return tb.part_graph(spark, sf).nodes


@query(f"SELECT src AS id, count(*) AS out_degree FROM ({tb.PART_EDGES}) GROUP BY src")
def out_degree(spark, sf):
    return tb.part_graph(spark, sf).out_degree()


@query(f"SELECT src AS id, round(sum(weight), 6) AS weighted_out_degree FROM ({tb.EVENT_EDGES}) GROUP BY src")
def weighted_out_degree(spark, sf):
    return rounded(tb.event_graph(spark, sf).weighted_out_degree(), 6)


@query(q.with_(PART, "SELECT dst AS id, round(sum(w), 9) AS in_degree FROM t GROUP BY dst"))
def in_degree_weighted(spark, sf):
    return rounded(tb.part_graph(spark, sf).in_degree())


@query(q.with_(TRADE, "SELECT id FROM d"))
def dangling_nodes(spark, sf):
    return tb.trade_graph(spark, sf).dangling()


SUMMARY = "SELECT '{0}' AS graph, (SELECT count(*) FROM ({1})) AS n_edges, (SELECT count(*) FROM (SELECT src FROM ({1}) UNION SELECT dst FROM ({1}))) AS n_nodes, (SELECT count(DISTINCT src) FROM ({1})) AS n_sources"


@query(
    "SELECT graph, n_nodes, n_edges, n_nodes - n_sources AS n_dangling, round(n_edges / greatest(n_nodes::DOUBLE * n_nodes, 1), 9) AS density FROM ("
    + " UNION ALL ".join(SUMMARY.format(n, e) for n, e in (("part", tb.PART_EDGES), ("trade", tb.TRADE_EDGES), ("event", tb.EVENT_EDGES)))
    + ")"
)
def graph_summary(spark, sf):
    parts = [g(spark, sf).summary().select(F.lit(n).alias("graph"), "*") for n, g in (("part", tb.part_graph), ("trade", tb.trade_graph), ("event", tb.event_graph))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(q.with_(PART, "SELECT src, dst, round(w, 12) AS w FROM t"))
def transition_weights(spark, sf):
    return rounded(tb.part_graph(spark, sf).transitions(), 12)


@query(f"SELECT src, dst, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY src), 9) AS w FROM ({tb.EVENT_EDGES}) GROUP BY src, dst")
def transition_weights_weighted(spark, sf):
    return rounded(tb.event_graph(spark, sf).transitions(weighted=True))


@query(q.with_(PART, "SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM n"))
def node_index(spark, sf):
    return dense_index(tb.part_graph(spark, sf).nodes, ["id"])


@query("SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber % 5 IN (1, 2)")
def edge_file(spark, sf):
    """Lines with comments, tabs, extra fields, words and single fields, written as text and read as an edge list."""
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    kind = F.col("l_linenumber") % 5
    line = F.when(kind == 0, F.concat(F.lit("# "), a, F.lit(" "), b)).when(kind == 1, F.concat(a, F.lit("\t"), b)).when(kind == 2, F.concat(F.lit("  "), a, F.lit("   "), b, F.lit(" x ")))
    line = line.when(kind == 3, F.concat(a, F.lit(" b"), b)).otherwise(a)
    path = f"{checkpoint_folder(spark)}/edge-file"
    tb.read(spark, sf, "lineitem").select(line.alias("value")).write.mode("overwrite").text(path)
    return se.read_edge_list(spark, path)


# --- PageRank -------------------------------------------------------------------------------------------------------


@query(q.with_([*PART, *P15], "SELECT id, round(s, 10) AS score FROM a10 ORDER BY round(s, 12) DESC, id LIMIT 20"))
def pagerank_topk(spark, sf):
    return rounded(tb.part_rank(spark, sf).top_k(20), 10)


@query(q.with_([*PART, *P15], "SELECT id, round(s, 10) AS score FROM a10"))
def pagerank_fixed10(spark, sf):
    return rounded(tb.part_rank(spark, sf).scores, 10)


@query(q.with_([*TRADE, *q.iterate("a", 8, 0.15)], "SELECT id, round(s, 10) AS score FROM a8"))
def pagerank_dangling(spark, sf):
    return rounded(pr.pagerank(tb.trade_graph(spark, sf), 0.15, tol=0, max_iter=8).scores, 10)


@query(q.with_([*PART, *q.iterate("a", 40, 0.15)], "SELECT id, round(s, 8) AS score FROM a40"))
def pagerank_converged(spark, sf):
    return rounded(pr.pagerank(tb.part_graph(spark, sf), 0.15, tol=1e-12).scores, 8)


@query(q.with_([*PART, *P15, q.residuals("a", 10)], "SELECT iter, round(residual, 10) AS residual FROM tr"))
def pagerank_trace(spark, sf):
    return rounded(tb.part_rank(spark, sf).trace(), 10)


@query(q.with_([*PART, *[t for i, p in enumerate((0.1, 0.15, 0.5, 0.85)) for t in q.iterate(f"s{i}_", 6, p)]], " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, id, round(s, 10) AS score FROM s{i}_6" for i, p in enumerate((0.1, 0.15, 0.5, 0.85)))))
def pagerank_sweep(spark, sf):
    return rounded(pr.sweep(tb.part_graph(spark, sf), [0.1, 0.15, 0.5, 0.85], tol=0, max_iter=6)[0], 10)


WEIGHTED = ["tw AS MATERIALIZED (SELECT src, dst, sum(weight) / sum(sum(weight)) OVER (PARTITION BY src) AS w FROM e GROUP BY src, dst)"]


@query(q.with_([*EVENT, *WEIGHTED, *q.iterate("a", 10, 0.15, t="tw")], "SELECT id, round(s, 10) AS score FROM a10"))
def pagerank_weighted(spark, sf):
    return rounded(pr.pagerank(tb.event_graph(spark, sf), 0.15, tol=0, max_iter=10, weighted=True).scores, 10)


@query(q.with_([*PART, *q.iterate("a", 14, 0.15)], "SELECT id, round(s, 10) AS score FROM a14"))
def pagerank_warm_start(spark, sf):
    before = tb.part_rank(spark, sf).scores
    return rounded(pr.pagerank(tb.part_graph(spark, sf), 0.15, tol=0, max_iter=4, start=before).scores, 10)


# Links to urls outside count as links, and a url with only such links loses its mass.
OUTSIDE = "refs > 0"


@query(q.with_([tb.WEB, *q.graph("SELECT src, dst FROM links", "SELECT url AS id FROM web"), f"leak AS (SELECT id FROM d WHERE id NOT IN (SELECT url FROM web WHERE {OUTSIDE}))", *q.iterate("a", 6, 0.15, d="leak")], "SELECT id, round(s, 10) AS score FROM a6"))
def pagerank_leaking(spark, sf):
    sites, links, _ = tb.web_links(spark, sf)
    graph = Graph.of(links, sites.select(F.col("url").alias("id")))
    return rounded(pr.pagerank(graph, 0.15, tol=0, max_iter=6, leaking=sites.where(OUTSIDE).select(F.col("url").alias("id"))).scores, 10)


@query(q.with_([*EVENT, *q.iterate("a", 60, 0.15)], "SELECT id, round(s, 9) AS score FROM a60"))
def pagerank_analytical(spark, sf):
    return rounded(pr.direct(tb.event_graph(spark, sf), 0.15), 9)


@query("SELECT 0.0::DOUBLE AS l1, 0.0::DOUBLE AS linf, 1.0::DOUBLE AS overlap, NULL::VARCHAR AS error")
def analytical_vs_iterative(spark, sf):
    graph = tb.event_graph(spark, sf)
    return rounded(pr.compare_direct(graph, pr.pagerank(graph, 0.15, tol=1e-13).scores, 0.15, 5), 9)


@query(q.with_([*PART, *q.iterate("a", 2, 0.15)], "SELECT NULL::DOUBLE AS l1, NULL::DOUBLE AS linf, NULL::DOUBLE AS overlap, 'the graph is too large for the closed form' AS error"))
def analytical_too_large(spark, sf):
    return pr.compare_direct(tb.trade_graph(spark, sf), tb.part_rank(spark, sf).scores.select(F.col("id").cast("string").alias("id"), "score"), most=100)


@query(q.with_([*TRADE, *q.iterate("a", 45, 0.5)], "SELECT id, round(s, 10) AS score FROM a45"))
def pagerank_analytical_sparse(spark, sf):
    """The linear system of the trade graph, beyond the size that is solved densely."""
    return rounded(pr.linear(tb.trade_graph(spark, sf), 0.5), 10)


@query(q.with_([tb.WEB, *q.graph("SELECT src, dst FROM links", "SELECT url AS id FROM web"), *q.iterate("w", 10, 0.15)], "SELECT id AS url, round(s, 10) AS score FROM w10"))
def pagerank_urls(spark, sf):
    return rounded(tb.web(spark, sf).pageranks, 10)


# --- knowledge graph ------------------------------------------------------------------------------------------------

RESTART = [f"v AS MATERIALIZED (SELECT id, CASE WHEN id IN ({SEED_LIST}) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS v FROM n)"]
REACH = [
    f"reach(id, hop) AS (SELECT id, 0 FROM n WHERE id IN ({SEED_LIST}) UNION SELECT e.dst, r.hop + 1 FROM reach r JOIN e ON e.src = r.id WHERE r.hop < 8)",
    "hop AS (SELECT id, min(hop) AS hop FROM reach GROUP BY id)",
]
PPR = [*TRADE, *RESTART, *q.iterate("a", 10, 0.15, v="v"), *REACH]
FOUND = "found AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round(s, 12) DESC, id)::INT AS rank, id AS entity_name, s AS score, hop AS hop_distance FROM (SELECT * FROM a10 ORDER BY round(s, 12) DESC, id LIMIT 20) LEFT JOIN hop USING (id))"


@tb.once
def found(spark, sf):
    return rt.retrieve(tb.trade(spark, sf), tb.SEEDS, 20, tol=0, max_iter=10).persist()


@query(q.with_([*PPR, FOUND], "SELECT rank, entity_name, round(score, 10) AS score, hop_distance FROM found", True))
def ppr_topk(spark, sf):
    return rounded(found(spark, sf), 10)


@query(
    q.with_(
        PPR,
        f"SELECT row_number() OVER (ORDER BY round(s, 12) DESC, id)::INT AS rank, id AS entity_name, round(s, 10) AS score, hop AS hop_distance FROM (SELECT * FROM a10 WHERE id NOT IN ({SEED_LIST}) ORDER BY round(s, 12) DESC, id LIMIT 15) LEFT JOIN hop USING (id)",
        True,
    )
)
def ppr_exclude_seeds(spark, sf):
    return rounded(rt.retrieve(tb.trade(spark, sf), tb.SEEDS, 15, exclude_seeds=True, tol=0, max_iter=10), 10)


@query(q.with_([*TRADE, *q.iterate("a", 6, 0.15)], "SELECT row_number() OVER (ORDER BY round(s, 12) DESC, id)::INT AS rank, id AS entity_name, round(s, 10) AS score, NULL::INT AS hop_distance FROM (SELECT * FROM a6 ORDER BY round(s, 12) DESC, id LIMIT 10)"))
def ppr_unknown_seed_uniform(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return rounded(rt.retrieve(tb.trade(spark, sf), ["nobody"], 10, tol=0, max_iter=6), 10)


@query(q.with_([*TRADE, *REACH], "SELECT id, hop FROM hop", True))
def bfs_hops(spark, sf):
    return tv.hops(tb.trade(spark, sf).edges(), spark.createDataFrame([(s,) for s in tb.SEEDS], "id string"))


@query(q.with_([*TRADE, "reach(source, id, hop) AS (SELECT id, id, 0 FROM n WHERE id LIKE 'supplier:%' UNION SELECT r.source, e.dst, r.hop + 1 FROM reach r JOIN e ON e.src = r.id WHERE r.hop < 8)"], "SELECT source, id, min(hop) AS hop FROM reach GROUP BY source, id", True))
def bfs_multi_source(spark, sf):
    kg = tb.trade(spark, sf)
    return tv.hops(kg.edges(), kg.entities.where("type = 'supplier'").select(F.col("name").alias("source"), F.col("name").alias("id")))


PATHS = [
    *TRADE,
    "goals(goal) AS (SELECT id FROM n WHERE id LIKE 'region:%')",
    "walk(path, node) AS (SELECT ['customer:1'], 'customer:1' UNION ALL SELECT list_append(w.path, e.dst), e.dst FROM walk w JOIN e ON e.src = w.node WHERE len(w.path) <= 6 AND NOT list_contains(w.path, e.dst) AND w.node NOT LIKE 'region:%')",
    "paths AS MATERIALIZED (SELECT node AS goal, array_to_string(path, ' -> ') AS path, len(path) AS nodes FROM walk WHERE node IN (SELECT goal FROM goals))",
]


def _region_paths(spark, sf):
    kg = tb.trade(spark, sf)
    goals = kg.entities.where("type = 'region'").select(F.lit("customer:1").alias("start"), F.col("name").alias("goal"))
    return tv.simple_paths(kg.edges(), goals, 5)


@query(q.with_(PATHS, "SELECT goal, path FROM paths", True))
def simple_paths(spark, sf):
    return _region_paths(spark, sf).select("goal", rt.arrow("path").alias("path"))


@query(q.with_(PATHS, "SELECT goal, min(nodes) AS nodes, arg_min(path, lpad(nodes::VARCHAR, 4, '0') || path) AS path FROM paths GROUP BY goal", True))
def shortest_chain(spark, sf):
    text = rt.arrow("path")
    return _region_paths(spark, sf).groupBy("goal").agg(F.min(F.size("path")).cast("long").alias("nodes"), F.min(F.struct(F.size("path"), text.alias("t")))["t"].alias("path"))


CHAINS = [
    *PPR, FOUND,
    f"goals AS (SELECT entity_name AS goal, rank AS gi FROM found WHERE entity_name NOT IN ({SEED_LIST}) ORDER BY rank LIMIT 5)",
    f"starts(start, si) AS (VALUES {', '.join(f'({tb.quoted(s)}, {i})' for i, s in enumerate(tb.SEEDS))})",
    "walk(start, goal, path, node) AS (SELECT start, goal, [start], start FROM starts, goals UNION ALL SELECT w.start, w.goal, list_append(w.path, e.dst), e.dst FROM walk w JOIN e ON e.src = w.node WHERE len(w.path) <= 7 AND w.node <> w.goal AND NOT list_contains(w.path, e.dst))",
    "got AS (SELECT start, goal, path FROM walk WHERE node = goal)",
    "per AS (SELECT si, gi, start, goal, count(*) AS n FROM got JOIN starts USING (start) JOIN goals USING (goal) GROUP BY ALL)",
    "taken AS (SELECT * FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY si, gi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per) WHERE before < 10)",
]


@query(q.with_(CHAINS, "SELECT row_number() OVER (ORDER BY si, gi, len(path), array_to_string(path, chr(1)))::INT AS place, array_to_string(path, ' -> ') AS path FROM got JOIN taken USING (start, goal)", True))
def reasoning_chains(spark, sf):
    return rt.chains(tb.trade(spark, sf), tb.SEEDS, found(spark, sf), 6).select("place", rt.arrow("path").alias("path"))


@query(f"SELECT object AS name FROM ({tb.TRIPLES}) WHERE subject = 'order:1'")
def neighbors(spark, sf):
    return tb.trade(spark, sf).neighbors("order:1")


@query(f"SELECT subject AS name FROM ({tb.TRIPLES}) WHERE object = 'supplier:1'")
def in_neighbors(spark, sf):
    return tb.trade(spark, sf).in_neighbors("supplier:1")


@query(f"SELECT relation, object, 1.0::DOUBLE AS weight FROM ({tb.TRIPLES}) WHERE subject = 'customer:1'")
def relations_from(spark, sf):
    return tb.trade(spark, sf).relations_from("customer:1")


@query(f"SELECT (SELECT count(*) FROM (SELECT subject FROM ({tb.TRIPLES}) UNION SELECT object FROM ({tb.TRIPLES}))) AS n_entities, (SELECT count(*) FROM ({tb.TRIPLES})) AS n_relations")
def entity_counts(spark, sf):
    return tb.trade(spark, sf).counts()


@query(f"SELECT name, split_part(name, ':', 1) AS type FROM (SELECT subject AS name FROM ({tb.TRIPLES}) UNION SELECT object FROM ({tb.TRIPLES}))")
def entity_types(spark, sf):
    return tb.trade(spark, sf).entities.select("name", "type")


@query("SELECT 'nation:3' AS name, 'nation' AS type")
def entity_lookup(spark, sf):
    return tb.trade(spark, sf).entity("nation:3").select("name", "type")


@query(f"SELECT relation, count(*) AS n FROM (SELECT relation FROM ({tb.TRIPLES}) UNION ALL SELECT 'follows' FROM ({tb.EVENT_EDGES})) GROUP BY relation")
def kg_add_knowledge(spark, sf):
    more = tb.event_graph(spark, sf).edges
    more = more.select(
        F.col("src").alias("subject"), F.lit("follows").alias("relation"), F.col("dst").alias("object"), "weight", F.lit("event").alias("subject_type"), F.lit("event").alias("object_type"),
        F.expr("map()").cast("map<string,string>").alias("metadata"), F.lit(1).cast("long").alias("seq"),
    )
    return tb.trade(spark, sf).with_triples(more).relations.groupBy("relation").agg(F.count("*").alias("n"))


WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part"


@query(
    f"""WITH hit AS (SELECT doc_id AS id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS place
  FROM documents JOIN ({WORDS}) ON contains(lower(text), lower(name))) SELECT id, place::INT AS place, name FROM hit WHERE place <= 5"""
)
def seed_extraction(spark, sf):
    names = tb.read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct().withColumn("seq", F.col("name"))
    return rt.seeds_of_texts(tb.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), names)


@query(q.with_([*TRADE, "v AS MATERIALIZED (SELECT id, CASE WHEN id = 'customer:1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM n)", *q.iterate("a", 10, 0.15, v="v")], "SELECT row_number() OVER (ORDER BY round(s, 8) DESC, id)::INT AS rank, id AS entity_name, round(s, 8) AS score FROM (SELECT * FROM a10 ORDER BY round(s, 8) DESC, id LIMIT 5)"))
def engine_query(spark, sf):
    engine = rt.QueryEngine(tb.trade(spark, sf), k=12, tol=0, max_iter=10)
    answer = engine.query("Which parts did Customer:1 order?")
    keyed = answer.entities.select("entity_name", F.round("score", 8).alias("score"))
    order = [F.col("score").desc(), F.col("entity_name")]
    return keyed.orderBy(*order).limit(5).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("SELECT 'nation:' || n_nationkey AS subject, 'in_region' AS relation, 'region:' || n_regionkey AS object, 1.0::DOUBLE AS weight, 'nation' AS subject_type, 'region' AS object_type FROM nation")
def kg_json_roundtrip(spark, sf):
    rows = tb.trade_triples(spark, sf).where("relation = 'in_region'")
    path = f"{checkpoint_folder(spark)}/kg-json"
    tr.save_json(tr.KnowledgeGraph.of(rows), path)
    return tr.from_indexed(*tr.load_json(spark, path)).relations.select("subject", "relation", "object", "weight", "subject_type", "object_type")


ANSWER = [
    *TRADE, "v AS MATERIALIZED (SELECT id, CASE WHEN id = 'customer:1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM n)", *q.iterate("a", 10, 0.15, v="v"),
    "reach(id, hop) AS (SELECT id, 0 FROM n WHERE id = 'customer:1' UNION SELECT e.dst, r.hop + 1 FROM reach r JOIN e ON e.src = r.id WHERE r.hop < 8)",
    "hop AS (SELECT id, min(hop) AS hop FROM reach GROUP BY id)",
    "best AS (SELECT row_number() OVER (ORDER BY round(s, 12) DESC, id) AS rank, id, s, hop FROM (SELECT * FROM a10 ORDER BY round(s, 12) DESC, id LIMIT 3) LEFT JOIN hop USING (id))",
]


@query(
    q.with_(
        ANSWER,
        """SELECT '  #' || lpad(rank::VARCHAR, 2, '0') || '  ' || rpad(id, 35, ' ') || '  score=' || printf('%.6f', s) || coalesce('  hop=' || hop, '') AS line FROM best
  UNION ALL SELECT 'Query   : Which parts did Customer:1 order?' UNION ALL SELECT 'Seeds   : customer:1'
  UNION ALL SELECT 'Restarting at "customer:1", the walk visits most often ' || (SELECT string_agg('"' || id || '"', ', ' ORDER BY rank) FROM best) || '.'""",
        True,
    )
)
def answer_text(spark, sf):
    """Lines of an answer as text: query, seeds, the three best entities, and what the explanation says of them."""
    text = rt.QueryEngine(tb.trade(spark, sf), k=3, tol=0, max_iter=10).query("Which parts did Customer:1 order?").text()
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "line string")
    return lines.where("line like '  #%' or line like 'Query   :%' or line like 'Seeds   :%' or line like 'Restarting at%'")


# --- metrics --------------------------------------------------------------------------------------------------------

AB = [*PART, *P15, *P10, "ab AS MATERIALIZED (SELECT a.id, a.s AS a, b.s AS b FROM a10 a JOIN b10 b USING (id))"]


def _ab(spark, sf):
    return tb.part_rank(spark, sf).scores, tb.part_rank_low(spark, sf).scores


@query(
    q.with_(
        AB,
        """SELECT round(sum(abs(a - b)), 9) AS l1, round(sqrt(avg((a - b) * (a - b))), 9) AS rmse, round(max(abs(a - b)), 9) AS linf, round(abs(sum(a) - 1), 9) AS sum_deviation,
  round(avg((a >= 0)::INT::DOUBLE), 9) AS non_negative_rate, round(avg((a >= 0.15 / (SELECT n FROM cnt) - 1e-15)::INT::DOUBLE), 9) AS floor_rate, round(corr(a, b), 9) AS pearson, 0.0::DOUBLE AS pearson_p,
  (SELECT id FROM ab ORDER BY round(abs(a - b), 15) DESC, id LIMIT 1) AS worst_node FROM ab""",
    )
)
def correctness(spark, sf):
    return rounded(metrics.correctness(*_ab(spark, sf)))


@query(q.with_(AB, "SELECT round(avg(a - b), 9) + 0.0::DOUBLE AS bias, round(avg(a - b) - 1.96 * stddev_pop(a - b), 9) AS lower, round(avg(a - b) + 1.96 * stddev_pop(a - b), 9) AS upper FROM ab"))
def bland_altman(spark, sf):
    return rounded(metrics.bland_altman(*_ab(spark, sf)))


PLACES = [*AB, "pos AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(a, 12) DESC, id) AS pa, row_number() OVER (ORDER BY round(b, 12) DESC, id) AS pb FROM ab)"]


@query(
    q.with_(
        PLACES,
        f"""SELECT round((SELECT count(*) FROM pos WHERE pa <= 20 AND pb <= 20) / 20.0::DOUBLE, 9) AS overlap, round((SELECT avg(abs(pa - pb)) FROM pos WHERE pa <= 20), 9) AS displacement,
  round((SELECT 1 - 4.0::DOUBLE * count(*) / ((SELECT n FROM cnt) * ((SELECT n FROM cnt) - 1)) FROM pos x JOIN pos y ON x.pa < y.pa AND x.pb > y.pb), 9) AS tau, 0.0::DOUBLE AS tau_p, 0.0::DOUBLE AS rho_p,
  round((SELECT corr(ra, rb) FROM (SELECT {q.average_rank("round(a, 12)", "ra")}, {q.average_rank("round(b, 12)", "rb")} FROM ab)), 6) AS rho,
  round((SELECT sum(CASE WHEN pa <= 20 THEN b / log2(pa + 1.0::DOUBLE) END) / sum(CASE WHEN pb <= 20 THEN b / log2(pb + 1.0::DOUBLE) END) FROM pos), 9) AS ndcg""",
    )
)
def ranking_quality(spark, sf):
    return rounded(metrics.ranking(*_ab(spark, sf), 20)).withColumn("rho", F.round("rho", 6))


STRUCT = [*PART, *P15, "o AS MATERIALIZED (SELECT id, s, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS rank, row_number() OVER (ORDER BY s) AS up FROM a10)"]
STRUCT_SQL = """SELECT -sum(s * ln(s)) AS entropy, (SELECT sum(s) FROM o WHERE rank <= greatest(1, (SELECT count(*) FROM o) // 100)) AS top1_percent,
  (SELECT sum(s) FROM o WHERE rank <= greatest(1, (SELECT count(*) FROM o) // 10)) AS top10_percent, max(s) AS top_node, max(s) / avg(s) AS max_over_mean,
  2 * sum(up * s) / (count(*) * sum(s)) - (count(*) + 1) / count(*)::DOUBLE AS gini, -regr_slope(ln(rank), ln(s)) AS alpha, regr_r2(ln(rank), ln(s)) AS r2 FROM o"""


@query(q.with_(STRUCT, f"SELECT round(entropy, 6) AS entropy, round(top1_percent, 6) AS top1_percent, round(top10_percent, 6) AS top10_percent, round(top_node, 6) AS top_node, round(max_over_mean, 6) AS max_over_mean, round(gini, 6) AS gini, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM ({STRUCT_SQL})"))
def score_structure(spark, sf):
    return rounded(metrics.structure(tb.part_rank(spark, sf).scores), 6)


@query(q.with_(STRUCT, f"SELECT round(entropy, 6) AS entropy FROM ({STRUCT_SQL})"))
def entropy(spark, sf):
    return rounded(tb.part_rank(spark, sf).scores.agg(st.entropy(F.col("score")).alias("entropy")), 6)


@query(q.with_(STRUCT, f"SELECT round(gini, 6) AS gini FROM ({STRUCT_SQL})"))
def gini(spark, sf):
    return rounded(st.gini(tb.part_rank(spark, sf).scores, "score"), 6)


DEG = [*PART, *P15, "dg AS MATERIALIZED (SELECT a.id, round(s, 12) AS s, round(coalesce(w, 0), 12) AS d FROM a10 a LEFT JOIN (SELECT dst AS id, sum(w) AS w FROM t GROUP BY dst) USING (id))"]


@query(q.with_(DEG, f"SELECT count(*) AS n, round(corr(x, y), 6) AS spearman, 0.0::DOUBLE AS spearman_p, round((SELECT corr(s, d) FROM dg), 6) AS pearson, 0.0::DOUBLE AS pearson_p FROM (SELECT {q.average_rank('s', 'x')}, {q.average_rank('d', 'y')} FROM dg)"))
def indegree_correlation(spark, sf):
    return rounded(metrics.degree_correlation(tb.part_graph(spark, sf), tb.part_rank(spark, sf).scores), 6)


# Tails of Student's t and of the normal distribution by Simpson's rule over 0..limit in 2000 steps.
def _two_sided(limit: str, density: str) -> str:
    return f"1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density.replace('@', f'({limit} * i / 2000.0::DOUBLE)')}) * {limit} / 6000.0::DOUBLE FROM generate_series(0, 2000) g(i))"


STUDENT = _two_sided("lim", "exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE)) / sqrt((n - 2) * pi()) * power(1 + @ * @ / (n - 2), -(n - 1) / 2.0::DOUBLE)")
NORMAL = _two_sided("lim", "exp(-@ * @ / 2) / sqrt(2 * pi())")
DAYS = """ev AS MATERIALIZED (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b FROM lineitem WHERE l_orderkey % 64 = 1 OR l_linenumber = 7)"""
TIES = "SELECT sum(t * (t - 1) / 2)::DOUBLE AS t2, sum(t * (t - 1) * (t - 2))::DOUBLE AS t3, sum(t * (t - 1) * (2 * t + 5))::DOUBLE AS t5 FROM (SELECT count(*)::DOUBLE AS t FROM ev GROUP BY {0})"


@query(
    q.with_(
        [
            DAYS,
            f"ra AS MATERIALIZED (SELECT {q.average_rank('a', 'x')}, {q.average_rank('b', 'y')} FROM ev)",
            "lin AS (SELECT 'pearson' AS method, count(*) AS n, corr(a, b) AS value FROM ev UNION ALL SELECT 'spearman', count(*), corr(x, y) FROM ra)",
            "tt AS (SELECT *, abs(value) * sqrt((n - 2) / (1 - value * value)) AS lim FROM lin)",
            f"ca AS ({TIES.format('a')})", f"cb AS ({TIES.format('b')})",
            "sc AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b))::DOUBLE / 2 AS s FROM ev x, ev y)",
            "m AS (SELECT count(*)::DOUBLE AS n, count(*) * (count(*) - 1)::DOUBLE AS m FROM ev)",
            """kt AS (SELECT n, s / sqrt(m / 2 - ca.t2) / sqrt(m / 2 - cb.t2) AS value,
      abs(s) / sqrt((m * (2 * n + 5) - ca.t5 - cb.t5) / 18 + 2 * ca.t2 * cb.t2 / m + ca.t3 * cb.t3 / (9 * m * (n - 2))) AS lim FROM sc, m, ca, cb)""",
        ],
        f"SELECT method, n, round(value, 9) AS value, round({STUDENT}, 8) AS p FROM tt UNION ALL SELECT 'kendall', n::BIGINT, round(value, 9), round({NORMAL}, 8) FROM kt",
    )
)
def correlation_p_values(spark, sf):
    """Two columns full of ties: all three correlations and their p-values."""
    rows = tb.read(spark, sf, "lineitem").where("l_orderkey % 64 = 1 or l_linenumber = 7").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    return rounded(metrics.correlations(rows, "a", "b")).withColumn("p", F.round("p", 8))


@query(q.with_(DEG, "SELECT id, s AS score, d AS in_degree FROM dg"))
def figure_degree_score(spark, sf):
    graph = tb.part_graph(spark, sf)
    return rounded(tb.part_rank(spark, sf).scores.join(graph.in_degree(), "id", "left").fillna(0.0, ["in_degree"]), 12)


@query(q.with_([*PART, *P15, "o AS (SELECT id, s, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS r FROM a10 WHERE s > 0)"], "SELECT id, round(s, 10) AS score, round(r / (SELECT count(*) FROM o)::DOUBLE, 10) AS ccdf FROM o"))
def score_ccdf(spark, sf):
    return rounded(metrics.ccdf(tb.part_rank(spark, sf).scores), 10)


@query(q.with_(STRUCT, "SELECT rank, round(sum(s) OVER (ORDER BY rank), 9) AS mass FROM o"))
def lorenz_mass(spark, sf):
    return rounded(metrics.mass_curve(tb.part_rank(spark, sf).scores))


TRACE = [*PART, *P15, q.residuals("a", 10)]
CONV_SQL = """SELECT n_iterations, final_residual, auc_residual, below_1e3, below_1e6, below_1e8, empirical_rate, 0.85::DOUBLE AS theoretical_rate, empirical_rate / 0.85::DOUBLE AS rate_ratio FROM (
  SELECT count(*) AS n_iterations, arg_max(residual, iter) AS final_residual, coalesce(sum((residual + before) / 2), 0) AS auc_residual, min(CASE WHEN residual < 1e-3 THEN iter END) AS below_1e3,
    min(CASE WHEN residual < 1e-6 THEN iter END) AS below_1e6, min(CASE WHEN residual < 1e-8 THEN iter END) AS below_1e8 FROM (SELECT *, lag(residual) OVER (ORDER BY iter) AS before FROM tr)),
  (SELECT exp(regr_slope(ln(residual), iter)) AS empirical_rate FROM tr WHERE residual > 0)"""


@query(q.with_(TRACE, f"SELECT n_iterations, round(final_residual, 9) AS final_residual, round(auc_residual, 9) AS auc_residual, below_1e3, below_1e6, below_1e8, round(empirical_rate, 5) AS empirical_rate, theoretical_rate, round(rate_ratio, 5) AS rate_ratio FROM ({CONV_SQL})"))
def convergence(spark, sf):
    out = rounded(metrics.convergence(tb.part_rank(spark, sf).trace()))
    return out.withColumns({c: F.round(c, 5) for c in ("empirical_rate", "rate_ratio")})


@query(q.with_([*PART, *[t for i, p in enumerate((0.15, 0.5)) for t in q.iterate(f"s{i}_", 6, p)]], " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, round(-sum(s * ln(s)), 6) AS entropy, round(max(s), 9) AS max_score, round(stddev_pop(s), 9) AS std_score FROM s{i}_6" for i, p in enumerate((0.15, 0.5)))))
def figure_sweep(spark, sf):
    scores, _ = pr.sweep(tb.part_graph(spark, sf), [0.15, 0.5], tol=0, max_iter=6)
    out = scores.groupBy("p").agg(st.entropy(F.col("score")).alias("entropy"), F.max("score").alias("max_score"), F.stddev_pop("score").alias("std_score"))
    return rounded(out).withColumn("entropy", F.round("entropy", 6))


@query(
    q.with_(
        [*PART, *[t for i, p in enumerate((0.15, 0.5)) for t in [*q.iterate(f"s{i}_", 4, p), q.residuals(f"s{i}_", 4).replace("tr AS", f"tr{i} AS")]]],
        "SELECT tr0.iter, round(tr0.residual, 9) AS p15, round(tr1.residual, 9) AS p50 FROM tr0 JOIN tr1 USING (iter)",
    )
)
def sweep_pivot(spark, sf):
    _, trace = pr.sweep(tb.part_graph(spark, sf), [0.15, 0.5], tol=0, max_iter=4)
    rows = trace.select("iter", F.when(F.col("p") == 0.15, "p15").otherwise("p50").alias("p"), "residual")
    return rounded(sinks.sweep_pivot(rows, "p", "iter", "residual"))


@query(q.with_(PART, "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, 4::BIGINT AS iterations, round((12 * (SELECT count(*) FROM e) + 4 * ((SELECT count(*) FROM n) + 1) + 16 * (SELECT count(*) FROM n)) / 1e6::DOUBLE, 6) AS csr_mb, true AS timed"))
def scale_metrics(spark, sf):
    """Time of a run and what follows from it; of the figures that depend on the machine only that they agree."""
    graph = tb.part_graph(spark, sf)
    size = graph.summary().first()
    _, scale = metrics.Scale.measure(pr.pagerank, size["n_nodes"], size["n_edges"], graph, 0.15, 0, 4)
    d = scale.as_dict()
    close = lambda a, b: abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    timed = d["seconds"] > 0 and close(d["ms_per_iteration"], 250 * d["seconds"]) and close(d["edges_per_second"] * d["seconds"], 4 * d["edges"])
    timed = timed and close(d["scalability_index"] * (d["nodes"] + d["edges"]), d["seconds"])
    return spark.createDataFrame([(d["nodes"], d["edges"], d["iterations"], round(d["csr_mb"], 6), timed)], "nodes long, edges long, iterations long, csr_mb double, timed boolean")


RELEVANT = "relevant AS MATERIALIZED (SELECT id FROM n WHERE id LIKE 'nation:%' OR id LIKE 'region:%')"
KS = (1, 3, 5, 10)


@query(
    q.with_(
        [*PPR, FOUND, RELEVANT, "f AS (SELECT *, (entity_name IN (SELECT id FROM relevant))::INT AS r FROM found)"],
        " UNION ALL ".join(
            ["SELECT 'mrr' AS metric, round(coalesce(1.0::DOUBLE / min(CASE WHEN r = 1 THEN rank END), 0), 9) AS value FROM f"]
            + [f"SELECT 'hit@{k}', max(CASE WHEN rank <= {k} THEN r ELSE 0 END)::DOUBLE FROM f" for k in KS]
            + [f"SELECT 'precision@{k}', round(sum(CASE WHEN rank <= {k} THEN r ELSE 0 END) / {k}.0::DOUBLE, 9) FROM f" for k in KS]
            + [f"SELECT 'recall@{k}', round(sum(CASE WHEN rank <= {k} THEN r ELSE 0 END) / (SELECT count(*) FROM relevant)::DOUBLE, 9) FROM f" for k in KS]
        ),
        True,
    )
)
def retrieval_metrics(spark, sf):
    relevant = tb.trade(spark, sf).entities.where("type in ('nation', 'region')").select(F.col("name").alias("entity_name"))
    return rounded(metrics.retrieval(found(spark, sf), relevant, KS))


@query(q.with_([*PPR, FOUND], "SELECT hop_distance, count(*) AS n, round(avg(score), 9) AS mean_score, round(stddev_pop(score), 9) AS std_score FROM found WHERE hop_distance IS NOT NULL GROUP BY hop_distance", True))
def hop_score_decay(spark, sf):
    return rounded(metrics.hop_decay(found(spark, sf)))


@query(
    q.with_(
        [*PPR, FOUND],
        f"""SELECT round((SELECT corr(x, y) FROM (SELECT {q.average_rank("round(score, 12)", "x")}, {q.average_rank("-hop_distance", "y")} FROM found WHERE hop_distance IS NOT NULL)), 6) AS fidelity,
  round(avg(CASE WHEN entity_name IN ({SEED_LIST}) THEN score END) / avg(CASE WHEN entity_name NOT IN ({SEED_LIST}) THEN score END), 6) AS seed_ratio,
  round(avg(CASE WHEN rank <= 10 THEN hop_distance END), 6) AS mean_hop_top10 FROM found""",
        True,
    )
)
def personalisation(spark, sf):
    return rounded(metrics.personalisation(found(spark, sf), tb.SEEDS), 6)


@query(
    q.with_(
        STRUCT,
        "SELECT 'Structure' || chr(10) || repeat('=', 60) || chr(10) || '  entropy   :  ' || format('{:.6g}', -sum(s * ln(s))) || chr(10) || '  max_mean  :  ' || format('{:.6g}', max(s) / avg(s)) || chr(10) || '  missing   :  N/A' || chr(10) AS value FROM o",
    )
)
def metrics_table_text(spark, sf):
    row = tb.part_rank(spark, sf).scores.agg(st.entropy(F.col("score")).alias("entropy"), (F.max("score") / F.avg("score")).alias("max_mean"), F.lit(None).cast("double").alias("missing"))
    return sinks.table_text(row, "Structure")


# --- urls and crawling ----------------------------------------------------------------------------------------------

URLS = ["u AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT * FROM (VALUES " + ", ".join(f"({tb.quoted(u)})" for u in tb.KNOWN_URLS) + ") k(url))", *q.signals("u")]


@query(q.with_(URLS, "SELECT url, host, path, query, round(tld_score, 9) AS tld_score, round(reputation, 9) AS reputation, round(depth, 9) AS depth, round(cleanliness, 9) AS cleanliness, round(content_prior, 9) AS content_prior, round(composite, 9) AS composite FROM sig"))
def url_signals(spark, sf):
    known = spark.createDataFrame([(u,) for u in tb.KNOWN_URLS], "url string")
    return rounded(urls.with_signals(tb.read(spark, sf, "pages").select("url").where("url is not null").unionByName(known).distinct()))


@query(q.with_(URLS, "SELECT url, round(tld_score, 4) AS tld_score, round(reputation, 4) AS domain_reputation, round(depth, 4) AS url_depth_score, round(cleanliness, 4) AS path_cleanliness, round(content_prior, 4) AS content_type_prior, round(composite, 4) AS composite FROM sig"))
def url_signals_reported(spark, sf):
    known = spark.createDataFrame([(u,) for u in tb.KNOWN_URLS], "url string")
    return urls.rounded_signals(urls.with_signals(tb.read(spark, sf, "pages").select("url").where("url is not null").unionByName(known).distinct()))


@query(q.with_(URLS, "SELECT url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS domain, CASE WHEN len(string_split(host, '.')) > 2 THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS bare FROM sig"))
def url_domains(spark, sf):
    known = spark.createDataFrame([(u,) for u in tb.KNOWN_URLS], "url string")
    rows = tb.read(spark, sf, "pages").select("url").where("url is not null").unionByName(known).distinct()
    return rows.select("url", urls.domain_key(F.col("url")).alias("domain"), urls.bare_domain(urls.host(F.col("url"))).alias("bare"))


@query(q.with_(q.robots(), "SELECT domain, permitted FROM rob"))
def robots_verdict(spark, sf):
    return robots_.verdicts(spark.createDataFrame(tb.ROBOTS, "domain string, content string"))


@query(q.with_(q.web(), f"SELECT url, round(pr_norm, 9) AS pr_norm, round(out_norm, 9) AS out_norm FROM ({q.scaled({'pagerank': 'pr_norm', 'out_degree': 'out_norm'}, 'sig', 0.0)})"))
def minmax_zero(spark, sf):
    rows = tb.web(spark, sf).measured()
    return rounded(st.min_max(rows, {"pagerank": "pr_norm", "out_degree": "out_norm"}, 0.0).select("url", "pr_norm", "out_norm"))


@query(q.with_(q.web(), f"SELECT url, round(rep_norm, 9) AS rep_norm, round(flat_norm, 9) AS flat_norm FROM ({q.scaled({'reputation': 'rep_norm', 'flat': 'flat_norm'}, '(SELECT *, 1.0::DOUBLE AS flat FROM sig)', 0.5)})"))
def minmax_half(spark, sf):
    rows = tb.web(spark, sf).measured().withColumn("flat", F.lit(1.0))
    return rounded(st.min_max(rows, {"reputation": "rep_norm", "flat": "flat_norm"}, 0.5).select("url", "rep_norm", "flat_norm"))


def _heuristic(name: str) -> None:
    def run(spark, sf):
        return rounded(crawl.ranked(tb.web(spark, sf), crawl.heuristics()[name]).select("rank", "url", "score"))

    run.__name__ = name.lower()
    query(q.with_(q.rankings(), f"SELECT rank, url, round(score, 9) AS score FROM rk WHERE heuristic = '{name}'"))(run)


for _name in crawl.heuristics():
    _heuristic(_name)

PRIORITY = """SELECT round(priority, 9) AS priority, url, round(pagerank, 9) AS pagerank, out_degree, true AS robots_ok,
  concat_ws('; ', 'robots.txt permits AI crawlers', CASE WHEN pr_norm > 0.7 THEN 'very high PageRank authority' WHEN pr_norm > 0.4 THEN 'moderate PageRank authority' END, CASE WHEN od_norm > 0.6 THEN 'high out-degree hub' END) AS reason
FROM (SELECT *, 0.75::DOUBLE * pr_norm + 0.25::DOUBLE * od_norm AS priority FROM ({0})) ORDER BY round(priority, 12) DESC, url LIMIT 25"""


@query(q.with_(q.web(), PRIORITY.replace("{0}", q.scaled({"pagerank": "pr_norm", "out_degree": "od_norm"}, "sig", 0.0))))
def crawl_priority_topk(spark, sf):
    return rounded(crawl.Prioritizer(tb.web(spark, sf)).top_k(25))


@query(q.with_([*q.web(), *q.robots()], PRIORITY.replace("{0}", q.scaled({"pagerank": "pr_norm", "out_degree": "od_norm"}, f"(SELECT * FROM sig WHERE {q.PERMITTED})", 0.0))))
def crawl_priority_gated(spark, sf):
    return rounded(crawl.Prioritizer(tb.web(spark, sf), check_robots=True).top_k(25))


RK = q.rankings()
TOP = [*RK, "top AS MATERIALIZED (SELECT rk.*, quality FROM rk JOIN lab USING (url) WHERE rank <= 10)"]
ABLATE = {"full": {}, "w/o PageRank": {"pr": 0}, "w/o Domain Rep": {"rep": 0}, "w/o TLD Quality": {"tld": 0}, "w/o URL Depth": {"dep": 0}}


def _qwa(weights: dict) -> str:
    w = crawl.QWA | weights
    return f"{w['pr']}::DOUBLE * pr_norm + {w['rep']}::DOUBLE * rep_norm + {w['tld']}::DOUBLE * tld_norm + {w['dep']}::DOUBLE * dep_norm"


@query(q.with_([*RK, "v AS (" + " UNION ALL ".join(q.ranking(n, _qwa(w), True) for n, w in ABLATE.items()) + ")", "vt AS (SELECT v.heuristic AS variant, rank, quality FROM v JOIN lab USING (url) WHERE rank <= 10)"], f"SELECT variant, round(ndcg, 9) AS ndcg FROM ({q.ndcg('vt', 'variant')})"))
def exp1_ablation(spark, sf):
    return rounded(ex.ablation(tb.web(spark, sf)))


def _sensitivity_sql() -> str:
    ps = (0.05, 0.15, 0.5)
    tables = [tb.WEB, *q.graph("SELECT src, dst FROM links", "SELECT url AS id FROM web"), "base AS (SELECT url FROM web)", *q.signals("base"), *q.robots()]
    selects = []
    for i, p in enumerate(ps):
        tables += q.iterate(f"s{i}_", 8, p)
        tables.append(f"m{i} AS (SELECT sig.*, s AS pagerank FROM sig JOIN s{i}_8 ON id = url)")
        tables.append(f"nr{i} AS (SELECT * FROM ({q.scaled({k: v for k, v in q.NORMAL.items() if k != 'out_degree'}, f'm{i}', 0.5)}))")
        tables.append(f"o{i} AS MATERIALIZED ({q.ranking('x', _qwa({}), True, f'nr{i}')})")
    for i, p in enumerate(ps):
        pairs = f"(SELECT x.rank AS a, y.rank AS b FROM o{i} x JOIN o1 y USING (url))"
        selects.append(f"SELECT {p}::DOUBLE AS p, round(1 - 4.0::DOUBLE * (SELECT count(*) FROM {pairs} g JOIN {pairs} h ON g.a < h.a AND g.b > h.b) / ((SELECT count(*) FROM o1) * ((SELECT count(*) FROM o1) - 1.0::DOUBLE)), 9) AS tau, (SELECT url FROM o{i} WHERE rank = 1) AS top1")
    return q.with_(tables, " UNION ALL ".join(selects))


@query(_sensitivity_sql())
def exp2_p_sensitivity(spark, sf):
    web = tb.web(spark, sf)
    inside = crawl.Web(web.urls, tb.web_links(spark, sf)[1], web.pageranks, web.robots)
    return rounded(ex.sensitivity(inside, [0.05, 0.15, 0.5], tol=0, max_iter=8))


@query(
    q.with_(
        [*RK, "g AS (SELECT * FROM rk WHERE heuristic = 'H4_QWA')", "ar AS MATERIALIZED (SELECT " + ", ".join(q.average_rank(c, f"r_{c}") for c in ex.SIGNALS) + " FROM g)"],
        " UNION ALL ".join(f"SELECT '{la}' AS a, '{lb}' AS b, round(corr(r_{a}, r_{b}), 6) AS rho FROM ar" for a, la in ex.SIGNALS.items() for b, lb in ex.SIGNALS.items()),
    )
)
def exp3_signal_correlation(spark, sf):
    return rounded(ex.signal_correlation(tb.web(spark, sf)), 6)


@query(
    q.with_(
        [*RK, "g AS (SELECT * FROM rk WHERE heuristic = 'H4_QWA')", "ar AS MATERIALIZED (SELECT " + ", ".join(q.average_rank(c, f"r_{c}") for c in ex.SIGNALS) + " FROM g)"]
        + ["pr_ AS (" + " UNION ALL ".join(f"SELECT '{la}' AS a, '{lb}' AS b, corr(r_{a}, r_{b}) AS rho FROM ar" for i, (a, la) in enumerate(ex.SIGNALS.items()) for b, lb in list(ex.SIGNALS.items())[i + 1 :]) + ")"],
        "SELECT place::INT AS place, a, b, round(rho, 6) AS rho FROM (SELECT *, row_number() OVER (ORDER BY abs(round(rho, 12)), a, b) AS place FROM pr_) WHERE place <= 3",
    )
)
def exp3_least_correlated(spark, sf):
    return rounded(ex.complementary(ex.signal_correlation(tb.web(spark, sf))), 6)


DIVERSITY = """SELECT heuristic, 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)::DOUBLE AS domain_gini, count(*) AS unique_domains FROM (
  SELECT heuristic, v, row_number() OVER (PARTITION BY heuristic ORDER BY v, host) AS i FROM (
    SELECT heuristic, host, count(*) / (sum(count(*)) OVER (PARTITION BY heuristic))::DOUBLE + 1e-12 AS v FROM top GROUP BY heuristic, host)) GROUP BY heuristic"""


@query(q.with_(TOP, f"SELECT heuristic, round(domain_gini, 9) AS domain_gini, unique_domains FROM ({DIVERSITY})"))
def exp4_domain_diversity(spark, sf):
    return rounded(ex.domain_diversity(tb.web(spark, sf)))


@query(q.with_(RK, "SELECT heuristic, rank AS step, round(sum(quality) OVER (PARTITION BY heuristic ORDER BY rank) / greatest((SELECT sum(quality) FROM lab), 1), 9) AS found FROM rk JOIN lab USING (url)"))
def exp5_quality_curve(spark, sf):
    return rounded(ex.quality_curve(tb.web(spark, sf)))


@query(q.with_(RK, "SELECT heuristic, k::INT AS k, round(sum((tld_score >= 0.40)::INT) / k::DOUBLE, 9) AS compliance FROM rk JOIN (VALUES (5), (10), (20), (30)) ks(k) ON rank <= k GROUP BY heuristic, k"))
def exp6_compliance(spark, sf):
    return rounded(ex.compliance(tb.web(spark, sf)))


@query(q.with_(RK, "SELECT url, round(pagerank, 9) AS pagerank, round(tld_score, 9) AS tld_score, round(reputation, 9) AS reputation, round(depth, 9) AS depth, host, quality FROM sig JOIN lab USING (url)"))
def exp7_url_structure(spark, sf):
    return rounded(ex.url_structure(tb.web(spark, sf)))


@query(q.with_([tb.WEB], "SELECT DISTINCT k::INT AS k, 1.0::DOUBLE AS tau FROM (SELECT unnest([3, 5, 8, 10, 15, 20, 30, (SELECT count(*) FROM web)]) AS k)"))
def exp8_k_stability(spark, sf):
    return rounded(ex.k_stability(tb.web(spark, sf)))


BETWEEN = [
    *RK,
    "src50 AS MATERIALIZED (SELECT url FROM web ORDER BY md5('42' || url), url LIMIT 50)",
    "bfs(source, id, hop) AS (SELECT url, url, 0 FROM src50 UNION SELECT b.source, l.dst, b.hop + 1 FROM bfs b JOIN links l ON l.src = b.id WHERE b.hop < 40)",
    "dist AS MATERIALIZED (SELECT source, id, min(hop) AS hop FROM bfs GROUP BY source, id)",
    "cn AS MATERIALIZED (SELECT l.dst AS url, count(*)::DOUBLE AS c FROM links l JOIN dist a ON a.id = l.src JOIN dist b ON b.id = l.dst AND b.source = a.source WHERE b.hop = a.hop + 1 AND l.dst <> a.source GROUP BY l.dst)",
    "tp AS MATERIALIZED (SELECT web.url, round(coalesce(c / (SELECT sum(c) FROM cn), 0), 12) AS b, round(coalesce(score, 0), 12) AS s FROM web LEFT JOIN cn USING (url) LEFT JOIN (SELECT url, score FROM rk WHERE heuristic = 'H4_QWA') USING (url))",
]


@tb.once
def _topology(spark, sf):
    web = tb.web(spark, sf)
    inside = crawl.Web(web.urls, tb.web_links(spark, sf)[1], web.pageranks, web.robots)
    return ex.topology(inside, ex.sample_sources(inside))


@query(q.with_(BETWEEN, "SELECT url, round(b, 9) AS between, round(s, 9) AS score FROM tp", True))
def exp9_topology(spark, sf):
    return rounded(_topology(spark, sf)[0])


@query(q.with_(BETWEEN, f"SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT {q.average_rank('b', 'x')}, {q.average_rank('s', 'y')} FROM tp)", True))
def exp9_topology_rho(spark, sf):
    return rounded(_topology(spark, sf)[1], 6)


@query(
    q.with_(
        [*TOP, f"dv AS ({DIVERSITY})", f"nd AS ({q.ndcg('top', 'heuristic')})"],
        """SELECT heuristic, round(ndcg, 9) AS ndcg, round(precision, 9) AS precision, round(recall, 9) AS recall, round(mean_quality, 9) AS mean_quality, round(domain_gini, 9) AS domain_gini, unique_domains
FROM (SELECT heuristic, sum(quality) / 10.0::DOUBLE AS precision, sum(quality) / greatest((SELECT sum(quality) FROM lab), 1) AS recall, avg(composite) AS mean_quality FROM top GROUP BY heuristic) JOIN nd USING (heuristic) JOIN dv USING (heuristic)""",
    )
)
def exp10_head_to_head(spark, sf):
    return rounded(ex.head_to_head(tb.web(spark, sf)))


@query(q.with_(RK, "SELECT url, printf('PR=%.3f rep=%.2f tld=%.2f depth=%.2f', pr_norm, reputation, tld_score, depth) AS reason FROM nrm WHERE " + q.PERMITTED))
def reason_text(spark, sf):
    return crawl.ranked(tb.web(spark, sf), crawl.heuristics()["H4_QWA"]).select("url", "reason")


@query(
    q.with_(
        RK,
        "SELECT url, unnest(['pr_norm', 'rep_norm', 'tld_norm', 'dep_norm', 'pr_raw', 'rep_raw', 'tld_raw']) AS signal, round(unnest([pr_norm, rep_norm, tld_norm, dep_norm, pagerank, reputation, tld_score]), 9) AS value FROM nrm WHERE "
        + q.PERMITTED,
    )
)
def crawl_signals(spark, sf):
    rows = crawl.ranked(tb.web(spark, sf), crawl.heuristics()["H4_QWA"])
    return rows.select("url", F.explode(crawl.signals_map()).alias("signal", "value")).withColumn("value", F.round("value", 9))


# --- streaming ------------------------------------------------------------------------------------------------------


@query(f"SELECT src AS id, count(*) AS out_degree FROM ({tb.PART_EDGES}) GROUP BY src")
def stream_out_degree(spark, sf):
    """Edges as files of a stream, appended batch by batch to a table; degrees are those of the table."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    tb.part_edges(spark, sf).write.mode("overwrite").parquet(f"{base}/in")
    ingest.append_edges(ingest.stream_edges(spark, f"{base}/in"), f"{base}/table", f"{base}/state").awaitTermination()
    return Graph.of(spark.read.parquet(f"{base}/table").select("src", "dst")).out_degree()
