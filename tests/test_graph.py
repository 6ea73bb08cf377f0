"""Invariants and known values of link analysis."""

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs

from rankloom.operators import pagerank as pr
from rankloom.operators import traverse as tv
from rankloom.operators.graph import Graph, dense_index
from rankloom.sources.edges import adjacency_edges, literal_edges, parse_edges, read_edge_list

TRIANGLE = [(0, 1), (1, 2), (2, 0)]
DANGLING = [(0, 1), (0, 2)]
SMALL = [(0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (5, 0)]


def graph(spark, pairs):
    return Graph.of(literal_edges(spark, pairs))


def scores(frame):
    return {r["id"]: r["score"] for r in frame.collect()}


def plain(pairs, p, tol=1e-8, most=200):
    ids = sorted({x for e in pairs for x in e})
    at = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    a = np.zeros((n, n))
    for s, d in pairs:
        a[at[d], at[s]] += 1
    out = a.sum(axis=0)
    a = a / np.where(out == 0, 1, out)
    r = np.full(n, 1 / n)
    for k in range(most):
        new = (1 - p) * (a @ r + r[out == 0].sum() / n) + p / n
        change = np.abs(new - r).sum()
        r = new
        if change < tol:
            break
    return dict(zip(ids, r, strict=True)), k + 1


@pytest.mark.parametrize("p", [0.15, 0.5])
def test_triangle_is_uniform(spark, p):
    got = pr.pagerank(graph(spark, TRIANGLE), p)
    assert got.converged and scores(got.scores) == pytest.approx({0: 1 / 3, 1: 1 / 3, 2: 1 / 3}, abs=1e-8)


def test_dangling(spark):
    got = pr.pagerank(graph(spark, DANGLING))
    assert got.iterations == 15
    assert scores(got.scores) == pytest.approx({0: 0.25974, 1: 0.37013, 2: 0.37013}, abs=1e-5)
    assert sum(scores(got.scores).values()) == pytest.approx(1)


def test_small_and_no_convergence(spark):
    got = pr.pagerank(graph(spark, SMALL), 0.15)
    want, k = plain(SMALL, 0.15)
    assert got.iterations == k == 107 and scores(got.scores) == pytest.approx(want, abs=1e-9)
    with pytest.warns(UserWarning, match="no convergence"):
        assert not pr.pagerank(graph(spark, SMALL), 0.01, max_iter=5).converged


def test_repeated_edges_and_loops(spark):
    pairs = [(0, 1), (0, 1), (0, 2), (1, 1), (2, 0)]
    assert scores(pr.pagerank(graph(spark, pairs)).scores) == pytest.approx(plain(pairs, 0.15)[0], abs=1e-8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(hs.integers(0, 7), hs.integers(0, 7)), min_size=1, max_size=20))
def test_random_graphs_against_the_closed_form(spark, pairs):
    g = graph(spark, pairs)
    want = plain(pairs, 0.3, 1e-13)[0]
    assert scores(pr.direct(g, 0.3)) == pytest.approx(want, abs=1e-9)
    assert scores(pr.pagerank(g, 0.3, 1e-10).scores) == pytest.approx(want, abs=1e-8)


def test_sweep_equals_single_runs(spark):
    both, trace = pr.sweep(graph(spark, DANGLING), [0.15, 0.55])
    for p in (0.15, 0.55):
        want, k = plain(DANGLING, p)
        assert {r["id"]: r["score"] for r in both.where(both.p == p).collect()} == pytest.approx(want, abs=1e-9)
        assert trace.where(trace.p == p).count() == k


def test_parameters(spark):
    for p in (0, 1.5, -1):
        with pytest.raises(ValueError):
            pr.pagerank(graph(spark, TRIANGLE), p)
    assert pr.direct(graph(spark, TRIANGLE), most=2) is None
    assert pr.compare_direct(graph(spark, TRIANGLE), pr.pagerank(graph(spark, TRIANGLE)).scores).first()["l1"] < 1e-7


def test_empty_graph(spark):
    g = Graph.of(spark.createDataFrame([], "src long, dst long"))
    assert pr.pagerank(g).scores.count() == 0
    assert g.summary().first().asDict() == {"n_nodes": 0, "n_edges": 0, "n_dangling": 0, "density": 0.0}


def test_start_from_scores(spark):
    g = graph(spark, SMALL)
    done = pr.pagerank(g)
    assert pr.pagerank(g, start=done.scores).iterations < 3


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n\n 1\t2\n3 4 extra\nx 5\n6\n\t7   8\n1 2")
    assert sorted(map(tuple, read_edge_list(spark, str(tmp_path / "e.txt")).collect())) == [(1, 2), (1, 2), (3, 4), (7, 8)]
    with pytest.raises(FileNotFoundError):
        read_edge_list(spark, str(tmp_path / "none"))
    assert parse_edges(spark.createDataFrame([("1.5 2",), ("12a 3",), ("-1 +2",)], "value string")).collect() == [(-1, 2)]


def test_adjacency_and_index(spark):
    rows = spark.createDataFrame([("a", ["b", "c"]), ("b", [])], "url string, outlinks array<string>")
    assert sorted(map(tuple, adjacency_edges(rows).collect())) == [("a", "b"), ("a", "c")]
    ids = dense_index(spark.range(100).selectExpr("id * 3 as id"), ["id"])
    assert all(r["idx"] * 3 == r["id"] for r in ids.collect()) and ids.count() == 100


def test_hops_and_paths(spark):
    e = literal_edges(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"), ("E", "A")])
    seeds = spark.createDataFrame([("A",)], "id string")
    assert {r["id"]: r["hop"] for r in tv.hops(e, seeds).collect()} == {"A": 0, "B": 1, "C": 1, "D": 2}
    pairs = spark.createDataFrame([("A", "D"), ("A", "A"), ("A", "E")], "start string, goal string")
    assert sorted(r["path"] for r in tv.simple_paths(e, pairs, 3).collect()) == [["A"], ["A", "B", "D"], ["A", "C", "D"]]
    chain = literal_edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    ends = spark.createDataFrame([("n0", "n4"), ("n0", "n5")], "start string, goal string")
    assert [r["goal"] for r in tv.simple_paths(chain, ends, 3).collect()] == ["n4"]  # max_hops + 1 edges


def test_predecessor_counts(spark):
    e = literal_edges(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])
    got = {r["id"]: r["between"] for r in tv.predecessor_counts(e, spark.createDataFrame([("A",)], "id string")).collect()}
    assert got == pytest.approx({"B": 0.25, "C": 0.25, "D": 0.5})


def test_sparse_solution(spark):
    """The sparse fixed point against elimination, dangling nodes and a restart vector included."""
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))]
    g = graph(spark, pairs)
    for p, teleport in ((0.15, None), (0.02, None), (1.0, None), (0.3, spark.createDataFrame([(pairs[0][0], 2.0), (pairs[1][1], 1.0)], "id long, v double"))):
        exact, sparse = scores(pr.direct(g, p, teleport)), scores(pr.direct(g, p, teleport, dense=0))
        assert sparse == pytest.approx(exact, abs=1e-13)
    assert pr.direct(g, most=10) is None


def test_hubs(spark, monkeypatch):
    """Sources of very many targets, apart from the rest, change nothing."""
    pairs = [(0, i) for i in range(1, 40)] + [(1, i) for i in range(20, 60)] + [(i, (i * 7) % 60) for i in range(2, 50)]
    g = graph(spark, pairs)
    want, swept = scores(pr.pagerank(g, tol=0, max_iter=6).scores), {(r["p"], r["id"]): r["score"] for r in pr.sweep(g, [0.15, 0.5], tol=0, max_iter=3)[0].collect()}
    monkeypatch.setattr(pr, "HUB_EDGES", 10)
    assert scores(pr.pagerank(g, tol=0, max_iter=6).scores) == pytest.approx(want, abs=1e-15)
    assert {(r["p"], r["id"]): r["score"] for r in pr.sweep(g, [0.15, 0.5], tol=0, max_iter=3)[0].collect()} == pytest.approx(swept, abs=1e-15)


def test_linear_system_of_any_size(spark):
    """Beyond the dense size the system is solved over all tasks, and gives what one task gives."""
    edges = [(f"n{i}", f"n{(i * 7 + j) % 50}") for i in range(40) for j in (1, 3)] + [("n1", "end")]
    g = graph(spark, edges)
    assert scores(pr.linear(g, 0.9, dense=5)) == pytest.approx(scores(pr.direct(g, 0.9)), abs=1e-12)
    seeds = spark.createDataFrame([("n1", 1.0), ("n2", 3.0)], "id string, v double")
    assert scores(pr.linear(g, 0.9, seeds, dense=5)) == pytest.approx(scores(pr.direct(g, 0.9, seeds)), abs=1e-12)


def test_iterations_leave_one_table(spark):
    """Finished iterations are removed from the checkpoint folder at once, not when the garbage collector comes by."""
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b")])
    files = []
    kept_, drop = [], pr.drop_cut

    def dropped(df):
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
        drop(df)
        files.append(os.path.exists(file))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pr, "drop_cut", dropped)
        kept_.append(pr.pagerank(g, tol=0, max_iter=3).scores)
    assert files == [False] * 3 and sum(scores(kept_[0]).values()) == pytest.approx(1)


def test_predecessor_counts_of_many_sources(spark):
    """More sources than a word has bits, repeated edges, loops: as counted by a plain search."""
    pairs = [(i, (i * 7 + 3) % 90) for i in range(90)] + [(i, (i * 13 + 5) % 90) for i in range(0, 90, 3)] + [(0, 3), (5, 5)]
    want, out = {}, {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    for s in range(70):
        dist, front = {s: 0}, [s]
        while front:
            front = list(dict.fromkeys(b for a in front for b in out.get(a, []) if b not in dist))
            dist |= dict.fromkeys(front, max(dist.values()) + 1)
        for a, b in pairs:
            if a in dist and dist[b] == dist[a] + 1:
                want[b] = want.get(b, 0) + 1
    got = tv.predecessor_counts(spark.createDataFrame(pairs, "src long, dst long"), spark.range(70))
    assert {r["id"]: r["between"] for r in got.collect()} == pytest.approx({k: v / sum(want.values()) for k, v in want.items()})


def test_tables_of_a_long_search_stay_few(spark):
    parts = []
    for i in range(12):
        parts = tv.merged([*parts, (tv.cut(spark.range(i, i + 1)), 1)])
    assert len(parts) <= 4 and sorted(r[0] for p, _ in parts for r in p.collect()) == list(range(12))


def test_rounds_of_a_long_search(spark, monkeypatch):
    """The estimates of the tables a search writes stay small, and it goes on to the end of a chain of any length."""
    chain = lambda n: spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "src string, dst string")
    start, bits, cut = spark.createDataFrame([("n0",)], "id string"), [], tv.cut
    with monkeypatch.context() as m:
        m.setattr(tv, "cut", lambda df: (bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()), cut(df))[1])
        tv.predecessor_counts(chain(8), start)
    assert len(bits) == 11 and max(bits[6:]) == max(bits[4:6]) and max(bits) < 1000
    assert scores(tv.predecessor_counts(chain(45), start).withColumnRenamed("between", "score")) == pytest.approx({f"n{i}": 1 / 45 for i in range(1, 46)})


def test_plan_of_a_round(spark, monkeypatch):
    """A round has one shuffle, and its plan lists nothing of what the edges came from."""
    plans, cut = [], tv.cut
    monkeypatch.setattr(tv, "rounds_parts", lambda *a: 3)
    monkeypatch.setattr(tv, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long").distinct().repartition(2, "dst").persist()
    assert tv.predecessor_counts(edges, spark.range(1)).count() == 3
    assert [p.count("Exchange") for p in plans[-4:]] == [1] * 4
