"""Statistics against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import statistics as st
from rankloom.operators import metrics
from rankloom.sources import sinks


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "id long, score double")


def plain_gini(v):
    v = sorted(map(abs, v))
    n = len(v)
    return 2 * sum((i + 1) * x for i, x in enumerate(v)) / (n * sum(v)) - (n + 1) / n


def test_kendall_and_spearman(spark):
    rng = random.Random(3)
    a, b = list(range(60)), list(range(60))
    rng.shuffle(b)
    rows = spark.createDataFrame(list(zip(a, b, strict=True)), "a long, b long")
    inversions = sum(b[i] > b[j] for i in range(60) for j in range(i + 1, 60))
    assert st.kendall(rows, "a", "b").first()["tau"] == pytest.approx(1 - 4 * inversions / (60 * 59))
    ties = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert st.spearman(ties, "a", "b").first()["rho"] == pytest.approx(8 / 9)
    assert st.kendall(rows.limit(1), "a", "b").first()["tau"] is None


def test_p_values(spark):
    assert st.pearson_p(spark, 0.5, 20) == pytest.approx(0.02476, abs=1e-4)
    assert st.pearson_p(spark, 1.0, 5) == 0.0


def plain_kendall(rows):
    """Pairs one by one: tau-b and the score."""
    n = len(rows)
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(rows[i][0] - rows[j][0]), sign(rows[i][1] - rows[j][1])) for i in range(n) for j in range(i)]
    score = sum(x * y for x, y in pairs)
    return score / math.sqrt(sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs))


@pytest.mark.parametrize(("n", "kinds"), [(2, 9), (3, 2), (40, 5), (150, 12), (300, 10**6)])
def test_tau_b_with_ties(spark, n, kinds):
    rng = random.Random(n)
    rows = [(rng.randrange(kinds), rng.randrange(kinds)) for _ in range(n - 1)] + [(kinds, kinds)]
    frame = spark.createDataFrame([*rows, (None, 1), (1, None)], "a long, b long")
    got = st.kendall(frame, "a", "b").first()
    assert got["n"] == n and got["tau"] == pytest.approx(plain_kendall(rows), abs=1e-12) and 0 <= got["p"] <= 1
    flat = st.kendall(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), "a", "b").first()
    assert flat["tau"] is None and flat["p"] is None


def test_exact_kendall_p():
    from itertools import permutations

    for n in (4, 6):
        counts = [sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) for p in permutations(range(n))]
        pairs = n * (n - 1) // 2
        for k in range(pairs + 1):
            few = min(k, pairs - k)
            want = min(1.0, 2 * sum(c <= few for c in counts) / len(counts)) if 2 * few != pairs else 1.0
            assert st.kendall_p(n, pairs - 2 * k, k, (0, 0, 0), (0, 0, 0)) == pytest.approx(want)


def test_ranks_of_many_rows(spark):
    """Range bounds are sampled: numbers must still be gapless, with payload columns and uneven partitions."""
    rows = spark.range(100_000).select((F.col("id") * 7919 % 100_003 % 997).alias("k"), F.col("id").alias("id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("pay")).repartition(7, "k")
    from rankloom.operators.graph import dense_index

    got = dense_index(rows, ["k", "id"]).toPandas().sort_values("idx")
    assert got["idx"].tolist() == list(range(100_000))
    assert got[["k", "id"]].apply(tuple, axis=1).is_monotonic_increasing
    ranks = st.rank_table(rows, "k", "r").toPandas().sort_values("k")
    counts = got.groupby("k").size()
    before = counts.cumsum() - counts
    assert ranks["r"].tolist() == pytest.approx((before + (counts + 1) / 2).tolist())


def test_structure(spark):
    values = [0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01]
    got = metrics.structure(frame(spark, values)).first()
    assert got["entropy"] == pytest.approx(-sum(v * math.log(v) for v in values))
    assert got["gini"] == pytest.approx(plain_gini(values))
    assert got["top10_percent"] == pytest.approx(0.4) and got["max_over_mean"] == pytest.approx(4)
    assert metrics.structure(frame(spark, values[:5])).first()["alpha"] is None


def test_correctness(spark):
    a, b = frame(spark, [0.5, 0.3, 0.2]), frame(spark, [0.4, 0.4, 0.2])
    got = metrics.correctness(a, b).first()
    assert (got["l1"], got["linf"], got["worst_node"]) == pytest.approx((0.2, 0.1, 0))
    assert got["non_negative_rate"] == 1.0 and got["sum_deviation"] == pytest.approx(0)


def test_convergence(spark):
    trace = spark.createDataFrame([(i + 1, 0.5**i) for i in range(12)], "iter int, residual double")
    got = metrics.convergence(trace, 0.15).first()
    assert got["empirical_rate"] == pytest.approx(0.5) and got["below_1e3"] == 11 and got["below_1e8"] is None
    assert got["auc_residual"] == pytest.approx(sum((0.5**i + 0.5 ** (i + 1)) / 2 for i in range(11)))
    assert metrics.convergence(trace.where("iter < 4"), 0.15).first()["empirical_rate"] == pytest.approx(0.85)


def test_retrieval(spark):
    found = spark.createDataFrame([(1, "a", 0.5, 0), (2, "b", 0.3, 1), (3, "c", 0.1, 1), (4, "d", 0.05, None)], "rank int, entity_name string, score double, hop_distance int")
    relevant = spark.createDataFrame([("b",), ("d",), ("z",)], "entity_name string")
    got = {r["metric"]: r["value"] for r in metrics.retrieval(found, relevant).collect()}
    assert got["mrr"] == 0.5 and got["hit@1"] == 0 and got["precision@10"] == pytest.approx(0.2) and got["recall@3"] == pytest.approx(1 / 3)
    none = {r["metric"]: r["value"] for r in metrics.retrieval(found, relevant.limit(0)).collect()}
    assert none["mrr"] == 0.0 and none["recall@10"] == 0.0
    about = metrics.personalisation(found, ["a"]).first()
    assert about["seed_ratio"] == pytest.approx(0.5 / 0.15) and about["mean_hop_top10"] == pytest.approx(2 / 3)


def test_ranking_of_itself(spark):
    a = frame(spark, [0.4, 0.3, 0.2, 0.1])
    got = metrics.ranking(a, a, 2).first()
    assert (got["overlap"], got["tau"], got["rho"], got["ndcg"], got["displacement"]) == pytest.approx((1, 1, 1, 1, 0))


def test_curves(spark):
    a = frame(spark, [0.1, 0.2, 0.7])
    assert [r["mass"] for r in metrics.mass_curve(a).orderBy("rank").collect()] == pytest.approx([0.7, 0.9, 1.0])
    assert {r["id"]: r["ccdf"] for r in metrics.ccdf(a).collect()} == pytest.approx({2: 1 / 3, 1: 2 / 3, 0: 1})


def test_scale():
    class Done:
        iterations = 4

    _, s = metrics.Scale.measure(lambda: Done(), 10, 30)
    assert s.as_dict()["edges_per_second"] > 0 and s.as_dict()["csr_mb"] == pytest.approx((12 * 30 + 4 * 11 + 160) / 1e6)


@pytest.mark.parametrize("value", [0.0, 1.0, 0.1268932, 6.91667e-07, 306519000.0, 123456.7, 1234567.8, -0.00012345678, 9.9999999, 100.0])
def test_six_digits(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(sinks.six_digits(F.col("v"))).first()[0]
    assert got == f"{value:.6g}"


def test_publisher(spark, tmp_path):
    row = spark.createDataFrame([(1, 0.5, None)], "n int, rate double, none double")
    paths = sinks.Publisher(spark, str(tmp_path)).add_table("t", "Title", row).publish()
    assert len(paths) == 1
    text = spark.read.text(paths[0], wholetext=True).first()[0]
    assert text.startswith("Title\n" + "=" * 60 + "\n  n     :  1\n  rate  :  0.5\n  none  :  N/A\n")
    assert "rate" in sinks.console(row, ["n", "rate"])
