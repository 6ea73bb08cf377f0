from rankloom.__main__ import pages_web, rank
from rankloom.operators import crawl


def test_rank(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# x\n0 1\n1 2\n2 0\n2 1\n")
    paths = rank(spark, str(tmp_path / "edges.txt"), 0.15, str(tmp_path / "out"), [0.15, 0.5], tol=0.05)
    assert {p.rsplit("/", 1)[1] for p in paths} == {"correctness", "convergence", "ranking", "structure", "scale", "sweep", "ccdf", "trace"}
    assert spark.read.parquet(str(tmp_path / "out" / "sweep")).columns == ["metric", "p_0.15", "p_0.50"]
    assert len(rank(spark, str(tmp_path / "none"), 0.15, str(tmp_path / "out2"), [0.15], tol=0.05)) == 8  # the small graph


def test_pages(spark):
    rows = [("http://a.com/x", '<a href="/y">'), ("http://a.com/y", '<a href="/x"><a href="/z">'), ("http://b.org/", None)]
    web = pages_web(spark, spark.createDataFrame(rows, "url string, html string"), 0.15)
    top = crawl.Prioritizer(web).top_k(3).collect()
    assert len(top) == 3 and {r["out_degree"] for r in top} == {0, 1, 2}
