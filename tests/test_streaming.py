from rankloom.operators.graph import Graph
from rankloom.operators.pagerank import pagerank
from rankloom.streaming import ingest


def test_edges_arrive_in_batches(spark, tmp_path):
    edges = [(0, 1), (1, 2), (2, 0)]
    write = lambda rows: spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.append_edges(ingest.stream_edges(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    table = lambda: spark.read.parquet(str(tmp_path / "table")).select("src", "dst")
    write(edges)
    run()
    first = pagerank(Graph.of(table()))
    write([(2, 1)])
    run()
    run()  # nothing new, nothing twice
    assert table().count() == 4
    again = ingest.refreshed(table(), first.scores)
    want = {r["id"]: r["score"] for r in pagerank(Graph.of(table())).scores.collect()}
    assert all(abs(r["score"] - want[r["id"]]) < 1e-6 for r in again.scores.collect())


def test_running_degrees(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    q = ingest.running_out_degree(ingest.stream_edges(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("degrees").collect() == [(0, 2)]
