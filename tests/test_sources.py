"""Text formats, centralities on small networks, and the stream of edges."""

import math

import pytest
from pyspark.sql import functions as F

from crowdnet.operators import centrality, ranking
from crowdnet.sources import text
from crowdnet.streaming.strength import windowed_strength


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def put(path, content):
    path.write_text(content)
    return str(path)


@pytest.fixture
def names(spark, tmp_path):
    return text.nodes(spark, put(tmp_path / "names.txt", "G1 G2\nG3\n\nG4\nG5\n"))


def test_lower_triangle_golden(spark, tmp_path, names):
    path = put(tmp_path / "low.txt", "0\n1\t2\n3 4 5\n6 7 8 9\n")
    got = text.lower_triangle(spark, path)
    assert rows(got, "w") == [(1, 0, 0.0), (2, 0, 1.0), (2, 1, 2.0), (3, 0, 3.0), (3, 1, 4.0), (3, 2, 5.0), (4, 0, 6.0), (4, 1, 7.0), (4, 2, 8.0), (4, 3, 9.0)]
    net = ranking.import_edges(got)
    assert [(r["score"], r["rank"], r["direction"]) for r in net.orderBy("score").collect()] == [(float(k), k + 1.0, 1) for k in range(10)]
    assert text.view_lines(net.filter("score = 0"), names).collect()[0][0] == "G2\tG1\tDirected\t0.0;1.0"


def test_matrix_edges_and_gene_rows(spark, tmp_path, names):
    assert rows(names, "node") == [(0, "G1"), (1, "G2"), (2, "G3"), (3, "G4"), (4, "G5")]
    matrix = put(tmp_path / "m.txt", "\n".join(" ".join(str(5 * i + j) for j in range(5)) for i in range(5)))
    assert rows(text.full_matrix(spark, matrix), "a", "b") == [(i, j, 5.0 * i + j) for i in range(5) for j in range(5) if i != j]
    assert text.expression(spark, matrix).filter("sample = 2 AND gene = 3").first()["value"] == 13.0
    assert rows(text.edge_list(spark, put(tmp_path / "e.txt", "G1\tG2\t0\nG5\tG1\t2.5\n"), names), "a") == [(0, 1, 0.0), (4, 0, 2.5)]
    assert rows(text.gene_rows(spark, put(tmp_path / "a.txt", "> note\nG1 G2 1 G3 2\nG4 G1 3\n"), names), "a", "b") == [(0, 1, 1.0), (0, 2, 2.0), (3, 0, 3.0)]
    with pytest.raises(Exception, match="unknown node: G9"):
        text.edge_list(spark, put(tmp_path / "bad.txt", "G9 G1 1\n"), names).collect()


def test_paths_and_centralities(spark):
    net = spark.createDataFrame([(1, 0, 1.0), (2, 1, 0.5), (2, 0, 0.25), (4, 3, 0.0)], "i int, j int, score double")
    got = {(a, b): d for a, b, d in rows(centrality.distances(net), "source", "node")}
    assert got[0, 2] == got[2, 0] == 3.0 and got[0, 0] == 0.0 and math.isclose(got[3, 4], 1e8) and (0, 3) not in got
    assert centrality.distances(net, spark.createDataFrame([(0,)], "node int")).count() == 3
    assert centrality.distances(net.limit(0)).count() == 0
    path = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "i int, j int, score double")
    assert rows(centrality.laplacian(path), "node") == [(0, 6.0), (1, 10.0), (2, 6.0)]
    triangle = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (2, 0, 1.0)], "i int, j int, score double")
    assert all(math.isclose(x, 3**-0.5) for _, x in rows(centrality.eigenvector(triangle, 3), "node"))
    assert all(math.isclose(x, 1.25, rel_tol=1e-6) for _, x in rows(centrality.katz(triangle, 20, 0.1), "node"))


def test_stream_equals_table(spark, tmp_path):
    edges = spark.createDataFrame([(1, 0, 1.0, "2024-01-01 00:00:10"), (2, 0, 2.0, "2024-01-01 00:00:50"), (1, 0, 4.0, "2024-01-01 00:01:10")], "i int, j int, score double, ts string").withColumn("ts", F.to_timestamp("ts"))
    edges.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in"))
    q = windowed_strength(stream, "ts", "1 minute", "5 minutes").writeStream.format("memory").queryName("strengths").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("strengths"), "start", "node") == rows(windowed_strength(edges, "ts", "1 minute", "5 minutes"), "start", "node")
    assert [r["strength"] for r in spark.table("strengths").orderBy("start", "node").collect()] == [3.0, 1.0, 2.0, 4.0, 4.0]
