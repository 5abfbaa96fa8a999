import pytest
from pyspark.sql import functions as F

from skeinflow.operators import merge

NODE = "id string, kind string, name string, host_id string, content_hash string, status string, attributes string, capabilities array<string>, observed_by array<string>, confidence double, seq long"
EDGE = "id string, source_id string, target_id string, kind string, host_id string, status string, edge_precision string, flow_kind string, data_flow_confirmed string, identity_confidence double, attributes string, capabilities array<string>, observed_by array<string>, confidence double, seq long"


def test_signals(spark):
    rows = spark.createDataFrame([(0.3, [0.6, 0.2]), (0.5, [0.6]), (0.3, [0.6]), (0.3, [0.2, 0.2]), (0.3, [0.3, 0.2]), (0.9, [0.99]), (0.4, [])], "base double, s array<double>")
    got = [r[0] for r in rows.select(merge.combine_signals(F.col("base"), F.col("s"))).collect()]
    assert got == pytest.approx([0.776, 0.8, 0.72, 0.552, 0.608, 0.99, 0.4])


def test_nodes(spark):
    rows = [("n", "tool", "a", "h", None, "active", '{"x":"1","y":"2"}', ["b"], ["ast"], 0.5, 1), ("n", "tool", "c", "h", "q", "stale", '{"y":"3"}', ["a", "b"], None, None, 2), ("m", "tool", "z", "h", None, "active", "no json", None, [], 1.0, 1)]
    got = {r.id: r for r in merge.merge_nodes(spark.createDataFrame(rows, NODE)).collect()}
    assert (got["n"].name, got["n"].status, got["n"].confidence, got["n"].capabilities, got["n"].observed_by, got["n"].attributes) == ("c", "stale", 0.5, ["a", "b"], ["ast"], '{"x":"1","y":"3"}')
    assert got["m"].attributes == "{}" and got["m"].capabilities == []


def test_attributes_keep_their_types(spark):
    rows = [("n", "tool", "a", "h", None, "active", '{"n":1,"b":true,"z":null,"o":{"k":[1,2.5]},"s":"1"}', [], [], 0.5, 1), ("n", "tool", "c", "h", "q", "stale", '{"b":false,"q":"a\\"b"}', [], [], 0.1, 2)]
    (got,) = merge.merge_nodes(spark.createDataFrame(rows, NODE)).collect()
    assert got.attributes == '{"b":false,"n":1,"o":{"k":[1,2.5]},"q":"a\\"b","s":"1","z":null}'


def test_edges(spark):
    def edge(flow, precision, ic, dfc, seq, kind="writes_to"):
        return ("e" + kind, "a", "b", kind, "h", "active", precision, flow, dfc, ic, None, [], ["ast"], 1.0, seq)

    rows = [edge("data", "compiler-verified", 0.5, "x", 1), edge("control", "syntactic", None, None, 2), edge("control", "syntactic", 0.5, None, 3), edge("control", "syntactic", 0.5, None, 1, "uses_tool")]
    got = {r.kind: r for r in merge.merge_edges(spark.createDataFrame(rows, EDGE)).collect()}
    e = got["writes_to"]
    assert (e.flow_kind, e.edge_precision, e.data_flow_confirmed, e.identity_confidence) == ("data", "compiler-verified", "x", 0.75)
    assert got["uses_tool"].identity_confidence is None and got["uses_tool"].flow_kind == "control"


def test_groups_keep_their_evaluation(spark):
    rows = [("g", "n1", 1.0, None, 0.0, 1), ("g", "n2", 2.0, "exploitable", 0.9, 2), ("g", "n3", 3.0, None, 0.0, 3)]
    got = merge.upsert_groups(spark.createDataFrame(rows, "id string, name string, score double, verdict string, confidence double, seq int")).collect()[0]
    assert (got["name"], got.score, got.verdict, got.confidence) == ("n3", 3.0, "exploitable", 0.9)


def test_detected_nodes_replace(spark):
    node, edge = "id string, name string, file string, capabilities array<string>", "id string, source_id string, target_id string, kind string, host_id string"
    nodes = spark.createDataFrame([("a", "n", "f", ["c"]), ("b", "o", "f", [])], node)
    edges = spark.createDataFrame([("e1", "a", "b", "k", "h"), ("e2", "b", "b2", "k", "h")], edge)
    found = spark.createDataFrame([("d", "n", "f", [])], node)
    got_nodes, got_edges = merge.merge_detected(nodes, edges, found, spark.createDataFrame([("e2", "d", "z", "k", "h"), ("e3", "d", "b", "q", "h")], edge))
    assert {(r.id, tuple(r.capabilities)) for r in got_nodes.collect()} == {("b", ()), ("d", ("c",))}
    assert {(r.source_id, r.target_id, r.kind) for r in got_edges.collect()} == {("d", "b", "k"), ("b", "b2", "k"), ("d", "b", "q")}


def test_counts_and_first(spark):
    stored = spark.createDataFrame([("a",)], "id string")
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert tuple(merge.write_counts(stored, new).collect()[0]) == (1, 2)
    assert tuple(merge.write_counts(stored, new.limit(0)).collect()[0]) == (0, 0)
    rows = spark.createDataFrame([("a", 0.2, 1), ("a", 0.4, 2), ("a", 0.4, 3), ("b", None, 1)], "id string, identity_confidence double, seq int")
    assert {(r.id, r.seq) for r in merge.keep_stronger(rows).collect()} == {("a", 2), ("b", 1)}
