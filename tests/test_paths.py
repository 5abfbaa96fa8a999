import hashlib
import json
import random
from datetime import datetime

import pytest

from skeinflow.operators import graph as graph_module
from skeinflow.operators.graph import Graph, edges_met, neighbours, sinks, subgraph
from skeinflow.operators.paths import chain_groups, find_chains, read_chains, write_chains
from skeinflow.operators.scoring import prioritise, score_groups
from skeinflow.operators.validation import validate_chains, validate_edges
from skeinflow.plans import graph_queries
from skeinflow.session import cut_lineage

NODE = "id string, kind string, name string, capabilities array<string>, confidence double, status string, attributes string"
EDGE = "id string, source_id string, target_id string, kind string, flow_kind string, identity_confidence double, observed_by array<string>, status string, attributes string"


def make(spark, nodes, edges):
    n = [(i, k, i, c, 1.0, s, a) for i, k, c, s, a in ((*x, [], "active", None)[: len(x)] + ([], "active", None)[len(x) - 2 :] for x in nodes)]
    e = [(i, s, t, k, f, ic, ["ast"] + (["runtime"] if f == "data" else []), st, a) for i, s, t, k, f, ic, st, a in ((*x, None, "active", None)[: len(x)] + (None, "active", None)[len(x) - 5 :] for x in edges)]
    return Graph(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE))


def small(spark):
    return make(
        spark,
        [("e", "entry_point"), ("a", "agent"), ("t", "tool", ["writes_db"]), ("k", "sink"), ("s", "store"), ("u", "untrusted_source", [], "active", '{"source_type":"rag_corpus"}'), ("r", "tool", ["reads_untrusted"])],
        [
            ("e1", "e", "a", "delegates_to", "control"), ("e2", "a", "t", "uses_tool", "control"), ("e3", "a", "k", "has_access_to", "data"), ("e4", "k", "a", "x", "control"),
            ("e5", "a", "s", "writes_to", "structural", 0.9), ("e6", "s", "u", "reads_from", "structural", 0.8), ("e7", "u", "r", "has_access_to", "data"), ("e8", "r", "k", "has_access_to", "control"),
        ],
    )


def test_chain_ids_and_paths(spark):
    got = {tuple(r.nodes): r.chain_id for r in find_chains(small(spark)).collect()}
    want = "chain:" + hashlib.sha256(json.dumps({"edges": ["e1", "e2"], "nodes": ["e", "a", "t"]}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    assert set(got) == {("e", "a", "t"), ("e", "a", "k")} and got[("e", "a", "t")] == want
    assert [r.nodes for r in find_chains(small(spark), data_edges_only=True).collect()] == [["e", "a", "k"]]
    assert find_chains(small(spark), max_candidates=1).collect()[0].edges == ["e1", "e2"]
    with pytest.raises(ValueError):
        find_chains(small(spark), max_hops=0)


def walker(nodes, edges, hops):
    """A depth-first walk, edges by id, for comparison."""
    out = []
    by_source = {}
    for e in sorted(edges):
        by_source.setdefault(e[1], []).append(e)
    stop = {n[0] for n in nodes if n[1] == "sink"}

    def go(at, path, used):
        if at in stop and used:
            out.append((tuple(path), tuple(used)))
            return
        if len(used) < hops:
            for e in by_source.get(at, []):
                if e[2] not in path:
                    go(e[2], [*path, e[2]], [*used, e[0]])

    for n in sorted(nodes):
        if n[1] == "entry_point":
            go(n[0], [n[0]], [])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walker_on_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{i:02}", "entry_point" if i < 2 else "sink" if i > 9 else "agent") for i in range(12)]
    edges = sorted({(f"x{a:02}{b:02}", f"n{a:02}", f"n{b:02}", "k", "control") for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(34)) if a != b})
    want = walker(nodes, edges, 5)
    graph = make(spark, nodes, edges)
    got = find_chains(graph, max_hops=5, max_candidates=None).collect()
    assert sorted((tuple(r.nodes), tuple(r.edges)) for r in got) == sorted(want)
    capped = find_chains(graph, max_hops=5, max_candidates=7).collect()
    assert {tuple(r.edges) for r in capped} == {e for _, e in want[:7]}


def test_groups_scores_and_weak_pairs(spark):
    graph = small(spark)
    w = write_chains(graph, spark.createDataFrame([("s",)], "id string")).collect()
    assert [(r.nodes, r.link) for r in w] == [(["e", "a", "s"], 0.9)]
    assert [r.nodes for r in read_chains(graph, spark.createDataFrame([("u",)], "id string")).collect()] == [["u", "r", "k"]]
    groups = chain_groups(graph)
    assert [(r.store_id, r.store_confidence, r.weak) for r in groups.collect()] == [("s", 0.8, False)]
    assert chain_groups(graph, threshold=0.85).count() == 0 and chain_groups(graph, threshold=0.85, include_weak=True).count() == 1
    scored = score_groups(groups, graph.nodes).collect()[0]
    assert (scored.score, scored.user_writable_source, scored.short_chain) == (3.0, 2, 1)
    assert prioritise(groups, graph.nodes).collect()[0].priority == "low"
    # What is not scored, not good enough or not among the best stays, without a priority.
    for limits in ({"max_scored": 0}, {"min_score": 4}, {"max_evaluated": 0}):
        assert [(r.score, r.priority) for r in prioritise(groups, graph.nodes, **limits).collect()] == [(None if "max_scored" in limits else 3.0, None)]


def test_neighbours_and_subgraph(spark):
    graph = small(spark)
    near = neighbours(graph, spark.createDataFrame([("k",)], "id string"), 1)
    assert {(r.id, r.distance) for r in near.collect()} == {("k", 0), ("a", 1), ("r", 1)}
    assert {r.edge_id for r in edges_met(graph, near, 1).collect()} == {"e3", "e4", "e8"}
    sub = subgraph(graph, ["agent", "tool"])
    assert {r.id for r in sub.edges.collect()} == {"e2"}
    assert {r.id for r in sinks(graph.nodes).collect()} == {"k", "t"}
    with pytest.raises(ValueError):
        neighbours(graph, graph.nodes, 0)


@pytest.mark.parametrize("crowd", [2, 1024])
def test_edges_met_at_hubs_against_sets(spark, monkeypatch, crowd):
    monkeypatch.setattr(graph_module, "CROWD", crowd)
    rng = random.Random(7)
    pairs = [("h", f"n{k}") for k in range(12)] + [(rng.choice("hgabcdef"), rng.choice("hgabcdef")) for _ in range(30)] + [("a", None), (None, "h"), (None, None), ("h", "h"), ("h", "g"), ("g", "h")]
    edges = [(f"e{k:02}", a, b, "k", "control", None, "stale" if k % 11 == 5 else "active") for k, (a, b) in enumerate(pairs)]
    graph = make(spark, [(n, "agent") for n in "hgabcdef"], edges)
    active = [e[:3] for e in edges if e[6] == "active"]
    for depth in (1, 2, 3):
        want = set()
        for start in ("a", "h", "n1", "zz"):
            reached = {start}
            for _ in range(depth - 1):
                reached |= {y for _, a, b in active for x, y in ((a, b), (b, a)) if x in reached and x and y}
            want |= {(start, e) for e, a, b in active if a in reached or b in reached}
        starts = spark.createDataFrame([("a",), ("h",), ("n1",), ("zz",)], "id string")
        assert sorted(map(tuple, edges_met(graph, neighbours(graph, starts, max(1, depth - 1)), depth).collect())) == sorted(want)


def test_neighbour_edges_stores_no_last_round(spark, tmp_path, monkeypatch):
    # A hub with 150 guardrails and 400 tools: 150 * 550 nodes lie within two edges, 301 are reached within one.
    ids = [f"g{k}" for k in range(150)] + [f"t{k}" for k in range(400)]
    now = datetime(2026, 1, 1)
    spark.createDataFrame([(i, "guardrail" if i[0] == "g" else "tool", "active", now) for i in ids], "id string, kind string, status string, updated_at timestamp").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(f"e{i}", i, "hub", "active", now) for i in ids], "id string, source_id string, target_id string, status string, updated_at timestamp").write.parquet(f"{tmp_path}/edges.parquet")
    stored = []
    for module in (graph_module, graph_queries):
        monkeypatch.setattr(module, "cut_lineage", lambda df, eager=True, cut=cut_lineage: stored.append(cut(df, eager)) or stored[-1], raising=False)
    got = graph_queries.neighbour_edges(spark, str(tmp_path))
    assert got.count() == got.distinct().count() == 150 * 550
    assert max(df.count() for df in stored) == 550


def test_validation_notes(spark):
    graph = small(spark)
    chains = [("ok", ["e", "a", "k"], ["e1", "e3"]), ("none", [], []), ("null", None, None), ("noedges", ["e"], []), ("gone", ["e", "zz"], ["e1", "yy"]), ("turned", ["e", "a", "k"], ["e1", "e4"]), ("typed", ["a", "r"], ["e1"]), ("slot", ["e", None], ["e1"])]
    got = {r.id: (r.ok, r.validated_kind, r.notes) for r in validate_chains(spark.createDataFrame(chains, "id string, chain_nodes array<string>, chain_edges array<string>"), graph).collect()}
    assert got["ok"] == (True, "semantic", []) and got["none"][2] == got["null"][2] == ["no nodes"] and got["noedges"][2] == ["no edges"]
    assert got["gone"][2] == ["missing node zz", "missing edge yy"] and got["slot"][2] == ["missing node (null)"]
    assert got["turned"][2] == ["disconnected: edge e4 links k -> a, expected a -> k"]
    assert got["typed"][2] == ["disconnected: edge e1 links e -> a, expected a -> r", "first node a is not a entry_point", "last node r is not a sink"]
    lists = spark.createDataFrame([("x", ["e1", "no", "e3"]), ("y", [])], "list string, ids array<string>")
    assert {r.list: (r.existing, r.missing) for r in validate_edges(lists, graph.edges).collect()} == {"x": (["e1", "e3"], ["no"]), "y": ([], [])}


def test_empty_graph(spark):
    graph = make(spark, [("x", "agent")], [("e", "x", "y", "k", "control")])
    empty = Graph(graph.nodes.limit(0), graph.edges.limit(0))
    assert find_chains(empty).count() == 0 and chain_groups(empty).count() == 0 and find_chains(graph).count() == 0
