"""The property graph as two DataFrames, and queries on its neighbourhood structure."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import latest, table

# Vocabularies of the data model.
TRAVERSABLE = ("control", "data")
STRUCTURAL_EDGES = ("guards", "writes_to", "reads_from")
CONTROL_EDGES = ("uses_model", "uses_tool", "provides_tool", "delegates_to")
SINK_CAPABILITIES = ("executes_code", "executes_shell", "writes_filesystem", "writes_db", "http_egress")
SOURCE_TYPES = ("rag_corpus", "mcp_tool_description", "email_inbox")
#: Edges of a node that are met together; more of them are dealt into parts.
CROWD = 1024

NODE_COLUMNS = ("id", "kind", "name", "host_id", "attributes", "capabilities", "observed_by", "confidence", "content_hash", "status", "created_at", "updated_at")
EDGE_COLUMNS = ("id", "source_id", "target_id", "kind", "host_id", "edge_precision", "flow_kind", "data_flow_confirmed", "identity_confidence", "attributes", "capabilities", "observed_by", "confidence", "status", "created_at", "updated_at")
#: The columns that walks over the graph read.
WALK_NODES = ("id", "kind", "capabilities", "status")
WALK_EDGES = ("id", "source_id", "target_id", "flow_kind", "observed_by", "status")
LINK_EDGES = (*WALK_EDGES, "kind", "identity_confidence", "attributes")


class Graph(NamedTuple):
    """Nodes and edges, one row per id."""

    nodes: DataFrame
    edges: DataFrame


def stored_nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The latest row of every node, with ``id`` and the named columns (none named: all).

    Optimizers do not prune through the aggregation that picks the row, so what is not named here is not read.
    """
    return latest(table(spark, folder, "nodes"), "id", ["id", *(c for c in columns or NODE_COLUMNS if c != "id")])


def stored_edges(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """As ``stored_nodes``, for edges."""
    return latest(table(spark, folder, "edges"), "id", ["id", *(c for c in columns or EDGE_COLUMNS if c != "id")])


def stored_graph(spark: SparkSession, folder: str, nodes: tuple[str, ...] = (), edges: tuple[str, ...] = ()) -> Graph:
    """The graph of the versioned tables: the latest row of every node and edge, with the columns named for each."""
    return Graph(stored_nodes(spark, folder, *nodes), stored_edges(spark, folder, *edges))


def sinks(nodes: DataFrame, kinds: tuple[str, ...] = ("sink",)) -> DataFrame:
    """(id) of the active nodes of a sink kind or with a sink capability; null capabilities are none."""
    dangerous = F.coalesce(F.arrays_overlap("capabilities", F.array(*[F.lit(c) for c in SINK_CAPABILITIES])), F.lit(False))
    return nodes.filter((F.col("status") == "active") & (F.col("kind").isin(*kinds) | dangerous)).select("id")


def subgraph(graph: Graph, node_kinds: list[str] | None = None, edge_kinds: list[str] | None = None, status: str = "active") -> Graph:
    """Nodes of the kinds and the status; edges of the kinds and the status between such nodes."""
    nodes = graph.nodes.filter(F.col("status") == status)
    edges = graph.edges.filter(F.col("status") == status)
    if node_kinds:
        nodes = nodes.filter(F.col("kind").isin(*node_kinds))
    if edge_kinds:
        edges = edges.filter(F.col("kind").isin(*edge_kinds))
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return Graph(nodes, edges)


def neighbours(graph: Graph, starts: DataFrame, depth: int = 1) -> DataFrame:
    """(start, id, distance) of every node within ``depth`` active edges of any kind, in either direction.

    ``starts`` has a column ``id``; each start is its own neighbour at distance 0. A depth under 1 raises ValueError.
    Distances are the smallest; ends without a node row come out as well.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    active = graph.edges.filter("status = 'active'").select("source_id", "target_id")
    both = active.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(active.select("target_id", "source_id"))
    both = cut_lineage(both.distinct()) if depth > 1 else both  # one round reads it once
    found = cut_lineage(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("distance", F.lit(0)))
    frontier = found
    for d in range(1, depth + 1):
        # Only nodes met in the round before are expanded, each of them once however many starts met it.
        step = frontier.join(both, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        frontier = cut_lineage(step.join(found.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def edges_met(graph: Graph, reached: DataFrame, depth: int) -> DataFrame:
    """(start, edge_id) of the active edges that a walk of ``neighbours`` to ``depth`` crosses.

    The nodes nearer than ``depth`` decide, so ``reached`` need not go beyond ``depth`` - 1. Every edge is met at its more
    crowded end, and at the other end only by starts that have not reached the crowded one: no row is made twice, and the
    result, which grows with starts times edges of a hub, is neither shuffled nor stored. The edges of a node with more than
    ``CROWD`` of them are dealt into parts, and the starts that reached it meet each part by itself.
    """
    inner = cut_lineage(reached.filter(F.col("distance") < depth).select("start", "id").distinct())
    active = graph.edges.filter("status = 'active'").select(F.col("id").alias("edge_id"), "source_id", "target_id")
    ends = active.select(F.explode(F.array("source_id", "target_id")).alias("id")).filter("id is not null")
    crowded = cut_lineage(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD))
    sized = active.join(crowded.select(F.col("id").alias("source_id"), F.col("n").alias("n_source")), "source_id", "left").join(crowded.select(F.col("id").alias("target_id"), F.col("n").alias("n_target")), "target_id", "left")
    n_source, n_target = F.coalesce("n_source", F.lit(0)), F.coalesce("n_target", F.lit(0))
    at, away = F.when(n_source > n_target, F.col("source_id")).otherwise(F.col("target_id")), F.when(n_source > n_target, F.col("target_id")).otherwise(F.col("source_id"))
    placed = sized.select("edge_id", at.alias("at"), away.alias("away"), F.pmod(F.xxhash64("edge_id"), _parts(F.greatest(n_source, n_target))).alias("part"))
    dealt = inner.join(crowded, "id", "left").select("start", F.col("id").alias("at"), F.explode(F.sequence(F.lit(0).cast("bigint"), _parts(F.coalesce("n", F.lit(0))) - 1)).alias("part"))
    met = dealt.join(placed, ["at", "part"]).select("start", "edge_id")
    other = inner.join(placed.filter(~F.col("at").eqNullSafe(F.col("away"))), F.col("id") == F.col("away")).select("start", "edge_id", "at")
    return met.unionByName(other.join(inner.withColumnRenamed("id", "at"), ["start", "at"], "left_anti").select("start", "edge_id"))


def _parts(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / CROWD)).cast("bigint")


def slice_findings(findings: DataFrame, node_ids: DataFrame, edge_ids: DataFrame) -> DataFrame:
    """Active findings on one of the nodes (column ``id``) or edges (column ``id``), each once."""
    active = findings.filter("status = 'active'")
    on_nodes = active.join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    on_edges = active.filter("node_id is null").join(edge_ids.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    return on_nodes.unionByName(on_edges)


def in_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` whose id is in the array column ``ids`` of ``ids``, with (list, pos), sorted by them: an ordered id lookup."""
    wanted = ids.select("list", F.posexplode("ids").alias("pos", "id"))
    return wanted.join(rows, "id").orderBy("list", "pos")
