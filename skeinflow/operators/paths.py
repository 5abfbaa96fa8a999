"""Bounded simple paths, chains to and from anchors, and the groups that pair them.

A walk goes round by round: open rows are joined to the hops on their current node, the round is written to the checkpoint
folder, rows that have arrived are set aside and never shuffled again, and the walk ends with the first round that leaves
no row open. A lost executor costs one round. Open rows at a node that many paths cross are split by adaptive execution.

Caps keep the order of a depth-first walk that takes edges by id, which is the order of the edge id sequences; they are
ranks over complete results, never limits inside the walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import TRAVERSABLE, Graph, sinks
from .merge import union_all

# The limits below which two linked places are not believed to be one store.
WEAK_FLOOR = 0.3
WEAK_FLOOR_MODEL = 0.1
STRONG = 0.7


def short_hash(prefix: str, payload: Column) -> Column:
    """``prefix:`` and the first sixteen hex digits of the payload's SHA-256."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(payload, 256), 1, 16))


def chain_id(nodes: Column, edges: Column) -> Column:
    """The content id of a chain: over its edge ids and node ids as canonical JSON. Ids must be ASCII."""
    return short_hash("chain", F.to_json(F.struct(edges.alias("edges"), nodes.alias("nodes"))))


def group_id(source: Column, write: Column, read: Column, store: Column) -> Column:
    """The content id of a pair of chains; a null store is left out of the payload."""
    return short_hash("chain_group", F.to_json(F.struct(F.array(read).alias("read"), source.alias("source"), store.alias("store"), F.array(write).alias("write"))))


def walk(starts: DataFrame, first: DataFrame, later: DataFrame, max_hops: int) -> DataFrame:
    """(start, nodes, edges, runtime, link, link_source) of the simple paths that arrive within ``max_hops``.

    ``starts`` has a column ``start``. Hops have (src, dst, edge, arrives, runtime, link, link_source): ``arrives`` ends a
    path at dst; ``runtime`` is true for a path if it is for any hop; link and link_source are those of the first hop.
    ``first`` are the hops that may leave a start. A path never visits a node twice.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    names = ("src", "dst", "edge", "arrives", "runtime", "link", "link_source")
    named = [cut_lineage(hops.select(*[F.col(c).alias(f"h_{c}") for c in names])) for hops in ([first] if first is later else [first, later])]
    open_ = starts.select("start", F.col("start").alias("cur"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(False).alias("runtime"), F.lit(None).cast("double").alias("link"), F.lit(None).cast("string").alias("link_source"))
    arrived = []
    for k in range(max_hops):
        joined = open_.join(named[min(k, len(named) - 1)], (F.col("cur") == F.col("h_src")) & ~F.array_contains("nodes", F.col("h_dst")))
        # The last round keeps nothing that has not arrived.
        met = joined if k + 1 < max_hops else joined.filter("h_arrives")
        state = cut_lineage(
            met.select(
                "start",
                F.col("h_dst").alias("cur"),
                F.concat("nodes", F.array("h_dst")).alias("nodes"),
                F.concat("edges", F.array("h_edge")).alias("edges"),
                F.col("h_arrives").alias("done"),
                (F.col("runtime") | F.col("h_runtime")).alias("runtime"),
                *([F.col("h_link").alias("link"), F.col("h_link_source").alias("link_source")] if k == 0 else ["link", "link_source"]),
            )
        )
        arrived.append(state.filter("done").drop("cur", "done"))
        open_ = state.filter("not done").drop("done")
        if open_.isEmpty():
            break
    return union_all(arrived)


def _hops(edges: DataFrame, arrivals: DataFrame, backwards: bool = False, anchored: bool = False) -> DataFrame:
    """Hops over the active traversable edges; ``anchored`` adds the structural edges that name an anchor's end."""
    passes = F.col("flow_kind").isin(*TRAVERSABLE)
    anchor = F.col("kind") == "writes_to" if anchored else F.lit(False)
    link = [F.when(anchor, F.col("identity_confidence")), F.when(anchor, F.get_json_object("attributes", "$.identity_source"))] if anchored else [F.lit(None).cast("double"), F.lit(None).cast("string")]
    src, dst = ("target_id", "source_id") if backwards else ("source_id", "target_id")
    ends = arrivals.select(F.col("id").alias("dst"), F.lit(True).alias("ends")).distinct()
    rows = edges.filter((F.col("status") == "active") & (passes | anchor)).select(
        F.col(src).alias("src"),
        F.col(dst).alias("dst"),
        F.col("id").alias("edge"),
        F.coalesce(F.array_contains("observed_by", "runtime"), F.lit(False)).alias("runtime"),
        link[0].alias("link"),
        link[1].alias("link_source"),
    )
    return rows.join(ends, "dst", "left").withColumn("arrives", F.coalesce("ends", F.lit(False)))


def find_chains(graph: Graph, entry_kinds: tuple[str, ...] = ("entry_point",), sink_kinds: tuple[str, ...] = ("sink",), max_hops: int = 6, max_candidates: int | None = 1000, data_edges_only: bool = False) -> DataFrame:
    """(chain_id, nodes, edges, length) of the paths from an entry to the first sink they meet.

    Entries and sinks must be active, nodes between need not. With ``data_edges_only`` only chains that a run observed on
    at least one edge come out. The first ``max_candidates`` in the order of entry id and edge ids are kept; None keeps
    all. No entry or no sink gives no chain.
    """
    starts = graph.nodes.filter((F.col("status") == "active") & F.col("kind").isin(*entry_kinds)).select(F.col("id").alias("start"))
    hops = _hops(graph.edges, sinks(graph.nodes, sink_kinds))
    found = walk(starts, hops, hops, max_hops)
    if data_edges_only:
        found = found.filter("runtime")
    if max_candidates is not None:
        found = found.orderBy("start", "edges").limit(max_candidates)
    return found.select(chain_id(F.col("nodes"), F.col("edges")).alias("chain_id"), "nodes", "edges", F.size("edges").alias("length"))


def write_chains(graph: Graph, anchors: DataFrame, max_hops: int = 6, cap: int = 100) -> DataFrame:
    """(anchor, chain_id, nodes, edges, link, link_source): walks back from each anchor to the first entry point.

    The hop at the anchor may be a ``writes_to`` edge of any flow kind and then gives the link; all others must be
    traversable. The first ``cap`` per anchor in the order of the walk are kept. ``anchors`` has a column ``id``.
    """
    entries = graph.nodes.filter("status = 'active' and kind = 'entry_point'").select("id")
    found = walk(anchors.select(F.col("id").alias("start")), _hops(graph.edges, entries, True, True), _hops(graph.edges, entries, True), max_hops)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("edges"))).filter(F.col("rank") <= cap)
    nodes, edges = F.reverse("nodes"), F.reverse("edges")
    return ranked.select(F.col("start").alias("anchor"), chain_id(nodes, edges).alias("chain_id"), nodes.alias("nodes"), edges.alias("edges"), "link", "link_source")


def read_chains(graph: Graph, sources: DataFrame, max_hops: int = 6, cap: int = 100) -> DataFrame:
    """(anchor, chain_id, nodes, edges): walks from each source to the first sink, the first ``cap`` per source."""
    hops = _hops(graph.edges, sinks(graph.nodes))
    found = walk(sources.select(F.col("id").alias("start")), hops, hops, max_hops)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("edges"))).filter(F.col("rank") <= cap)
    return ranked.select(F.col("start").alias("anchor"), chain_id(F.col("nodes"), F.col("edges")).alias("chain_id"), "nodes", "edges")


def join_confidence(write: Column, read: Column) -> Column:
    """The weaker of two links; null if either is."""
    return F.when(write.isNotNull() & read.isNotNull(), F.least(write, read))


def chain_groups(graph: Graph, max_hops: int = 6, max_write: int = 100, max_read: int = 100, max_groups: int | None = 1000, include_weak: bool = False, threshold: float = STRONG) -> DataFrame:
    """Pairs of a write chain and a read chain that meet at a source, or at a store that a source reads from.

    (ord, group_id, source_id, store_id, write_id, read_id, write_nodes, write_edges, read_nodes, read_edges,
    store_confidence, weak). Pairs at a source come first, by source, write and read id; then those at a store, by store,
    source, write and read id. A store pair needs both links; it is as strong as the weaker one, must reach ``WEAK_FLOOR``
    (``WEAK_FLOOR_MODEL`` if a model named either link) and, unless ``include_weak``, ``threshold``. The first
    ``max_groups`` in this order are kept, None keeps all; ``ord`` is then null. Counts of pairs are bounded by the caps
    per anchor. Wrong limits raise ValueError.
    """
    if min(max_hops, max_write, max_read) < 1 or max_groups is not None and max_groups < 0 or not 0 <= threshold <= 1:
        raise ValueError("limits must be positive and the threshold between 0 and 1")
    active = graph.nodes.filter("status = 'active'")
    sources = active.filter("kind = 'untrusted_source'").select("id")
    stores = active.filter("kind = 'store'").select("id")
    reads = read_chains(graph, sources, max_hops, max_read).select(F.col("anchor").alias("source_id"), F.col("chain_id").alias("read_id"), F.col("nodes").alias("read_nodes"), F.col("edges").alias("read_edges"))
    writes = write_chains(graph, sources.union(stores), max_hops, max_write).select("anchor", F.col("chain_id").alias("write_id"), F.col("nodes").alias("write_nodes"), F.col("edges").alias("write_edges"), "link", "link_source")

    at_source = writes.join(reads, F.col("anchor") == F.col("source_id")).select("source_id", F.lit(None).cast("string").alias("store_id"), "write_id", "read_id", "write_nodes", "write_edges", "read_nodes", "read_edges", F.lit(None).cast("double").alias("store_confidence"), F.lit(False).alias("weak"))
    links = graph.edges.filter("status = 'active' and kind = 'reads_from'").select(F.col("source_id").alias("store_id"), F.col("target_id").alias("source_id"), F.col("identity_confidence").alias("read_link"), F.get_json_object("attributes", "$.identity_source").alias("read_source"))
    links = links.join(stores.withColumnRenamed("id", "store_id"), "store_id", "left_semi").join(sources.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    confidence = join_confidence(F.col("link"), F.col("read_link"))
    model = F.coalesce(F.col("link_source") == "llm", F.lit(False)) | F.coalesce(F.col("read_source") == "llm", F.lit(False))
    pairs = (
        links.join(writes, F.col("store_id") == F.col("anchor"))
        .withColumn("store_confidence", confidence)
        .filter(F.col("store_confidence") >= F.when(model, WEAK_FLOOR_MODEL).otherwise(WEAK_FLOOR))
        .withColumn("weak", F.col("store_confidence") < threshold)
    )
    if not include_weak:
        pairs = pairs.filter("not weak")
    at_store = pairs.join(reads, "source_id").select(*at_source.columns)
    both = at_source.unionByName(at_store).withColumn("group_id", group_id(F.col("source_id"), F.col("write_id"), F.col("read_id"), F.col("store_id")))
    order = [F.col("store_id").asc_nulls_first(), F.col("source_id"), F.col("write_id"), F.col("read_id")]
    if max_groups is None:
        return both.withColumn("ord", F.lit(None).cast("int"))
    # The limit bounds what the single-partition rank sees.
    return both.orderBy(*order).limit(max_groups).withColumn("ord", F.row_number().over(Window.orderBy(*order)))
