"""Checks of chains against the graph: existence, connection, typing and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import SINK_CAPABILITIES, SOURCE_TYPES, Graph


def validate_edges(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """(list, existing, missing): the ids of the array column ``ids``, in order, split by whether an edge has them."""
    wanted = lists.select("list", F.posexplode_outer("ids").alias("pos", "id"))
    known = edges.select("id").distinct().withColumn("known", F.lit(True))
    marked = wanted.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    item = F.struct("pos", "id")
    split = marked.groupBy("list").agg(F.array_sort(F.collect_list(F.when(F.col("known"), item))).alias("e"), F.array_sort(F.collect_list(F.when(~F.col("known") & F.col("id").isNotNull(), item))).alias("m"))
    return split.select("list", F.col("e.id").alias("existing"), F.col("m.id").alias("missing"))


def usable_anchors(graph: Graph, types: tuple[str, ...] = SOURCE_TYPES) -> DataFrame:
    """(id) of the sources of a known type that a node which reads untrusted text has access from."""
    source_type = F.coalesce(F.get_json_object("attributes", "$.source_type"), F.lit(""))
    sources = graph.nodes.filter((F.col("kind") == "untrusted_source") & source_type.isin(*types)).select("id")
    readers = graph.nodes.filter(F.coalesce(F.array_contains("capabilities", "reads_untrusted"), F.lit(False))).select(F.col("id").alias("target_id"))
    access = graph.edges.filter("kind = 'has_access_to'").join(readers, "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return sources.join(access, "id", "left_semi")


def validate_chains(chains: DataFrame, graph: Graph, id: str = "id", entry_kind: str = "entry_point", sink_kind: str = "sink") -> DataFrame:
    """(id, ok, validated_kind, notes) of every chain with the array columns ``chain_nodes`` and ``chain_edges``.

    Notes come in the order of the checks and of the chain. A chain with missing nodes or edges gets notes about these
    only. Null and empty arrays are chains without nodes or edges. ``id`` must be unique; status is not looked at.

    Nodes and edges of the chains are looked up in one shuffle each, and come back to their chain in one.
    """
    base = chains.select(F.col(id).alias("id"), F.coalesce("chain_nodes", F.array().cast("array<string>")).alias("n"), F.coalesce("chain_edges", F.array().cast("array<string>")).alias("e"))
    anchors = usable_anchors(graph).withColumn("usable", F.lit(True))
    dangerous = F.coalesce(F.arrays_overlap("capabilities", F.array(*[F.lit(c) for c in SINK_CAPABILITIES])), F.lit(False))
    known_nodes = graph.nodes.select(F.col("id").alias("ref"), "kind", ((F.col("kind") == sink_kind) | dangerous).alias("sink")).join(anchors.withColumnRenamed("id", "ref"), "ref", "left")
    known_edges = graph.edges.select(F.col("id").alias("ref"), "source_id", "target_id")
    nodes = base.select("id", F.posexplode("n").alias("pos", "ref")).join(known_nodes, "ref", "left")
    edges = base.select("id", F.posexplode("e").alias("pos", "ref"), "n").select("id", "pos", "ref", F.get("n", F.col("pos")).alias("a"), F.get("n", F.col("pos") + 1).alias("b"), (F.col("pos") < F.size("n") - 1).alias("hop")).join(known_edges, "ref", "left")

    def note(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    node_notes = nodes.select(
        "id",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("kind").isNull(), F.struct(F.lit(0).alias("check"), "pos", note("missing node ", F.coalesce("ref", F.lit("(null)"))).alias("text"))),
                    F.when((F.col("kind") == "untrusted_source") & F.col("usable").isNull(), F.struct(F.lit(5).alias("check"), "pos", note("untrusted anchor ", F.col("ref"), " is not a usable source").alias("text"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("note"),
    )
    edge_notes = edges.select(
        "id",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("source_id").isNull(), F.struct(F.lit(1).alias("check"), "pos", note("missing edge ", F.coalesce("ref", F.lit("(null)"))).alias("text"))),
                    F.when(F.col("hop") & F.col("source_id").isNotNull() & ((F.col("source_id") != F.col("a")) | (F.col("target_id") != F.col("b"))), F.struct(F.lit(3).alias("check"), "pos", note("disconnected: edge ", F.col("ref"), " links ", F.col("source_id"), " -> ", F.col("target_id"), ", expected ", F.col("a"), " -> ", F.col("b")).alias("text"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("note"),
    )
    ends = nodes.groupBy("id").agg(F.min_by("kind", "pos").alias("first_kind"), F.max_by("sink", "pos").alias("last_sink"))
    notes = node_notes.unionByName(edge_notes).groupBy("id").agg(F.collect_list("note").alias("found"))
    whole = base.join(ends, "id", "left").join(notes, "id", "left")
    own = F.filter(
        F.array(
            F.when(F.size("n") == 0, F.struct(F.lit(0).alias("check"), F.lit(-1).alias("pos"), F.lit("no nodes").alias("text"))),
            F.when((F.size("n") > 0) & (F.size("e") == 0), F.struct(F.lit(0).alias("check"), F.lit(-1).alias("pos"), F.lit("no edges").alias("text"))),
            F.when(F.size("e") != F.size("n") - 1, F.struct(F.lit(2).alias("check"), F.lit(-1).alias("pos"), note("hop count: ", F.size("e").cast("string"), " edge(s) for ", F.size("n").cast("string"), " node(s), expected ", (F.size("n") - 1).cast("string")).alias("text"))),
            F.when(~F.coalesce(F.col("first_kind") == entry_kind, F.lit(False)), F.struct(F.lit(4).alias("check"), F.lit(0).alias("pos"), note("first node ", F.get("n", F.lit(0)), f" is not a {entry_kind}").alias("text"))),
            F.when(~F.coalesce(F.col("last_sink"), F.lit(False)), F.struct(F.lit(4).alias("check"), F.lit(1).alias("pos"), note("last node ", F.element_at("n", -1), f" is not a {sink_kind}").alias("text"))),
        ),
        lambda x: x.isNotNull() & x["text"].isNotNull(),
    )
    # An empty chain fails on its first note; element_at of an empty array must not be reached in ANSI mode.
    sized = whole.withColumn("n", F.when(F.size("n") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("n"))).withColumn("empty", F.get("n", F.lit(0)).isNull() & (F.size("n") == 1))
    gathered = sized.select("id", "empty", F.when(F.col("empty"), F.array(F.struct(F.lit(0).alias("check"), F.lit(-1).alias("pos"), F.lit("no nodes").alias("text")))).otherwise(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("found", F.filter(own, lambda x: F.lit(False))))))).alias("found"))
    missing = F.filter("found", lambda x: x["check"] <= 1)
    chosen = gathered.select("id", F.when(F.size(missing) > 0, missing).otherwise(F.col("found")).alias("found"))
    ok = F.size("found") == 0
    texts = F.transform("found", lambda x: x["text"])
    return chosen.select("id", ok.alias("ok"), F.when(ok, "semantic").otherwise("existence").alias("validated_kind"), F.array_distinct(texts).alias("notes"))


def chain_faces(chains: DataFrame, graph: Graph, id: str = "id", entry_kind: str = "entry_point", sink_kind: str = "sink") -> DataFrame:
    """(id, exists, connected, typed): whether all nodes and edges of a chain are there; whether it has an edge less than nodes
    and each leads from its node to the next; whether it begins at an entry and ends at a sink."""
    base = chains.select(F.col(id).alias("id"), F.coalesce("chain_nodes", F.array().cast("array<string>")).alias("n"), F.coalesce("chain_edges", F.array().cast("array<string>")).alias("e"))
    dangerous = F.coalesce(F.arrays_overlap("capabilities", F.array(*[F.lit(c) for c in SINK_CAPABILITIES])), F.lit(False))
    known = graph.nodes.select(F.col("id").alias("ref"), "kind", ((F.col("kind") == sink_kind) | dangerous).alias("sink"))
    nodes = base.select("id", F.posexplode("n").alias("pos", "ref"), (F.size("n") - 1).alias("last")).join(known, "ref", "left")
    of_nodes = nodes.groupBy("id").agg(F.bool_and(F.col("kind").isNotNull()).alias("nodes_there"), F.bool_or((F.col("pos") == 0) & (F.col("kind") == entry_kind)).alias("begins"), F.bool_or((F.col("pos") == F.col("last")) & F.col("sink")).alias("ends"))
    edges = base.select("id", F.posexplode("e").alias("pos", "ref"), "n").select("id", "ref", F.get("n", F.col("pos")).alias("a"), F.get("n", F.col("pos") + 1).alias("b")).join(graph.edges.select(F.col("id").alias("ref"), "source_id", "target_id"), "ref", "left")
    of_edges = edges.groupBy("id").agg(F.bool_and(F.col("source_id").isNotNull()).alias("edges_there"), F.bool_and(F.coalesce((F.col("source_id") == F.col("a")) & (F.col("target_id") == F.col("b")), F.lit(False))).alias("lead"))
    whole = base.join(of_nodes, "id", "left").join(of_edges, "id", "left")
    some = (F.size("n") > 0) & (F.size("e") > 0)
    no = F.lit(False)
    return whole.select(
        "id",
        (some & F.coalesce("nodes_there", no) & F.coalesce("edges_there", no)).alias("exists"),
        (some & (F.size("e") == F.size("n") - 1) & F.coalesce("lead", no)).alias("connected"),
        (F.coalesce("begins", no) & F.coalesce("ends", no)).alias("typed"),
    )
