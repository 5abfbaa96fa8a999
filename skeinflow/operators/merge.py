"""Merging of re-observed rows: nodes, edges, findings, chains and groups; detector results; identity confidence.

Every merge is one grouped aggregation over a union with a sequence column; nothing is folded row by row on the driver.
Floats are multiplied in sequence order, so results do not depend on how rows were partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: no combination of signals is surer than this.
CERTAIN = 0.99


def combine_signals(base: Column, signals: Column) -> Column:
    """``base`` raised by each signal of the array in order: ``1 - (1-base)(1-s1)...``, at most ``CERTAIN``."""
    return F.least(F.lit(CERTAIN), 1 - F.aggregate(signals, 1 - base, lambda rest, s: rest * (1 - s)))


def combine_identity(values: Column) -> Column:
    """An ordered array of identity confidences as one: nulls say nothing, each step is capped at ``CERTAIN``."""
    first = F.lit(None).cast("double")
    return F.aggregate(values, first, lambda old, new: F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.least(F.lit(CERTAIN), 1 - (1 - old) * (1 - new))))


def _set(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(column, F.array().cast("array<string>"))))))


def _in_order(seq: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))), lambda x: x["v"])


def object_of(attributes: Column) -> Column:
    """A JSON object as a map of typed values; what is no object is an empty one."""
    return F.coalesce(F.from_json(attributes, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def object_json(values: Column) -> Column:
    """A map of typed values as JSON, keys in order; numbers, booleans, nulls and nested values stay what they are."""

    def pair(key: Column) -> Column:
        return F.concat(F.regexp_replace(F.to_json(F.struct(key.alias("k"))), r'^\{"k":(.*)\}$', "$1"), F.lit(":"), F.to_json(F.element_at(values, key)))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(values)), pair), ","), F.lit("}"))


def _attributes(seq: str, column: str = "attributes") -> Column:
    """JSON objects merged key by key, later ones winning; what is no object says nothing. Needs last-wins maps."""
    maps = F.transform(_in_order(seq, column), object_of)
    empty = F.create_map().cast("map<string,variant>")
    merged = F.aggregate(maps, empty, lambda old, new: F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new))
    return merged


def _with_json(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, object_json(F.col(column)))


def merge_nodes(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per node id: sets united, confidence the largest, attributes by key, everything else from the last row.

    ``seq`` orders the rows; among equal ones any may be the last. Null arrays are empty sets, a null confidence is none.
    """
    last = [F.max_by(c, seq).alias(c) for c in ("kind", "name", "host_id", "content_hash", "status")]
    merged = rows.groupBy("id").agg(*last, _attributes(seq).alias("attributes"), _set("capabilities").alias("capabilities"), _set("observed_by").alias("observed_by"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_rows"))
    return _with_json(merged, "attributes")


def merge_edges(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per edge id, as ``merge_nodes``, and: a verified precision stays; a later ``control`` never replaces
    another flow kind; a data-flow decision stays until another one comes; identity confidences combine in order, for
    ``writes_to`` and ``reads_from`` edges only."""
    last = [F.max_by(c, seq).alias(c) for c in ("source_id", "target_id", "kind", "host_id", "status")]
    other = F.max_by("flow_kind", F.when(F.col("flow_kind") != "control", F.col(seq)))
    decided = F.max_by("data_flow_confirmed", F.when(F.col("data_flow_confirmed").isNotNull(), F.col(seq)))
    merged = rows.groupBy("id").agg(
        *last,
        F.when(F.max((F.col("edge_precision") == "compiler-verified").cast("int")) == 1, "compiler-verified").otherwise(F.max_by("edge_precision", seq)).alias("edge_precision"),
        F.coalesce(other, F.lit("control")).alias("flow_kind"),
        decided.alias("data_flow_confirmed"),
        combine_identity(_in_order(seq, "identity_confidence")).alias("identity_confidence"),
        _attributes(seq).alias("attributes"),
        _set("capabilities").alias("capabilities"),
        _set("observed_by").alias("observed_by"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return _with_json(merged, "attributes").withColumn("identity_confidence", F.when(F.col("kind").isin("writes_to", "reads_from"), F.col("identity_confidence")))


def upsert_nodes(stored: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """``stored`` (one row per id) with ``incoming`` rows merged into it, in the order of ``seq``, which starts at 1."""
    return merge_nodes(stored.withColumn(seq, F.lit(0).cast("long")).unionByName(incoming.withColumn(seq, F.col(seq).cast("long")), allowMissingColumns=True), seq)


def upsert_edges(stored: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """As ``upsert_nodes``, for edges."""
    return merge_edges(stored.withColumn(seq, F.lit(0).cast("long")).unionByName(incoming.withColumn(seq, F.col(seq).cast("long")), allowMissingColumns=True), seq)


def upsert_findings(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per finding id: evidence by key, the largest confidence, everything else from the last row. Rows on both a
    node and an edge, or on neither, are refused by ``findings_fault``."""
    last = [F.max_by(c, seq).alias(c) for c in ("node_id", "edge_id", "scanner", "rule_id", "severity", "title", "description", "status")]
    return _with_json(rows.groupBy("id").agg(*last, _attributes(seq, "evidence").alias("evidence"), F.max("confidence").alias("confidence")), "evidence")


def findings_fault(rows: DataFrame) -> DataFrame:
    """The findings that do not sit on exactly one node or edge."""
    return rows.filter(F.col("node_id").isNull() == F.col("edge_id").isNull())


def upsert_last(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last row of every key: chains, hosts and state values are overwritten whole."""
    others = [c for c in rows.columns if c not in key and c != seq]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(*key, "_r.*")


#: Columns of a group that only an evaluation changes.
EVALUATED = ("verdict", "confidence", "reasoning", "voter_outputs", "prompt_version", "validated", "validated_kind")


def upsert_groups(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per group id: ranking columns from the last row, evaluation columns from the last row with a verdict, or,
    without any, from the first."""
    evaluated = [c for c in EVALUATED if c in rows.columns]
    others = [c for c in rows.columns if c not in (*evaluated, "id", seq)]
    judged = F.when(F.col("verdict").isNotNull(), F.col(seq))
    merged = rows.groupBy("id").agg(F.max_by(F.struct(*others), seq).alias("_r"), F.max_by(F.struct(*evaluated), judged).alias("_e"), F.min_by(F.struct(*evaluated), seq).alias("_f"))
    return merged.select("id", "_r.*", *[F.coalesce(F.col("_e"), F.col("_f"))[c].alias(c) for c in evaluated])


def keep_stronger(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per edge id: the one with the largest identity confidence (null counts as 0), of equal ones the first."""
    best = Window.partitionBy("id").orderBy(F.coalesce("identity_confidence", F.lit(0.0)).desc(), F.col(seq))
    return edges.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def keep_first(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of every id."""
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*others), seq).alias("_r")).select("id", "_r.*")


def edge_id(source: Column, target: Column, kind: Column, host: Column) -> Column:
    """The content id of an edge: parallel edges of one kind have the same."""
    return F.concat(F.lit("edge:"), F.sha2(F.concat_ws(":", source, target, kind, host), 256))


def merge_detected(nodes: DataFrame, edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with those of framework detectors merged in.

    A detected node replaces the nodes of the same name and file and inherits their capabilities if it has none; their
    edges are re-pointed and get new ids, repeated ones are dropped; detected edges come in if their id is new. Both node
    frames have (id, name, file, capabilities, ...), both edge frames (id, source_id, target_id, kind, host_id, ...).
    """
    pairs = nodes.select(F.col("id").alias("old"), "name", "file", F.col("capabilities").alias("old_caps")).join(found_nodes.select(F.col("id").alias("new"), "name", "file"), ["name", "file"])
    inherited = pairs.groupBy("new").agg(_set("old_caps").alias("old_caps"))
    taken = found_nodes.join(inherited, F.col("id") == F.col("new"), "left").withColumn("capabilities", F.when(F.size("capabilities") > 0, F.col("capabilities")).otherwise(F.coalesce("old_caps", "capabilities"))).select(*nodes.columns)
    replaced = pairs.select(F.col("old").alias("id")).distinct()
    kept = nodes.join(replaced, "id", "left_anti").join(found_nodes.select("id"), "id", "left_anti")
    moves = pairs.groupBy("old").agg(F.min("new").alias("new"))
    ends = edges.join(moves.select(F.col("old").alias("source_id"), F.col("new").alias("new_source")), "source_id", "left").join(moves.select(F.col("old").alias("target_id"), F.col("new").alias("new_target")), "target_id", "left")
    moved = ends.withColumn("moved", F.col("new_source").isNotNull() | F.col("new_target").isNotNull()).withColumn("source_id", F.coalesce("new_source", "source_id")).withColumn("target_id", F.coalesce("new_target", "target_id"))
    renamed = moved.withColumn("id", F.when(F.col("moved"), edge_id(F.col("source_id"), F.col("target_id"), F.col("kind"), F.col("host_id"))).otherwise(F.col("id"))).filter("source_id <> target_id").select(*edges.columns)
    all_edges = renamed.withColumn("_p", F.lit(0)).unionByName(found_edges.select(*edges.columns).withColumn("_p", F.lit(1)))
    one = Window.partitionBy("id").orderBy("_p", *[c for c in ("source_id", "target_id", "kind")])
    return kept.select(*nodes.columns).unionByName(taken), all_edges.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n", "_p")


def write_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(added, updated): rows of ``incoming`` with a new id and others; a repeated new id is added once."""
    marked = incoming.select("id").join(stored.select("id", F.lit(True).alias("known")), "id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
    return marked.agg(F.coalesce(F.sum((~F.col("known")).cast("long")), F.lit(0)).alias("added"), F.coalesce(F.sum(F.col("n") - (~F.col("known")).cast("long")), F.lit(0)).alias("updated"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
