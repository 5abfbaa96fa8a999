"""Scores of chain groups from the nodes they touch, and the selection of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Weights of the score's components and the limits of its buckets.
WEIGHTS = {"lethal_trifecta": 5, "dangerous_sink": 4, "exfil_or_write": 3, "writes_db": 3, "authenticated_entry": 0, "user_writable_source": 2, "user_readable_source": 1, "short_chain": 1, "stale_node": -2, "shared_entry": 0}
SHORT_HOPS = 6
LOW_CONFIDENCE = 0.7
HIGH_FROM, MEDIUM_FROM = 15, 10
# The three capability sets that together make a node dangerous.
TRIFECTA = (("reads_untrusted",), ("reads_secrets", "reads_env"), ("http_egress", "writes_filesystem", "executes_shell", "executes_code"))


def _any(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])), F.lit(False))


def trifecta_hits(column: str, sets: tuple = TRIFECTA) -> Column:
    """All hits, sorted, if each of the three sets is hit; else an empty array."""
    everything = F.array(*[F.lit(v) for group in sets for v in group])
    hits = F.array_sort(F.array_distinct(F.array_intersect(F.col(column), everything)))
    full = F.lit(True)
    for group in sets:
        full = full & _any(column, group)
    return F.when(full, hits).otherwise(F.array().cast("array<string>"))


def score_groups(groups: DataFrame, nodes: DataFrame, sets: tuple = TRIFECTA) -> DataFrame:
    """(group_id, score and one column per component, with the node that earned it) of ``paths.chain_groups``.

    Each group's nodes are looked up once and reduced to flags with map-side combine; a component counts once per group,
    at the smallest node id. The trifecta attribute of a node, where present, overrides what its capabilities say. Groups
    keep their row if none of their nodes exists.
    """
    parts = groups.select(
        "group_id",
        "source_id",
        (F.size("write_edges") + F.size("read_edges")).alias("hops"),
        F.explode(F.concat(F.transform("write_nodes", lambda n: F.struct(n.alias("id"), F.lit(False).alias("read"), F.lit(False).alias("last"))), F.transform("read_nodes", lambda n, i: F.struct(n.alias("id"), F.lit(True).alias("read"), (i == F.size("read_nodes") - 1).alias("last"))))).alias("p"),
    ).select("group_id", "source_id", "hops", "p.*")
    flags = nodes.select(
        "id",
        F.coalesce(F.get_json_object("attributes", "$.lethal_trifecta").cast("boolean"), F.size(trifecta_hits("capabilities", sets)) > 0).alias("trifecta"),
        _any("capabilities", ("executes_shell", "executes_code")).alias("executes"),
        _any("capabilities", ("writes_filesystem", "http_egress")).alias("sends"),
        _any("capabilities", ("writes_db",)).alias("stores"),
        (F.col("confidence") < LOW_CONFIDENCE).alias("low"),
        F.coalesce(F.nullif(F.get_json_object("attributes", "$.source_type"), F.lit("")), F.split_part("name", F.lit(":"), F.lit(1))).alias("source_type"),
    )
    joined = parts.join(flags, "id", "left")

    def at(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("id")))

    seen = joined.groupBy("group_id").agg(
        F.max("hops").alias("hops"),
        at(F.col("read") & F.col("trifecta")).alias("lethal_trifecta_at"),
        at(F.col("last") & F.col("executes")).alias("dangerous_sink_at"),
        at(F.col("last") & F.col("sends")).alias("exfil_or_write_at"),
        at(F.col("read") & F.col("stores")).alias("writes_db_at"),
        at(F.col("low")).alias("stale_node_at"),
        F.max(F.when(F.col("id") == F.col("source_id"), F.col("source_type"))).alias("source_type"),
    )
    earned = {name: F.col(f"{name}_at").isNotNull() for name in ("lethal_trifecta", "dangerous_sink", "exfil_or_write", "writes_db", "stale_node")} | {
        "user_writable_source": F.coalesce(F.col("source_type").isin("user_upload", "rag_corpus"), F.lit(False)),
        "user_readable_source": F.coalesce(F.col("source_type") == "mcp_tool_description", F.lit(False)),
        "short_chain": F.col("hops") <= SHORT_HOPS,
        "authenticated_entry": F.lit(False),
        "shared_entry": F.lit(False),
    }
    points = {name: F.when(earned[name], F.lit(weight)).otherwise(F.lit(0)) for name, weight in WEIGHTS.items()}
    total = F.lit(0)
    for p in points.values():
        total = total + p
    return seen.select("group_id", total.cast("double").alias("score"), *[p.alias(name) for name, p in points.items()], *[f"{n}_at" for n in ("lethal_trifecta", "dangerous_sink", "exfil_or_write", "writes_db", "stale_node")])


def priority(score: Column, high: float = HIGH_FROM, medium: float = MEDIUM_FROM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def prioritise(groups: DataFrame, nodes: DataFrame, max_scored: int = 10_000, max_evaluated: int = 100, min_score: float = 3) -> DataFrame:
    """(group_id, score, priority) of every group: the first ``max_scored`` in the order of enumeration are scored; of those with
    at least ``min_score`` the best ``max_evaluated``, by score and then id, get a priority, all others keep a null one."""
    if min(max_scored, max_evaluated, min_score) < 0:
        raise ValueError("limits must not be negative")
    order = [F.col("store_id").asc_nulls_first(), "source_id", "write_id", "read_id"]
    scored = cut_lineage(score_groups(groups.orderBy(*order).limit(max_scored), nodes).select("group_id", "score"))
    best = scored.filter(F.col("score") >= min_score).orderBy(F.col("score").desc(), "group_id").limit(max_evaluated)
    chosen = best.select("group_id", priority(F.col("score")).alias("priority"))
    return groups.select("group_id").join(scored, "group_id", "left").join(chosen, "group_id", "left")
