"""Report tables and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import group_sides


def by_kind(rows: DataFrame) -> DataFrame:
    """(kind, n), most first."""
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "kind")


def by_entry(chains: DataFrame, nodes: str = "nodes") -> DataFrame:
    """(entry, n, shortest) of chains by their first node."""
    return chains.groupBy(F.get(nodes, F.lit(0)).alias("entry")).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(nodes) - 1).alias("shortest"))


def verdicts_by_entry(chains: DataFrame) -> DataFrame:
    """(entry, exploitable, not_exploitable, uncertain): evaluated chains by first node and verdict."""
    verdict = F.lower(F.trim("verdict"))
    return chains.groupBy(F.get("chain_nodes", F.lit(0)).alias("entry")).agg(*[F.count_if(verdict == v).alias(v) for v in ("exploitable", "not_exploitable", "uncertain")])


def groups_by(groups: DataFrame, column: str) -> DataFrame:
    """(column, n, validated): groups and validated groups by a clean value, ``none`` for null."""
    return groups.groupBy(F.coalesce(F.lower(F.trim(column)), F.lit("none")).alias(column)).agg(F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("validated"))


def paths_named(chains: DataFrame, nodes: DataFrame, id: str = "chain_id", column: str = "nodes") -> DataFrame:
    """(id, path): ``kind:name -> ...`` of each chain; unknown nodes show their id."""
    cells = chains.select(F.col(id).alias("id"), F.posexplode(column).alias("pos", "node"))
    named = cells.join(nodes.select(F.col("id").alias("node"), F.concat_ws(":", "kind", "name").alias("label")), "node", "left")
    parts = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", "node").alias("label")))).alias("p"))
    return parts.select("id", F.array_join(F.transform("p", lambda x: x["label"]), " -> ").alias("path"))


def groups_section(groups: DataFrame) -> DataFrame:
    """(part, value, n): how many groups there are and were evaluated, validated ones by verdict and by priority, and the rejected,
    evaluated ones that are not valid."""
    verdict, priority = F.lower(F.trim("verdict")), F.lower(F.trim("priority"))
    marks = F.array(
        F.struct(F.lit("all").alias("part"), F.lit("groups").alias("value"), F.lit(True).alias("counts")),
        F.struct(F.lit("all"), F.lit("evaluated"), verdict.isNotNull()),
        F.struct(F.lit("verdict"), F.coalesce(verdict, F.lit("none")), F.col("validated")),
        F.struct(F.lit("priority"), F.coalesce(priority, F.lit("none")), F.col("validated")),
        F.struct(F.lit("all"), F.lit("rejected"), verdict.isNotNull() & ~F.col("validated")),
    )
    return groups.select(F.inline(marks)).filter("counts").groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


def rejected_groups(groups: DataFrame) -> DataFrame:
    """(id, verdict, validated_kind) of the evaluated groups that are not valid, by id."""
    return groups.filter("verdict is not null and not validated").select("id", F.lower(F.trim("verdict")).alias("verdict"), F.lower(F.trim("validated_kind")).alias("validated_kind")).orderBy("id")


def candidates_shown(chains: DataFrame, nodes: str = "nodes", limit: int = 30) -> DataFrame:
    """The first ``limit`` rows of ``by_entry``, most chains first, then by entry."""
    return by_entry(chains, nodes).orderBy(F.col("n").desc(), "entry").limit(limit)


def group_paths(groups: DataFrame, chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, side, pos, path): the named path of every chain that stored groups name; null where the chain is not there. The paths
    are those stored with the chains, so groups of weak links keep theirs."""
    sides = group_sides(groups, chains)
    named = paths_named(sides.filter("nodes is not null").select(F.col("chain_id").alias("id"), "nodes").dropDuplicates(["id"]), nodes, "id", "nodes")
    return sides.join(named.withColumnRenamed("id", "chain_id"), "chain_id", "left").select(F.col("group_id").alias("id"), "side", "pos", "path")


def group_bundle(groups: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, json): a group with the named paths of its chains (id, path) as one JSON object."""
    cells = [groups.select("id", F.lit(side).alias("side"), F.posexplode(f"{side}_chain_ids").alias("pos", "chain")) for side in ("write", "read")]
    found = cells[0].unionByName(cells[1]).join(paths.select(F.col("id").alias("chain"), "path"), "chain", "left")
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("side", "pos", F.col("chain").alias("chain_id"), "path"))).alias("chains"))
    return groups.join(listed, "id", "left").select("id", F.to_json(F.struct("id", "untrusted_source_id", "score", "priority", "verdict", "validated", "chains")).alias("json"))


def latency_statistics(runs: DataFrame) -> DataFrame:
    """(model, n, median, p95, valid_rate, agreement) of benchmark runs (model, latency, valid, agrees).

    The 95th percentile is the value at index floor(0.95 n) of the sorted latencies, at most the last.
    """
    # Equal latencies are counted before anything is ordered, so a model with many runs is a short list of values.
    values = runs.groupBy("model", "latency").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("valid").cast("int")).alias("v"), F.count("valid").alias("vn"), F.sum(F.col("agrees").cast("int")).alias("a"), F.count("agrees").alias("an"))
    order = Window.partitionBy("model").orderBy("latency")
    upto = values.withColumn("upto", F.sum("k").over(order))
    totals = values.groupBy("model").agg(F.sum("k").alias("n"), F.try_divide(F.sum("v"), F.sum("vn")).alias("valid_rate"), F.try_divide(F.sum("a"), F.sum("an")).alias("agreement"))
    placed = upto.select("model", "latency", "upto").join(totals, "model")

    def value(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("latency")))

    n = F.col("n")
    return placed.groupBy("model").agg(
        F.max("n").alias("n"),
        ((value(F.floor((n - 1) / 2)) + value(F.floor(n / 2))) / 2).alias("median"),
        value(F.least(F.floor(n * 0.95), n - 1)).alias("p95"),
        F.max("valid_rate").alias("valid_rate"),
        F.max("agreement").alias("agreement"),
    )


def bundle(chains: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, json): a chain with its named path as one JSON object."""
    joined = chains.join(paths, "id", "left")
    return joined.select("id", F.to_json(F.struct("id", "path", "verdict", "confidence", "validated", "chain_edges")).alias("json"))


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 30) -> str:
    """A report of the first ``rows`` rows of each table; the only place where report rows reach the driver."""
    out = [f"# {title}"]
    for name, frame in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in frame.limit(rows).collect()]
    return "\n".join(out) + "\n"
