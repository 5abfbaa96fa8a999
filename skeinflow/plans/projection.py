"""A graph projected from the star-schema tables, for runs at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.merge import union_all
from ..tables import table


def _nodes(parts: list[tuple[DataFrame, object, str, object, object]]) -> DataFrame:
    return union_all([rows.select(id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), caps.alias("capabilities"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("attributes")) for rows, id, kind, name, caps in parts])


def projected_graph(spark: SparkSession, folder: str) -> Graph:
    """Nations are entry points and sources, customers agents, orders tools, parts sinks, suppliers stores."""
    nation, customer, orders, part, supplier, lineitem = (table(spark, folder, t) for t in ("nation", "customer", "orders", "part", "supplier", "lineitem"))
    none = F.array().cast("array<string>")

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def caps(*names: str):
        return F.array(*[F.lit(n) for n in names])

    by_type = F.when(F.col("p_type") == "ECONOMY", caps("executes_shell")).when(F.col("p_type") == "STANDARD", caps("writes_db")).when(F.col("p_type") == "PROMO", caps("http_egress")).when(F.col("p_type") == "SMALL", caps("writes_filesystem", "http_egress")).when(F.col("p_type") == "MEDIUM", caps("executes_code", "writes_db")).otherwise(caps("reads_db"))
    nodes = _nodes(
        [
            (nation.filter("n_regionkey = 0"), key("entry_point:N", "n_nationkey"), "entry_point", F.col("n_name"), none),
            (customer, key("agent:C", "c_custkey"), "agent", F.col("c_name"), caps("calls_llm")),
            (orders, key("tool:O", "o_orderkey"), "tool", F.col("o_orderpriority"), F.when(F.col("o_orderpriority") == "1-URGENT", caps("reads_untrusted", "reads_env")).otherwise(caps("reads_db"))),
            (supplier, key("store:S", "s_suppkey"), "store", F.concat(F.lit("fs:"), "s_name"), none),
            (nation, key("untrusted_source:U", "n_nationkey"), "untrusted_source", F.concat(F.get(caps("rag_corpus", "mcp_tool_description", "email_inbox"), F.col("n_nationkey") % 3), F.lit(":read")), none),
            (part, key("sink:P", "p_partkey"), "sink", F.col("p_name"), by_type),
        ]
    )

    def edges(rows: DataFrame, id, source, target, kind: str, flow, identity=None, runtime=None) -> DataFrame:
        observed = F.when(runtime, caps("ast", "runtime")).otherwise(caps("ast")) if runtime is not None else caps("ast")
        return rows.select(id.alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), flow.alias("flow_kind"), (identity if identity is not None else F.lit(None).cast("double")).alias("identity_confidence"), observed.alias("observed_by"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("attributes"))

    local = customer.join(nation.filter("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    uses = lineitem.groupBy("l_orderkey", "l_partkey").agg((F.max("l_returnflag") == "R").alias("data"))
    writes = lineitem.filter("l_discount >= 0.09 and l_quantity >= 40").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_linenumber").alias("n"))
    control, structural = F.lit("control"), F.lit("structural")
    all_edges = union_all(
        [
            edges(local, key("edge:NC", "c_custkey"), key("entry_point:N", "c_nationkey"), key("agent:C", "c_custkey"), "delegates_to", control),
            edges(orders, key("edge:CO", "o_orderkey"), key("agent:C", "o_custkey"), key("tool:O", "o_orderkey"), "uses_tool", control),
            edges(uses, F.concat(key("edge:OP", "l_orderkey"), key("_", "l_partkey")), key("tool:O", "l_orderkey"), key("sink:P", "l_partkey"), "has_access_to", F.when(F.col("data"), "data").otherwise("control"), None, F.col("data")),
            edges(writes, F.concat(key("edge:OS", "l_orderkey"), key("_", "l_suppkey")), key("tool:O", "l_orderkey"), key("store:S", "l_suppkey"), "writes_to", structural, (1 + F.col("n") % 5 + F.col("l_suppkey") % 3).cast("double") / 8),
            edges(supplier, key("edge:SU", "s_suppkey"), key("store:S", "s_suppkey"), key("untrusted_source:U", "s_nationkey"), "reads_from", structural, (1 + F.col("s_suppkey") % 7).cast("double") / 8),
            edges(nation.join(part.filter("p_size <= 4"), F.col("p_partkey") % 25 == F.col("n_nationkey")), F.concat(key("edge:UP", "n_nationkey"), key("_", "p_partkey")), key("untrusted_source:U", "n_nationkey"), key("sink:P", "p_partkey"), "has_access_to", control),
        ]
    )
    return Graph(nodes, all_edges)
