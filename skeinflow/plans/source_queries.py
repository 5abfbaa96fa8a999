"""Queries over a planted source tree, and their rows as SQL: facts, flows, places of stores, and the graph that is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build as b
from ..operators import facts, stages
from ..session import cut_lineage
from .planted import planted
from .planted_rows import ROWS


def _found(spark: SparkSession) -> DataFrame:
    return cut_lineage(facts.facts(planted(spark)))


def _joined(column: str):
    return F.array_join(column, "+").alias(column)


def planted_symbols(spark, folder):
    return facts.symbols(_found(spark)).select("path", "kind", "name", "class_name", "line", "line_end")


def planted_capabilities(spark, folder):
    return facts.definition_capabilities(_found(spark)).filter("size(caps) > 0").select("path", "kind", "name", "class_name", _joined("caps"))


def planted_symbol_lookup(spark, folder):
    return facts.symbol_capabilities(_found(spark)).select("path", "name", _joined("caps"))


def planted_module_capabilities(spark, folder):
    return facts.module_capabilities(_found(spark)).select("path", _joined("caps"))


def planted_entries(spark, folder):
    return facts.entry_points(_found(spark)).select("path", "kind", "handler", "method", "target", "line")


def planted_call_graph(spark, folder):
    return facts.call_graph(_found(spark))


def planted_untrusted_reads(spark, folder):
    return facts.untrusted_reads(_found(spark)).select("path", "source_type", "call_target", "line", "reader", "container")


def planted_store_sites(spark, folder):
    return facts.store_sites(_found(spark)).select("path", "family", "side", "hint", "line")


def planted_store_links(spark, folder):
    found = _found(spark)
    links = stages.store_links(facts.store_sites(found), facts.local_imports(found))
    return links.select("path", "family", "side", "hint", "line", "key", F.round("confidence", 9).alias("confidence"))


def planted_sink_flows(spark, folder):
    return facts.sink_flows(_found(spark)).filter("grade <> 'unknown'").select("path", "kind", "name", "grade", _joined("evidence"))


def planted_call_flows(spark, folder):
    return facts.call_flows(_found(spark)).select("path", "scope", "callee", "line", "grade", "flow_kind", _joined("evidence"))


def planted_inheritance(spark, folder):
    found = _found(spark)
    caps = b.class_capabilities(found, facts.definition_capabilities(found))
    return caps.select("file", "name", _joined("caps"))


def planted_guardrail_capability(spark, folder):
    found = _found(spark)
    definitions = facts.definition_capabilities(found)
    return b.guardrail_capability(found, definitions, facts.symbol_capabilities(found, definitions))


def planted_server_usages(spark, folder):
    return facts.server_usages(_found(spark))


def planted_local_imports(spark, folder):
    return facts.local_imports(_found(spark)).select("path", _joined("imports"))


def planted_components(spark, folder):
    found = _found(spark)
    return b.framework_nodes(found, facts.definition_capabilities(found)).select("framework", "kind", "name", "file", "parent", "detail", _joined("capabilities"))


def planted_unclassified(spark, folder):
    found = _found(spark)
    nodes, _ = b.build(found)
    return stages.unclassified(found, nodes)


def planted_model_answers(spark, folder):
    """Nodes and merged capabilities by a table of answers."""
    found = _found(spark)
    nodes, _ = b.build(found)
    answers = spark.createDataFrame([("app/readers.py", "Viewer", "agent", ["reads_filesystem"], False), ("app/agents.py", "Quiet", "tool", ["reads_db"], False), ("app/helper.py", "answer", "agent", ["calls_llm", "reads_env"], False)], "path string, name string, answer_kind string, capabilities array<string>, part_of_parent boolean")
    made, merged = stages.classified_by_model(stages.unclassified(found, nodes), answers, nodes)
    ends = nodes.select("id", "kind", "name", "file")
    return made.select("kind", "name", "file", "framework", _joined("capabilities")).unionByName(merged.join(ends, "id").select("kind", "name", "file", F.lit("merged").alias("framework"), _joined("capabilities")))


def planted_identity_answers(spark, folder):
    """Stores that a model named for sites without a hint, and the links of the components around them."""
    found = _found(spark)
    viewer = b.entry_nodes(found).limit(1).select(*[F.lit(v).cast(t).alias(c) for c, t, v in (("id", "string", "tool:refresh"), ("kind", "string", "tool"), ("name", "string", "stash"), ("file", "string", "app/readers.py"), ("capabilities", "array<string>", None), ("parent", "string", None), ("line", "int", 9), ("framework", "string", None), ("detail", "string", None), ("stage", "int", 2))])
    answers = spark.createDataFrame([("app/readers.py", 6, "data/notes"), ("app/readers.py", 10, "data/notes"), ("srv.py", 9, "out of scope")], "path string, line int, hint string")
    stores, edges = stages.answered_stores(found, b.entry_nodes(found).unionByName(viewer), answers)
    return stores.select("name", F.lit(None).cast("double").alias("identity_confidence"), F.lit(None).cast("string").alias("via")).unionByName(edges.select("kind", F.round("identity_confidence", 9).alias("identity_confidence"), "via").withColumnRenamed("kind", "name"))


def _built(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return b.build(_found(spark))


def built_nodes(spark, folder):
    return _built(spark)[0].select("kind", "name", "file", "parent", "framework", "detail", _joined("capabilities"), "flow", "returns_data", "lethal_trifecta")


def built_edges(spark, folder):
    nodes, edges = _built(spark)
    label = F.concat_ws(":", "kind", "name")
    ends = nodes.select("id", label.alias("label"))
    return edges.join(ends.select(F.col("id").alias("source_id"), F.col("label").alias("source")), "source_id").join(ends.select(F.col("id").alias("target_id"), F.col("label").alias("target")), "target_id").select("source", "kind", "target", "flow_kind", F.round("identity_confidence", 9).alias("identity_confidence"), "via")


QUERIES = {f.__name__: f for f in (planted_symbols, planted_capabilities, planted_symbol_lookup, planted_module_capabilities, planted_entries, planted_call_graph, planted_untrusted_reads, planted_store_sites, planted_store_links, planted_sink_flows, planted_call_flows, planted_inheritance, planted_guardrail_capability, planted_server_usages, planted_local_imports, planted_components, planted_unclassified, planted_model_answers, planted_identity_answers, built_nodes, built_edges)}


def _value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else str(v)


def _values(columns: str, rows: list[tuple]) -> str:
    """The rows as SQL."""
    names = [c.split() for c in columns.split(", ")]
    listed = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    return "select " + ", ".join(f'cast("{n}" as {t}) "{n}"' for n, t in names) + f" from (values {listed}) t(" + ", ".join(f'"{n}"' for n, _ in names) + ")"


SQL = {name: _values(*expected) for name, expected in ROWS.items()}
