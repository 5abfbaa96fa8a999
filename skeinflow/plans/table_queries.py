"""Queries and SQL of merges, row upkeep, evaluation, reports and places in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import closure, evaluation, facts, merge, reports, rows, symbols
from ..operators.graph import Graph, stored_edges, stored_graph, stored_nodes
from ..session import cut_lineage, spread
from ..sources.files import manifest
from ..tables import latest, table
from .graph_queries import LATEST, stored_chains
from .graph_queries import SQL as GRAPH_SQL


def _versions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Every version once: re-delivered rows are equal."""
    return table(spark, folder, name).dropDuplicates(["id", "updated_at"]).withColumn("seq", F.unix_micros("updated_at"))


def upsert_nodes(spark, folder):
    merged = merge.merge_nodes(_versions(spark, folder, "nodes"))
    return merged.select("id", "kind", "name", "status", "confidence", F.array_join("capabilities", "+").alias("capabilities"), F.array_join("observed_by", "+").alias("observed_by"), "host_id", "content_hash", "attributes", "n_rows")


def upsert_edges_identity(spark, folder):
    merged = merge.merge_edges(_versions(spark, folder, "edges"))
    return merged.select("id", "kind", "flow_kind", "edge_precision", "data_flow_confirmed", F.round("identity_confidence", 9).alias("identity_confidence"), "confidence", F.array_join("observed_by", "+").alias("observed_by"), F.array_join("capabilities", "+").alias("capabilities"), "source_id", "target_id", "host_id", "status", "attributes")


def upsert_chains(spark, folder):
    return merge.upsert_last(_versions(spark, folder, "chains").select("id", "verdict", "confidence", "status", "seq"), ["id"])


def upsert_groups(spark, folder):
    kept = _versions(spark, folder, "chain_groups").select("id", "name", "score", "priority", "status", "verdict", "confidence", "validated", "seq")
    return merge.upsert_groups(kept).select("id", "name", F.when(F.isnan("score"), None).otherwise(F.col("score")).alias("score"), "priority", "status", "verdict", "validated")


def keep_stronger(spark, folder):
    return merge.keep_stronger(_versions(spark, folder, "edges")).filter("identity_confidence is not null").select("id", "identity_confidence")


def write_counts(spark, folder):
    versions = table(spark, folder, "nodes")
    return merge.write_counts(versions.filter("updated_at < '2025-07-01'").select("id").distinct(), versions.filter("updated_at >= '2025-07-01'"))


def combine_signals(spark, folder):
    links = stored_edges(spark, folder, "kind", "target_id", "identity_confidence").filter("kind = 'writes_to' and identity_confidence is not null")
    signals = links.groupBy("target_id").agg(F.array_sort(F.collect_list("identity_confidence")).alias("s"))
    return signals.select("target_id", F.round(merge.combine_signals(F.lit(0.3), F.col("s")), 9).alias("combined"))


def vote_aggregate(spark, folder):
    votes = evaluation.votes_of(stored_chains(spark, folder, "voter_outputs"))
    return evaluation.aggregate_votes(votes, table(spark, folder, "voters")).select("chain_id", "verdict", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "n_valid")


def evidence_present(spark, folder):
    chains = stored_chains(spark, folder, "chain_edges", "voter_outputs")
    return evaluation.evidence_present(evaluation.votes_of(chains), chains)


def vote_records(spark, folder):
    chains = stored_chains(spark, folder, "chain_edges", "voter_outputs")
    found = evaluation.vote_records(evaluation.votes_of(chains), chains)
    return found.select("chain_id", F.col("pos").cast("bigint").alias("pos"), "evidence_valid", F.array_join("evidence_unknown", "+").alias("evidence_unknown"))


def reasoning_merged(spark, folder):
    return evaluation.said_reasoning(evaluation.votes_of(stored_chains(spark, folder, "voter_outputs"))).select("chain_id", F.md5("reasoning").alias("reasoning_md5"))


def evaluate_chains(spark, folder):
    chains = stored_chains(spark, folder, "chain_nodes", "chain_edges", "voter_outputs")
    graph = stored_graph(spark, folder, ("kind", "capabilities", "attributes"), ("source_id", "target_id", "kind"))
    found = evaluation.evaluate_chains(chains, graph, evaluation.votes_of(chains), table(spark, folder, "voters"))
    return found.select("id", "verdict", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "validated", "validated_kind", F.size("notes").cast("bigint").alias("n_notes"))


def _groups(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "chain_groups"), "id", ["id", *columns])


def evaluate_groups(spark, folder):
    groups = _groups(spark, folder, "write_chain_ids", "read_chain_ids", "voter_outputs")
    graph = stored_graph(spark, folder, ("capabilities", "attributes"), ("source_id", "target_id", "kind", "flow_kind", "status"))
    found = evaluation.evaluate_groups(groups, stored_chains(spark, folder, "chain_nodes"), graph, evaluation.votes_of(groups), table(spark, folder, "voters"))
    return found.withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


def guardrails_for_groups(spark, folder):
    groups = _groups(spark, folder, "untrusted_source_id", "write_chain_ids", "read_chain_ids")
    graph = stored_graph(spark, folder, ("kind", "name", "attributes", "status"), ("source_id", "target_id", "kind", "status"))
    return evaluation.guardrails_of_groups(groups, stored_chains(spark, folder, "chain_nodes"), graph)


def chain_payloads(spark, folder):
    chains = stored_chains(spark, folder, "chain_nodes", "chain_edges")
    found = evaluation.prompts(evaluation.payloads(chains, stored_graph(spark, folder)))
    payload = F.regexp_replace("user", r"^[^\n]*\n", "")
    kinds = F.from_json(payload, "nodes array<struct<id:string,kind:string>>, edges array<struct<id:string,kind:string>>, guardrails array<struct<id:string>>")
    parsed = found.select("id", kinds.alias("p"))
    return parsed.select("id", F.array_join(F.transform("p.nodes", lambda n: F.concat_ws("=", n["id"], n["kind"])), ">").alias("nodes"), F.array_join(F.transform("p.edges", lambda n: F.concat_ws("=", n["id"], n["kind"])), ">").alias("edges"), F.coalesce(F.array_join(F.transform("p.guardrails", lambda n: n["id"]), ">"), F.lit("")).alias("guardrails"))


def retention_counts(spark, folder):
    nodes, chains = latest(table(spark, folder, "nodes"), "id", ["id", "status", "updated_at"]), stored_chains(spark, folder, "status", "updated_at")
    state = spark.createDataFrame([("localhost", "cleanup_stale_days", "60"), ("localhost", "cleanup_chains_days", "30")], "host_id string, key string, value string")
    kept = rows.retention({"nodes": nodes, "chains": chains}, state, "localhost", F.lit("2025-12-31").cast("timestamp"))
    return merge.union_all([t.groupBy("kept").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "kept", "n") for name, t in kept.items()])


def task_status(spark, folder):
    event = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "started", "view", "started", "click", "done", "error", "failed", "purchase", "cycle")]), F.col("event_type"))
    events = table(spark, folder, "events").select((F.col("user_id") % 97).cast("string").alias("host_id"), F.when(F.col("event_id") % 2 == 0, "static").otherwise("dynamic").alias("kind"), event.alias("event"), F.col("event_id").alias("seq"))
    return rows.task_status(events)


def update_attribute(spark, folder):
    nodes = stored_nodes(spark, folder, "kind", "attributes").filter("kind = 'tool'")
    changed = rows.with_attribute(nodes, "level", F.length("id"))
    return changed.select("id", "attributes")


def marked_active(spark, folder):
    return rows.marked_active(stored_nodes(spark, folder, "confidence", "status").filter("status = 'stale'"))


def hosts_heard(spark, folder):
    events = table(spark, folder, "events")
    hosts = events.select(F.col("user_id").cast("string").alias("id")).distinct().select("id", F.lit("standalone").alias("platform"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("last_heartbeat"))
    heard = rows.heartbeat(hosts, events.filter("event_type = 'view'").select(F.col("user_id").cast("string").alias("host_id"), F.col("ts").alias("at")))
    last = rows.unreachable(heard, F.lit("2100-01-01").cast("timestamp"))
    return last.select("id", "platform", "status", F.unix_micros("last_heartbeat").alias("heard"))


def upsert_findings(spark, folder):
    events = table(spark, folder, "events").select((F.col("event_id") % 500).cast("string").alias("id"), F.col("user_id").cast("string").alias("node_id"), F.lit(None).cast("string").alias("edge_id"), F.col("event_type").alias("scanner"), F.lit(None).cast("string").alias("rule_id"), F.lit("low").alias("severity"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("active").alias("status"), F.col("props").alias("evidence"), F.col("value").alias("confidence"), F.col("event_id").alias("seq"))
    return merge.upsert_findings(events).select("id", "node_id", "scanner", "evidence", "confidence")


def detected_merge(spark, folder):
    """Tools as what a detector found, of the names and files of agents."""
    placed = stored_nodes(spark, folder, "kind", "name", "attributes", "capabilities").withColumn("file", F.get_json_object("attributes", "$.file")).filter("file is not null")
    edges = stored_edges(spark, folder, "source_id", "target_id", "kind", "host_id").select("id", "source_id", "target_id", "kind", "host_id")
    nodes = placed.filter("kind <> 'sink'").select("id", "name", "file", "capabilities")
    found = placed.filter("kind = 'tool'").select(F.concat(F.lit("found:"), "id").alias("id"), "name", "file", F.array().cast("array<string>").alias("capabilities"))
    merged, moved = merge.merge_detected(nodes, edges, found, edges.limit(0))
    ends = moved.groupBy(F.split_part("source_id", F.lit(":"), F.lit(1)).alias("source"), "kind", F.split_part("target_id", F.lit(":"), F.lit(1)).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return ends.unionByName(merged.groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("source")).agg(F.count(F.lit(1)).alias("n")).select("source", F.lit("node").alias("kind"), F.lit("").alias("target"), "n"))


def guardrails_for_chain(spark, folder):
    return evaluation.guardrails_of_chains(stored_chains(spark, folder, "chain_nodes"), stored_graph(spark, folder, ("kind", "name", "attributes", "status"), ("source_id", "target_id", "kind", "status")))


def hop_edges(spark, folder):
    return evaluation.hop_edges(stored_chains(spark, folder, "chain_nodes"), Graph(None, stored_edges(spark, folder, "source_id", "target_id", "kind", "flow_kind", "status")))


def verdict_summary(spark, folder):
    return rows.verdict_summary(stored_chains(spark, folder, "verdict", "validated", "status"))


def verdict_pivot_by_entry(spark, folder):
    return reports.verdicts_by_entry(stored_chains(spark, folder, "chain_nodes", "verdict"))


def groups_by_priority(spark, folder):
    return reports.groups_by(latest(table(spark, folder, "chain_groups"), "id", ["id", "priority", "validated"]), "priority")


def list_actionable(spark, folder):
    return rows.actionable(stored_chains(spark, folder, "verdict", "confidence", "validated", "status", "created_at")).select("id", "confidence")


def severity_summary(spark, folder):
    return rows.severity_summary(_findings(spark, folder))


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    """Error and other events as findings on orders, so that the operators have a table to run on."""
    events = table(spark, folder, "events")
    severity = F.get(F.array(*[F.lit(s) for s in rows.SEVERITIES]), (F.col("event_id") % 4).cast("int"))
    return events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("node_id"), severity.alias("severity"), F.when(F.col("event_type") == "error", "stale").otherwise("active").alias("status"))


def findings_stale(spark, folder):
    return rows.findings_stale_for(_findings(spark, folder), "node_id", "7").filter("changed").select("id", "status")


def mark_stale_for_nodes(spark, folder):
    nodes = stored_nodes(spark, folder, "status").filter("status = 'stale'")
    return rows.stale_for_nodes(stored_chains(spark, folder, "chain_nodes", "status"), nodes)


def cleanup_stale(spark, folder):
    kept = rows.retained(latest(table(spark, folder, "nodes"), "id", ["id", "kind", "status", "updated_at"]), F.lit("2025-12-31").cast("timestamp"), 90)
    return rows.counts(kept, "kind", "status")


def shifted_confidence(spark, folder):
    nodes = stored_nodes(spark, folder, "confidence")
    return nodes.select("id", F.round(rows.shifted(F.col("confidence"), F.lit(-0.25)), 9).alias("confidence"))


def _state(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Users as hosts and their last event of each type as state."""
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("host_id"), F.col("event_type").alias("key"), F.floor("value").cast("int").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return events.select(F.col("host_id").alias("id")).distinct(), merge.upsert_last(events, ["host_id", "key"])


def global_flag(spark, folder):
    hosts, state = _state(spark, folder)
    return rows.global_flag(hosts, state.withColumn("value", F.when(F.col("value").isNotNull(), "true")), "view")


def global_int_min(spark, folder):
    hosts, state = _state(spark, folder)
    return rows.global_int_min(hosts, state, "purchase")


def task_counters(spark, folder):
    event = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "started", "view", "started", "click", "done", "error", "failed", "purchase", "timeout")]), F.col("event_type"))
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("host_id"), F.lit("static").alias("kind"), event.alias("event"), F.col("event_id").alias("seq"))
    return rows.task_counters(events)


def latency_statistics(spark, folder):
    votes = evaluation.votes_of(stored_chains(spark, folder, "voter_outputs")).filter("confidence is not null")
    return reports.latency_statistics(votes.select(F.col("voter").alias("model"), F.col("confidence").alias("latency"), (~F.col("timeout")).alias("valid"), F.col("exploitable").alias("agrees"))).select("model", "n", F.round("median", 6).alias("median"), "p95", F.round("valid_rate", 6).alias("valid_rate"), F.round("agreement", 6).alias("agreement"))


def reachability_closure(spark, folder):
    graph = stored_graph(spark, folder, ("kind",), ("source_id", "target_id", "kind", "status"))
    steps = graph.edges.filter("status = 'active' and kind in ('delegates_to', 'uses_tool')").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return closure.closure(graph.nodes.filter("kind = 'entry_point'").select(F.col("id").alias("start")), steps)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    nodes = stored_nodes(spark, folder, "kind", "attributes")
    return nodes.select("id", "kind", F.get_json_object("attributes", "$.file").alias("file"), F.get_json_object("attributes", "$.line").cast("int").alias("line")).filter("file is not null and line is not null")


def definition_asof(spark, folder):
    placed = _placed(spark, folder)
    return closure.nearest_before(placed.filter("kind = 'sink'"), placed.filter("kind = 'tool'").withColumnRenamed("id", "name"))


def enclosing_definition(spark, folder):
    placed = _placed(spark, folder)
    spans = placed.filter("kind = 'tool'").select("file", F.col("id").alias("name"), F.col("line").alias("line_start"), (F.col("line") + 40).alias("line_end"))
    return closure.enclosing(placed.filter("kind = 'sink'"), spans)


def intra_file_pairs(spark, folder):
    return closure.pair_counts(_placed(spark, folder), "tool", "sink")


def module_suffix_match(spark, folder):
    files = table(spark, folder, "file_entries").filter("path like '%.py'").select(F.col("path").alias("file")).distinct()
    modules = files.select(F.regexp_replace(F.regexp_extract("file", r"([^/]+/[^/]+)\.py$", 1), "/", ".").alias("module")).filter("module <> ''").distinct()
    return tx.match_modules(modules, files)


def literal_match(spark, folder):
    files = table(spark, folder, "file_entries").select("file_id", "path", "language").dropDuplicates(["file_id"])
    top = F.split_part("path", F.lit("/"), F.lit(1))
    return files.select("file_id", tx.literal_match(top, F.col("language")).alias("against_language"), tx.literal_match(top, F.col("path")).alias("against_path"))


def env_lines(spark, folder):
    files = table(spark, folder, "file_entries").filter("lower(trim(language)) = 'dotenv'").dropDuplicates(["file_id"]).select("file_id", F.decode("content", "UTF-8").alias("t"))
    return tx.env_lines(files, "t", "file_id").select("file_id", "key", "value", tx.relevant_key(F.col("key")).alias("relevant"))


def answers_recovered(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.select("doc_id", tx.answer_json(F.col("text")).alias("json")).filter("json is not null")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "file_entries").select(F.concat_ws("/", "repo", "path").alias("path"), "language", "content")
    # Parsed once, whatever is read from it; rows that were delivered again give the same facts.
    return cut_lineage(facts.facts(spread(files)).dropDuplicates(["path", "ord"]))


def source_symbols(spark, folder):
    return facts.symbols(_facts(spark, folder)).drop("ord")


def line_symbols(spark, folder):
    files = table(spark, folder, "file_entries").select("file_id", "language", "content").dropDuplicates(["file_id"])
    return symbols.line_symbols(files)


def manifest_by_language(spark, folder):
    return manifest(table(spark, folder, "file_entries").select("file_id", "language", "size").dropDuplicates(["file_id"]))


def symbol_capabilities(spark, folder):
    return facts.symbol_capabilities(_facts(spark, folder)).select("path", "name", F.array_join("caps", "+").alias("caps"))


def source_call_graph(spark, folder):
    return facts.call_graph(_facts(spark, folder))


def class_bases(spark, folder):
    classes = _facts(spark, folder).filter("fact = 'class'").select(F.col("path").alias("file"), "name", F.col("target").alias("base"))
    return closure.single_bases(classes)


QUERIES = {f.__name__: f for f in (upsert_nodes, upsert_edges_identity, upsert_chains, upsert_groups, keep_stronger, write_counts, combine_signals, vote_aggregate, evidence_present, vote_records, reasoning_merged, evaluate_chains, evaluate_groups, guardrails_for_groups, chain_payloads, retention_counts, task_status, update_attribute, marked_active, hosts_heard, upsert_findings, detected_merge, guardrails_for_chain, hop_edges, verdict_summary, verdict_pivot_by_entry, groups_by_priority, list_actionable, severity_summary, findings_stale, mark_stale_for_nodes, cleanup_stale, shifted_confidence, global_flag, global_int_min, task_counters, latency_statistics, reachability_closure, definition_asof, enclosing_definition, intra_file_pairs, module_suffix_match, literal_match, env_lines, answers_recovered, source_symbols, line_symbols, manifest_by_language, symbol_capabilities, source_call_graph, class_bases)}

_V = "with v as (select * from {t} qualify row_number() over (partition by id, updated_at) = 1)"
_ATTRIBUTES = """, ak as (select id, updated_at, unnest(json_keys(attributes)) k, attributes from v where json_type(attributes) = 'OBJECT'),
  am as (select id, '{' || string_agg('"' || k || '":' || j, ',' order by k) || '}' attributes from (select id, k, max_by(json_extract(attributes, '$."' || k || '"')::varchar, updated_at) j from ak group by id, k) group by id)"""
_PLACED = LATEST + """, k as (select id, kind, json_extract_string(attributes, '$.file') file, try_cast(json_extract_string(attributes, '$.line') as int) line from n where json_extract_string(attributes, '$.file') is not null and try_cast(json_extract_string(attributes, '$.line') as int) is not null)"""
_VOTES = LATEST + """, v as (select id chain_id, unnest(voter_outputs) o from c), w as (select lower(trim(name)) voter, max(weight) weight from voters group by 1),
q as (select chain_id, lower(trim(o.model)) voter, o.exploitable x, o.confidence confidence, o.evidence evidence, coalesce(o.timeout, false) t from v)"""
SQL = {
    "upsert_nodes": _V.replace("{t}", "nodes") + _ATTRIBUTES + """ select id, any_value(coalesce(am.attributes, '{}')) attributes, max_by(host_id, updated_at) host_id, arg_max_null(content_hash, updated_at) content_hash, max_by(kind, updated_at) kind, max_by(name, updated_at) as name, max_by(status, updated_at) status, max(confidence) confidence,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(capabilities, []))))), '+') capabilities, array_to_string(list_sort(list_distinct(flatten(list(coalesce(observed_by, []))))), '+') observed_by, count(*) n_rows from v left join am using (id) group by id""",
    "upsert_edges_identity": _V.replace("{t}", "edges") + _ATTRIBUTES + """, m as (select id, max_by(source_id, updated_at) source_id, max_by(target_id, updated_at) target_id, max_by(host_id, updated_at) host_id, max_by(status, updated_at) status, array_to_string(list_sort(list_distinct(flatten(list(coalesce(capabilities, []))))), '+') capabilities, max_by(kind, updated_at) kind, coalesce(max_by(flow_kind, updated_at) filter (where flow_kind <> 'control'), 'control') flow_kind,
  case when bool_or(edge_precision = 'compiler-verified') then 'compiler-verified' else max_by(edge_precision, updated_at) end edge_precision, max_by(data_flow_confirmed, updated_at) filter (where data_flow_confirmed is not null) data_flow_confirmed,
  list(identity_confidence order by updated_at) filter (where identity_confidence is not null) ics, max(confidence) confidence, array_to_string(list_sort(list_distinct(flatten(list(coalesce(observed_by, []))))), '+') observed_by from v group by id)
select id, kind, flow_kind, edge_precision, data_flow_confirmed, case when kind in ('writes_to', 'reads_from') then round(list_reduce(ics, lambda a, b: least(0.99::double, 1 - (1 - a) * (1 - b))), 9) end identity_confidence, confidence, observed_by, capabilities, source_id, target_id, host_id, status, coalesce(am.attributes, '{}') attributes from m left join am using (id)""",
    "upsert_chains": _V.replace("{t}", "chains") + " select id, verdict, confidence, status from v qualify row_number() over (partition by id order by updated_at desc) = 1",
    "upsert_groups": _V.replace("{t}", "chain_groups") + """, l as (select id, name, case when isnan(score) then null else score end score, priority, status from v qualify row_number() over (partition by id order by updated_at desc) = 1),
  j as (select id, verdict, validated from v qualify row_number() over (partition by id order by verdict is null, case when verdict is not null then updated_at end desc, updated_at) = 1)
  select l.*, j.verdict, j.validated from l join j using (id)""",
    "keep_stronger": "select id, max(identity_confidence) identity_confidence from edges where identity_confidence is not null group by id",
    "write_counts": """with o as (select distinct id from nodes where updated_at < '2025-07-01'), i as (select id, count(*) n from nodes where updated_at >= '2025-07-01' group by id)
select count(*) filter (where id not in (select id from o)) added, (sum(n) - count(*) filter (where id not in (select id from o)))::bigint updated from i""",
    "combine_signals": LATEST + """, s as (select target_id, list(identity_confidence order by identity_confidence) s from e where kind = 'writes_to' and identity_confidence is not null group by 1)
select target_id, round(least(0.99::double, 1 - list_reduce(list_prepend(0.7::double, s), lambda a, b: a * (1 - b))), 9) combined from s""",
    "vote_aggregate": _VOTES + """, z as (select chain_id, sum(case when not t and x is not null then coalesce(weight, 1) end) a, sum(case when not t and x is not null then coalesce(weight, 1) * confidence end) s,
  coalesce(sum(case when not t and x then coalesce(weight, 1) end), 0) y, coalesce(sum(case when not t and not x then coalesce(weight, 1) end), 0) f, count(*) filter (where not t and x is not null) n from q left join w using (voter) group by 1)
select chain_id, case when n = 0 or abs(y - f) < 1e-9 then 'uncertain' when y > f then 'exploitable' else 'not_exploitable' end verdict, round(coalesce(s / nullif(a, 0), 0) + 1e-9, 6) confidence, n n_valid from z""",
    "evidence_present": _VOTES + """ select chain_id, max(coalesce(list_has_any(coalesce(evidence, []), coalesce(c.chain_edges, [])), false)::int) = 1 cited,
  sum(len(list_distinct(list_filter(coalesce(evidence, []), lambda g: not coalesce(list_contains(c.chain_edges, g), false)))))::bigint as unknown from q join c on c.id = chain_id group by chain_id""",
    "vote_records": LATEST + """, v as (select id chain_id, unnest(voter_outputs) o, unnest(range(len(voter_outputs))) pos, coalesce(chain_edges, []) own from c),
u as (select chain_id, pos, list_filter(coalesce(o.evidence, []), lambda g: not coalesce(list_contains(own, g), false)) u from v)
select chain_id, pos, len(u) = 0 evidence_valid, array_to_string(u, '+') evidence_unknown from u""",
    "reasoning_merged": LATEST + """, v as (select id chain_id, unnest(voter_outputs) o, unnest(range(len(voter_outputs))) pos from c)
select chain_id, md5(string_agg('[' || lower(trim(o.model)) || '] ' || case when coalesce(o.timeout, false) then 'timeout' else coalesce(o.reasoning, '') end, chr(10) || chr(10) order by pos)) reasoning_md5 from v group by 1""",
    "retention_counts": LATEST + """, x as (select 'nodes' as "table", not coalesce(status = 'stale' and updated_at < timestamp '2025-12-31' - interval 60 day, false) kept from n
union all select 'chains', not coalesce(status = 'stale' and updated_at < timestamp '2025-12-31' - interval 30 day, false) from c) select "table", kept, count(*) n from x group by all""",
    "task_status": """with s as (select (user_id % 97)::varchar host_id, event_id, event_type, event_id % 2 = 0 st from events), h as (select distinct host_id from s),
r as (select host_id, event_id, sum(case when event_type in ('signup', 'view') then 1 else -1 end) over (partition by host_id order by event_id) run from s where st and event_type <> 'purchase'),
l as (select *, least(0, min(run) over (partition by host_id order by event_id)) low from r), d as (select host_id, max_by(run - low, event_id) = 0 done from l group by 1),
a as (select distinct host_id from s where not st and event_type in ('click', 'error', 'purchase'))
select h.host_id, coalesce(d.done, false) scan_done, a.host_id is not null dynamic_alive from h left join d using (host_id) left join a using (host_id)""",
    "update_attribute": LATEST + """, t as (select id, case when json_type(attributes) = 'OBJECT' then attributes else '{}' end a from n where kind = 'tool'),
k as (select id, unnest(json_keys(a)) k, a from t), p as (select id, k, json_extract(a, '$."' || k || '"')::varchar j from k where k <> 'level' union all select id, 'level', length(id)::varchar from t)
select id, '{' || string_agg('"' || k || '":' || j, ',' order by k) || '}' attributes from p group by id""",
    "marked_active": LATEST + " select id, 1.0::double confidence, 'active' status from n where status = 'stale'",
    "hosts_heard": "select user_id::varchar id, 'standalone' platform, 'unreachable' status, epoch_us(max(ts) filter (where event_type = 'view')) heard from events group by 1",
    "upsert_findings": """with x as (select (event_id % 500)::varchar id, user_id::varchar node_id, event_type scanner, props, value, event_id from events)
select id, max_by(node_id, event_id) node_id, max_by(scanner, event_id) scanner, '{"k":' || max_by(json_extract(props, '$.k')::varchar, event_id) || '}' evidence, max(value) confidence from x group by 1""",
    "detected_merge": LATEST + """, p as (select id, name, kind, json_extract_string(attributes, '$.file') file from n where json_extract_string(attributes, '$.file') is not null),
m as (select o.id old, min('found:' || t.id) new from p o join p t on t.kind = 'tool' and t.name = o.name and t.file = o.file where o.kind <> 'sink' group by 1),
x as (select coalesce(a.new, source_id) s, e.kind, coalesce(b.new, target_id) t, a.new is not null or b.new is not null mv, e.id, e.host_id from e left join m a on a.old = source_id left join m b on b.old = target_id),
y as (select distinct s, kind, t, case when mv then sha256(s || ':' || t || ':' || kind || ':' || host_id) else id end id from x where s <> t)
select split_part(s, ':', 1) source, kind, split_part(t, ':', 1) target, count(*) n from y group by all
union all select 'found', 'node', '', count(*) from p where kind = 'tool' union all select split_part(id, ':', 1), 'node', '', count(*) from p where kind <> 'sink' and id not in (select old from m) group by 1""",
    "guardrails_for_groups": LATEST + """, gr as (select * from chain_groups qualify row_number() over (partition by id order by updated_at desc) = 1),
si as (select id, untrusted_source_id an, 'write' side, unnest(write_chain_ids) ch from gr union all select id, untrusted_source_id, 'read', unnest(read_chain_ids) from gr),
kn as (select lower(trim(id)) ch, chain_nodes from c), ce as (select si.id, side, unnest(chain_nodes) node, an from si join kn on kn.ch = lower(trim(si.ch))),
al as (select distinct id, side, node from ce where node is distinct from an union select id, 'anchor', untrusted_source_id from gr),
tt as (select al.id, al.side, s.id node from al join n on n.id = al.node and n.kind = 'tool' join n s on s.kind = 'mcp_server' and s.name = json_extract_string(n.attributes, '$.parent_server'))
select distinct a.id group_id, a.side, e.source_id guardrail_id from (select * from al union all select * from tt) a join e on e.target_id = a.node and e.status = 'active' and e.kind = 'guards' join n g on g.id = e.source_id and g.status = 'active' and g.kind = 'guardrail'""",
    "guardrails_for_chain": LATEST + """, k as (select distinct id chain_id, unnest(chain_nodes) node from c),
t as (select k.chain_id, s.id node from k join n on n.id = k.node and n.kind = 'tool' join n s on s.kind = 'mcp_server' and s.name = json_extract_string(n.attributes, '$.parent_server'))
select distinct a.chain_id, e.source_id guardrail_id from (select * from k union all select * from t) a join e on e.target_id = a.node and e.status = 'active' and e.kind = 'guards' join n g on g.id = e.source_id and g.status = 'active' and g.kind = 'guardrail'""",
    "hop_edges": LATEST + """, h as (select id chain_id, unnest(range(len(chain_nodes) - 1)) pos, chain_nodes from c where len(chain_nodes) > 1),
b as (select source_id a, target_id b, first(id order by flow_kind not in ('control', 'data'), id) id from e where status = 'active' and (flow_kind in ('control', 'data') or kind = 'writes_to') group by 1, 2)
select chain_id, pos::int pos, b.id edge_id from h left join b on b.a = chain_nodes[pos + 1] and b.b = chain_nodes[pos + 2]""",
    "verdict_summary": LATEST + """, x as (select lower(trim(verdict)) verdict, count(*) n from c where status = 'active' and validated group by 1), f as (select v.verdict, coalesce(x.n, 0) n from (values ('exploitable'), ('not_exploitable'), ('uncertain')) v(verdict) left join x using (verdict))
select * from f union all select 'total', sum(n)::bigint from f""",
    "verdict_pivot_by_entry": LATEST + " select chain_nodes[1] entry, " + ", ".join(f"count(*) filter (where lower(trim(verdict)) = '{v}') {v}" for v in rows.VERDICTS) + " from c group by 1",
    "groups_by_priority": """with g as (select * from chain_groups qualify row_number() over (partition by id order by updated_at desc) = 1)
select coalesce(lower(trim(priority)), 'none') priority, count(*) n, count(*) filter (where validated) validated from g group by 1""",
    "list_actionable": LATEST + " select id, confidence from c where status = 'active' and validated and lower(trim(verdict)) = 'exploitable' and confidence >= 0.5",
    "severity_summary": """with x as (select case event_id % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end severity from events where event_type <> 'error'), f as (select severity, count(*) n from x group by 1)
select * from f union all select 'total', sum(n)::bigint from f""",
    "findings_stale": "select event_id id, 'stale' status from events where event_type <> 'error' and user_id = 7",
    "mark_stale_for_nodes": LATEST + " select distinct id from (select id, unnest(chain_nodes) node from c where status = 'active') where node in (select id from n where status = 'stale')",
    "cleanup_stale": LATEST + " select kind, status, count(*) n from n where not coalesce(status = 'stale' and updated_at < timestamp '2025-12-31' - interval 90 day, false) group by 1, 2",
    "shifted_confidence": LATEST + " select id, round(greatest(0::double, least(1::double, confidence - 0.25)), 9) confidence from n",
    "global_flag": "with h as (select user_id, bool_or(event_type = 'view') v from events group by 1) select count(*) > 0 and bool_and(v) flag from h",
    "global_int_min": "with s as (select user_id, max_by(floor(value)::int, event_id) v from events where event_type = 'purchase' group by 1) select min(v) least from s",
    "task_counters": """with s as (select user_id::varchar host_id, event_id, event_type, sum(case when event_type in ('signup', 'view') then 1 else -1 end) over w run from events window w as (partition by user_id order by event_id)),
l as (select *, least(0, min(run) over (partition by host_id order by event_id)) low from s)
select host_id, 'static' kind, max_by(run - low, event_id)::bigint active, count(*) filter (where event_type = 'click') done, count(*) filter (where event_type = 'error') failed, count(*) filter (where event_type = 'purchase') timed_out from l group by 1""",
    "latency_statistics": _VOTES + """, y as (select *, row_number() over (partition by voter order by confidence) - 1 i, count(*) over (partition by voter) n from q where confidence is not null)
select voter model, max(n) n, round(median(confidence), 6) median, max(case when i = least(floor(n * 0.95), n - 1) then confidence end) p95, round(avg((not t)::int), 6) valid_rate, round(avg(x::int), 6) agreement from y group by 1""",
    "reachability_closure": LATEST.replace("with recursive", "with recursive") + """, r as (select id start, id as name from n where kind = 'entry_point' union select r.start, e.target_id from r join e on e.source_id = r.name and e.status = 'active' and e.kind in ('delegates_to', 'uses_tool')) select * from r""",
    "definition_asof": _PLACED + """ select s.file, s.line, (select max_by(t.id, (t.line, t.id)) from k t where t.kind = 'tool' and t.file = s.file and t.line <= s.line) as name from (select distinct file, line from k where kind = 'sink') s""",
    "enclosing_definition": _PLACED + """ select s.file, s.line, (select max_by(t.id, (t.line, t.id)) from k t where t.kind = 'tool' and t.file = s.file and t.line <= s.line and s.line <= t.line + 40) as name from (select distinct file, line from k where kind = 'sink') s""",
    "intra_file_pairs": _PLACED + ", x as (select file, count(*) filter (where kind = 'tool') n_left, count(*) filter (where kind = 'sink') n_right from k group by 1) select *, n_left * n_right n_pairs from x where n_left > 0 and n_right > 0",
    "module_suffix_match": r"""with f as (select distinct path file, regexp_replace(replace(regexp_replace(path, '\.py$', ''), '/', '.'), '\.__init__$', '') d from file_entries where path like '%.py'),
m as (select distinct replace(regexp_extract(file, '([^/]+/[^/]+)\.py$', 1), '/', '.') m0, regexp_replace(replace(regexp_extract(file, '([^/]+/[^/]+)\.py$', 1), '/', '.'), '\.__init__$', '') m1 from f where regexp_matches(file, '([^/]+/[^/]+)\.py$'))
select distinct m0 module, f.file from m, f where ends_with('.' || d, '.' || m1) or ends_with('.' || m1, '.' || d)""",
    "literal_match": """with f as (select distinct file_id, split_part(path, '/', 1) a, path p, language l from file_entries)
select file_id, case when l is null then 0.2 when a = l then 0.6 when starts_with(a, l) or starts_with(l, a) then 0.3 end against_language, case when a = p then 0.6 when starts_with(p, a) or starts_with(a, p) then 0.3 end against_path from f""",
    "env_lines": r"""with f as (select distinct file_id, decode(content) t from file_entries where lower(trim(language)) = 'dotenv'), l as (select file_id, unnest(string_split_regex(t, '\r?\n')) t from f),
k as (select file_id, regexp_extract(t, '^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$', 1) as key, regexp_extract(t, '^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$', 2) v from l where not regexp_matches(t, '^\s*#') and regexp_matches(t, '^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$'))
select file_id, key, v as value, regexp_matches(upper(key), '(_MODEL|_MODEL_NAME|_BASE_URL|_API_BASE|_ENDPOINT|^LLM_PROVIDER|_LLM_PROVIDER|^LLM_DEFAULT_PROVIDER|_LLM_DEFAULT_PROVIDER|^OLLAMA_HOST|_OLLAMA_HOST)$') relevant from k""",
}
SQL["evaluate_chains"] = f"""with vc as ({GRAPH_SQL["validate_chains"]}), va as ({SQL["vote_aggregate"]}), ev as ({SQL["evidence_present"]})
select vc.id, coalesce(va.verdict, 'uncertain') verdict, coalesce(va.confidence, round(1e-9, 6)) confidence, vc.ok and coalesce(ev.cited, false) validated, case when not vc.ok then vc.validated_kind when coalesce(ev.cited, false) then 'evidence' else 'semantic' end validated_kind,
  case when not vc.ok then vc.n_notes when coalesce(ev.cited, false) then 0 else 1 end::bigint n_notes from vc left join va on va.chain_id = vc.id left join ev on ev.chain_id = vc.id"""
SQL["evaluate_groups"] = (
    LATEST
    + """, gr as (select * from chain_groups qualify row_number() over (partition by id order by updated_at desc) = 1),
si as (select id, 'write' side, unnest(write_chain_ids) ch from gr union all select id, 'read', unnest(read_chain_ids) from gr), sc as (select id, side, lower(trim(ch)) ch from si where trim(ch) <> ''),
kn as (select lower(trim(id)) ch, chain_nodes from c), hp as (select ch, unnest(range(len(chain_nodes) - 1)) pos, chain_nodes from kn where len(chain_nodes) > 1),
be as (select source_id a, target_id b, first(id order by flow_kind not in ('control', 'data'), id) id from e where status = 'active' and (flow_kind in ('control', 'data') or kind = 'writes_to') group by 1, 2),
he as (select ch, count(*) filter (where be.id is null) miss, list(distinct be.id) filter (where be.id is not null) es from hp left join be on be.a = chain_nodes[pos + 1] and be.b = chain_nodes[pos + 2] group by 1),
wh as (select sc.id, count(*) filter (where kn.chain_nodes is null or coalesce(miss, 0) > 0) holes, list_distinct(flatten(list(coalesce(es, [])))) es from sc left join kn using (ch) left join he using (ch) group by 1),
vo as (select id, unnest(voter_outputs) o from gr), q as (select id, lower(trim(o.model)) voter, o.exploitable x, o.confidence confidence, o.evidence evidence, coalesce(o.timeout, false) t from vo),
ou as (select q.id, sum(len(list_filter(coalesce(evidence, []), lambda g: not coalesce(list_contains(wh.es, g), false))))::bigint outside from q join wh on wh.id = q.id group by 1),
w as (select lower(trim(name)) voter, max(weight) weight from voters group by 1),
z as (select id, sum(case when not t and x is not null then coalesce(weight, 1) end) a, sum(case when not t and x is not null then coalesce(weight, 1) * confidence end) s,
  coalesce(sum(case when not t and x then coalesce(weight, 1) end), 0) y, coalesce(sum(case when not t and not x then coalesce(weight, 1) end), 0) f, count(*) filter (where not t and x is not null) n from q left join w using (voter) group by 1),
fl as (select id from n where coalesce(try_cast(json_extract_string(attributes, '$.lethal_trifecta') as boolean), coalesce(list_contains(capabilities, 'reads_untrusted') and list_has_any(capabilities, ['reads_secrets', 'reads_env']) and list_has_any(capabilities, ['http_egress', 'writes_filesystem', 'executes_shell', 'executes_code']), false))),
tr as (select distinct sc.id from sc join kn using (ch), unnest(kn.chain_nodes) u(node) where side = 'read' and node in (select id from fl))
select gr.id group_id, case when coalesce(z.n, 0) = 0 or abs(y - f) < 1e-9 then 'uncertain' when y > f then 'exploitable' else 'not_exploitable' end verdict, round(coalesce(s / nullif(a, 0), 0) + 1e-9, 6) confidence,
  coalesce(holes, 0) = 0 and coalesce(outside, 0) = 0 validated, case when coalesce(holes, 0) = 0 and coalesce(outside, 0) = 0 then 'semantic' else 'existence' end validated_kind, coalesce(holes, 0) holes, coalesce(outside, 0) outside, tr.id is not null lethal_trifecta
from gr left join wh on wh.id = gr.id left join ou on ou.id = gr.id left join z on z.id = gr.id left join tr on tr.id = gr.id"""
)
SQL["chain_payloads"] = (
    LATEST
    + """, xn as (select id, unnest(chain_nodes) ref, unnest(range(len(chain_nodes))) pos from c), xe as (select id, unnest(chain_edges) ref, unnest(range(len(chain_edges))) pos from c),
pn as (select xn.id, string_agg(concat_ws('=', ref, coalesce(n.kind, 'unknown')), '>' order by pos) nodes from xn left join n on n.id = ref group by 1), pe as (select xe.id, string_agg(concat_ws('=', ref, coalesce(e.kind, 'unknown')), '>' order by pos) edges from xe left join e on e.id = ref group by 1),
gg as (select chain_id id, string_agg(guardrail_id, '>' order by guardrail_id) guardrails from ("""
    + SQL["guardrails_for_chain"]
    + """) group by 1) select c.id, nodes, edges, coalesce(guardrails, '') guardrails from c left join pn on pn.id = c.id left join pe on pe.id = c.id left join gg on gg.id = c.id"""
)
SQL["line_symbols"] = "with f as (select distinct file_id, lower(trim(language)) lang, try(decode(content)) t from file_entries), l as (select file_id, lang, unnest(x) l, unnest(range(1, len(x) + 1)) line from (select file_id, lang, string_split_regex(t, '\\r?\\n') x from f where t is not null)) " + " union all ".join(
    f"select file_id, line::int line, '{kind}' kind, regexp_extract(l, '{pattern}', 1) as name from l where lang = '{language}' and regexp_extract(l, '{pattern}', 1) <> ''" for language, patterns in symbols.PATTERNS.items() for kind, pattern in patterns
)
SQL["manifest_by_language"] = "select coalesce(lower(trim(language)), '') as language, count(*) n, sum(size)::bigint bytes from (select distinct file_id, language, size from file_entries) group by 1"
SQL["answers_recovered"] = r"""with b as (select doc_id, trim(regexp_replace(regexp_replace(trim(text), '^```[a-zA-Z]*\s*', ''), '\s*```$', '')) bare, nullif(regexp_extract(text, '(?s)\{.*\}'), '') braces from documents where text is not null),
j as (select doc_id, case when starts_with(bare, '{') and json_valid('[' || bare || ']') then bare when json_valid('[' || braces || ']') then braces end json from b) select * from j where json is not null"""
