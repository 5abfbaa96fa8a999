"""Queries and SQL of the graph: neighbourhoods, chains, groups, scores and checks, over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import paths, reports, rows, scoring, validation
from ..session import cut_lineage
from ..tables import latest, table
from .projection import projected_graph

_SCORED_NODES = (*g.WALK_NODES, "name", "confidence", "attributes")


def stored_chains(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The latest row of every chain, with ``id`` and the named columns only."""
    return latest(table(spark, folder, "chains"), "id", ["id", *columns])


def _joined(column: str):
    return F.array_join(column, ">")


def nodes_by_kind(spark, folder):
    return reports.by_kind(g.stored_nodes(spark, folder, "kind"))


def edges_by_kind(spark, folder):
    return reports.by_kind(g.stored_edges(spark, folder, "kind"))


def subgraph_control(spark, folder):
    sub = g.subgraph(g.stored_graph(spark, folder, ("kind", "status"), ("source_id", "target_id", "kind", "status")), ["agent", "tool", "llm_endpoint"], list(g.CONTROL_EDGES))
    return sub.edges.select("id", "source_id", "target_id", "kind")


def _near(depth):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = g.stored_graph(spark, folder, ("kind", "status"), ("source_id", "target_id", "status"))
        return g.neighbours(graph, graph.nodes.filter("status = 'active' and kind = 'store'"), depth)

    return query


def sinks_by_capability(spark, folder):
    return g.sinks(g.stored_nodes(spark, folder, "kind", "capabilities", "status"), ())


def _chains(**options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = paths.find_chains(g.stored_graph(spark, folder, g.WALK_NODES, g.WALK_EDGES), **options)
        return found.select("chain_id", _joined("nodes").alias("nodes"), _joined("edges").alias("edges"), "length")

    return query


def chains_by_entry(spark, folder):
    return reports.by_entry(paths.find_chains(g.stored_graph(spark, folder, g.WALK_NODES, g.WALK_EDGES), max_candidates=None))


def projected_chains_by_entry(spark, folder):
    return reports.by_entry(paths.find_chains(projected_graph(spark, folder), max_candidates=None))


def _write_chains(spark, folder):
    graph = g.stored_graph(spark, folder, g.WALK_NODES, g.LINK_EDGES)
    found = paths.write_chains(graph, graph.nodes.filter("status = 'active' and kind = 'store'"))
    return found.select("anchor", "chain_id", _joined("nodes").alias("nodes"), "link")


def _read_chains(spark, folder):
    graph = g.stored_graph(spark, folder, g.WALK_NODES, g.WALK_EDGES)
    found = paths.read_chains(graph, graph.nodes.filter("status = 'active' and kind = 'untrusted_source'"))
    return found.select("anchor", "chain_id", _joined("nodes").alias("nodes"))


def _groups(**options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = paths.chain_groups(g.stored_graph(spark, folder, g.WALK_NODES, g.LINK_EDGES), **options)
        return found.select("group_id", "source_id", "store_id", "write_id", "read_id", "store_confidence", "weak")

    return query


def _scores(spark, folder):
    graph = g.stored_graph(spark, folder, _SCORED_NODES, g.LINK_EDGES)
    groups = paths.chain_groups(graph, max_groups=None, include_weak=True)
    return scoring.score_groups(groups, graph.nodes)


def group_scores(spark, folder):
    return _scores(spark, folder).drop("authenticated_entry", "shared_entry")


def group_priority_topn(spark, folder):
    graph = g.stored_graph(spark, folder, _SCORED_NODES, g.LINK_EDGES)
    return scoring.prioritise(paths.chain_groups(graph, max_groups=None, include_weak=True), graph.nodes)


def validate_edges(spark, folder):
    lists = stored_chains(spark, folder, "chain_edges").select(F.col("id").alias("list"), F.col("chain_edges").alias("ids"))
    found = validation.validate_edges(lists, g.stored_edges(spark, folder, "kind"))
    return found.select(F.col("list").alias("chain_id"), F.size("existing").cast("bigint").alias("n_existing"), _joined("missing").alias("missing"))


def validate_chains(spark, folder):
    found = validation.validate_chains(stored_chains(spark, folder, "chain_nodes", "chain_edges"), g.stored_graph(spark, folder, ("kind", "capabilities", "attributes"), ("source_id", "target_id", "kind")))
    return found.select("id", "ok", "validated_kind", F.size("notes").cast("bigint").alias("n_notes"), F.array_join(F.array_sort("notes"), "\n").alias("notes"))


def anchors_usable(spark, folder):
    """On nodes whose source type, which the stored ones only name, is an attribute."""
    graph = g.stored_graph(spark, folder, ("kind", "name", "capabilities", "attributes"), ("source_id", "target_id", "kind"))
    typed = rows.with_attribute(graph.nodes.filter("kind = 'untrusted_source'"), "source_type", F.split_part("name", F.lit(":"), F.lit(1)))
    nodes = graph.nodes.filter("kind <> 'untrusted_source'").unionByName(typed)
    return validation.usable_anchors(g.Graph(nodes, graph.edges))


def lethal_trifecta(spark, folder):
    """Of the files whose nodes have all three together."""
    nodes = g.stored_nodes(spark, folder, "capabilities", "attributes").withColumn("file", F.get_json_object("attributes", "$.file")).filter("file is not null")
    together = nodes.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("capabilities", F.array().cast("array<string>"))))).alias("capabilities"))
    return together.select("file", F.array_join(scoring.trifecta_hits("capabilities"), "+").alias("hits")).filter("hits <> ''")


def orphan_entries(spark, folder):
    """Entries that no run has seen delegate to anything."""
    graph = g.stored_graph(spark, folder, ("kind", "status"), ("source_id", "kind", "status", "observed_by"))
    out = graph.edges.filter((F.col("status") == "active") & (F.col("kind") == "delegates_to") & F.array_contains("observed_by", "runtime")).select(F.col("source_id").alias("id"))
    return graph.nodes.filter("status = 'active' and kind = 'entry_point'").select("id").join(out, "id", "left_anti")


def chain_faces(spark, folder):
    return validation.chain_faces(stored_chains(spark, folder, "chain_nodes", "chain_edges"), g.stored_graph(spark, folder, ("kind", "capabilities"), ("source_id", "target_id")))


def neighbour_edges(spark, folder):
    graph = g.stored_graph(spark, folder, ("kind", "status"), ("source_id", "target_id", "status"))
    graph = g.Graph(graph.nodes, cut_lineage(graph.edges.filter("status = 'active'")))  # the walk and the edges met read it
    starts = graph.nodes.filter("status = 'active' and kind = 'guardrail'")
    # The last round is left out: its edges hang on the nodes of the round before.
    return g.edges_met(graph, g.neighbours(graph, starts, 1), 2)


def nodes_listed(spark, folder):
    return rows.listed(g.stored_nodes(spark, folder, "kind", "host_id", "status"), ["id"], 200, kind="tool", status="active").select("id")


def nodes_of_chains(spark, folder):
    lists = stored_chains(spark, folder, "chain_nodes").select(F.col("id").alias("list"), F.col("chain_nodes").alias("ids"))
    return g.in_order(lists, g.stored_nodes(spark, folder, "kind")).select("list", F.col("pos").cast("bigint").alias("pos"), "id", "kind")


def projected_store_groups(spark, folder):
    """The store-joined tuples of the projected graph: a write link, a store, a source."""
    graph = projected_graph(spark, folder)
    links = graph.edges.select("source_id", "target_id", "kind", "identity_confidence")
    writes = links.filter("kind = 'writes_to'").select(F.col("source_id").alias("writer"), F.col("target_id").alias("store"), F.col("identity_confidence").alias("w"))
    reads = links.filter("kind = 'reads_from'").select(F.col("source_id").alias("store"), F.col("target_id").alias("source"), F.col("identity_confidence").alias("r"))
    sinks = links.filter("kind = 'has_access_to' and startswith(source_id, 'untrusted_source')").groupBy(F.col("source_id").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    # Tuples are counted and not made: all sinks of a source have the same links.
    sure = paths.join_confidence(F.col("w"), F.col("r"))
    counted = writes.join(reads, "store").join(sinks, "source").select(sure.alias("c"), "n")
    total = [F.coalesce(F.sum(F.when(F.col("c") >= least, F.col("n"))), F.lit(0)).alias(name) for name, least in (("every", 0.0), ("believed", paths.WEAK_FLOOR), ("strong", paths.STRONG))]
    return counted.agg(*total)


def paths_named(spark, folder):
    return reports.paths_named(stored_chains(spark, folder, "chain_nodes"), g.stored_nodes(spark, folder, "kind", "name"), "id", "chain_nodes")


QUERIES = {
    "nodes_by_kind": nodes_by_kind,
    "edges_by_kind": edges_by_kind,
    "subgraph_control": subgraph_control,
    "neighbors_depth1": _near(1),
    "neighbors_depth2": _near(2),
    "sinks_by_capability": sinks_by_capability,
    "find_chains": _chains(max_candidates=None),
    "find_chains_capped": _chains(),
    "find_chains_data_only": _chains(max_candidates=None, data_edges_only=True),
    "chains_by_entry": chains_by_entry,
    "projected_chains_by_entry": projected_chains_by_entry,
    "write_chains_to_store": _write_chains,
    "read_chains_from_source": _read_chains,
    "store_groups_strong": _groups(max_groups=None),
    "store_groups_include_weak": _groups(max_groups=None, include_weak=True),
    "store_groups_capped": _groups(include_weak=True, max_groups=500),
    "group_scores": group_scores,
    "group_priority_topn": group_priority_topn,
    "validate_edges": validate_edges,
    "validate_chains": validate_chains,
    "anchors_usable": anchors_usable,
    "lethal_trifecta": lethal_trifecta,
    "orphan_entries": orphan_entries,
    "paths_named": paths_named,
    "chain_faces": chain_faces,
    "neighbour_edges": neighbour_edges,
    "nodes_listed": nodes_listed,
    "nodes_of_chains": nodes_of_chains,
    "projected_store_groups": projected_store_groups,
}

LATEST = """
with recursive n as (select * from nodes qualify row_number() over (partition by id order by updated_at desc) = 1),
e as (select * from edges qualify row_number() over (partition by id order by updated_at desc) = 1),
c as (select * from chains qualify row_number() over (partition by id order by updated_at desc) = 1)"""
_SINKS = LATEST + """,
s as (select id from n where status = 'active' and (kind = 'sink' or coalesce(list_has_any(capabilities, ['executes_code', 'executes_shell', 'writes_filesystem', 'writes_db', 'http_egress']), false))),
t as (select id, source_id, target_id, coalesce(list_contains(observed_by, 'runtime'), false) rt from e where status = 'active' and flow_kind in ('control', 'data'))"""
_CHAIN_ID = """'chain:' || substr(sha256('{"edges":["' || array_to_string(es, '","') || '"],"nodes":["' || array_to_string(ns, '","') || '"]}'), 1, 16)"""
_FORWARD = _SINKS + """,
p as (
  select id st, id cur, [id] ns, []::varchar[] es, false done, false rt from n where status = 'active' and kind = '{kind}'
  union all
  select p.st, t.target_id, list_append(ns, t.target_id), list_append(es, t.id), t.target_id in (select id from s), p.rt or t.rt
  from p join t on t.source_id = p.cur where not done and len(es) < 6 and not list_contains(ns, t.target_id))"""
_FOUND = _FORWARD.replace("{kind}", "entry_point") + f""",
f as (select st, {_CHAIN_ID} chain_id, ns, es, array_to_string(ns, '>') nodes, array_to_string(es, '>') edges, len(es)::int length, rt from p where done)
"""
_BACK = """,
a as (select id, source_id, target_id, kind, flow_kind, identity_confidence from e where status = 'active' and (flow_kind in ('control', 'data') or kind = 'writes_to')),
b as (
  select id st, id cur, [id] ns, []::varchar[] es, false done, null::double link from n where status = 'active' and kind in ('store', 'untrusted_source')
  union all
  select b.st, a.source_id, list_prepend(a.source_id, ns), list_append(es, a.id), a.source_id in (select id from n where status = 'active' and kind = 'entry_point'),
    case when len(es) = 0 and a.kind = 'writes_to' then a.identity_confidence else b.link end
  from b join a on a.target_id = b.cur
  where not done and len(es) < 6 and not list_contains(ns, a.source_id) and (a.flow_kind in ('control', 'data') or len(es) = 0 and a.kind = 'writes_to')),
w as (select st anchor, 'chain:' || substr(sha256('{"edges":["' || array_to_string(list_reverse(es), '","') || '"],"nodes":["' || array_to_string(ns, '","') || '"]}'), 1, 16) chain_id, ns, es, link
  from b where done qualify row_number() over (partition by st order by es) <= 100)"""
_READS = f""",
r as (select st anchor, {_CHAIN_ID} chain_id, ns, es from p where done qualify row_number() over (partition by st order by es) <= 100)"""
_GROUPS = _FORWARD.replace("{kind}", "untrusted_source") + _READS + _BACK + """,
pairs as (
  select r.anchor source_id, null::varchar store_id, w.chain_id write_id, r.chain_id read_id, null::double store_confidence, false weak, w.ns wn, w.es we, r.ns rn, r.es re from w join r on w.anchor = r.anchor
  union all
  select r.anchor, w.anchor, w.chain_id, r.chain_id, least(w.link, l.identity_confidence), least(w.link, l.identity_confidence) < 0.7, w.ns, w.es, r.ns, r.es
  from e l join n so on so.id = l.source_id and so.kind = 'store' and so.status = 'active' join n us on us.id = l.target_id and us.kind = 'untrusted_source' and us.status = 'active'
  join w on w.anchor = l.source_id join r on r.anchor = l.target_id
  where l.status = 'active' and l.kind = 'reads_from' and w.link is not null and l.identity_confidence is not null
    and least(w.link, l.identity_confidence) >= case when json_extract_string(l.attributes, '$.identity_source') = 'llm' then 0.1 else 0.3 end),
groups as (select 'chain_group:' || substr(sha256('{"read":["' || read_id || '"],"source":"' || source_id || '",' || case when store_id is null then '' else '"store":"' || store_id || '",' end || '"write":["' || write_id || '"]}'), 1, 16) group_id, * from pairs)
"""
_GROUP_COLUMNS = "select group_id, source_id, store_id, write_id, read_id, store_confidence, weak from groups"
_SCORED = _GROUPS + """,
cells as (select group_id, source_id, len(we) + len(re) hops, unnest(wn) id, false rd, false lst from groups
  union all select group_id, source_id, len(we) + len(re), unnest(rn), true, unnest(list_transform(range(1, len(rn) + 1), lambda i: i = len(rn))) from groups),
k as (select id, name, confidence, attributes, coalesce(try_cast(json_extract_string(attributes, '$.lethal_trifecta') as boolean), coalesce(list_contains(capabilities, 'reads_untrusted')
    and list_has_any(capabilities, ['reads_secrets', 'reads_env']) and list_has_any(capabilities, ['http_egress', 'writes_filesystem', 'executes_shell', 'executes_code']), false)) tri,
  coalesce(list_has_any(capabilities, ['executes_shell', 'executes_code']), false) x, coalesce(list_has_any(capabilities, ['writes_filesystem', 'http_egress']), false) y, coalesce(list_contains(capabilities, 'writes_db'), false) z,
  coalesce(nullif(json_extract_string(attributes, '$.source_type'), ''), split_part(name, ':', 1)) typ from n),
m as (select group_id, max(hops) hops, min(case when rd and tri then c.id end) lethal_trifecta_at, min(case when lst and x then c.id end) dangerous_sink_at, min(case when lst and y then c.id end) exfil_or_write_at,
  min(case when rd and z then c.id end) writes_db_at, min(case when confidence < 0.7 then c.id end) stale_node_at, max(case when c.id = source_id then typ end) typ from cells c left join k on k.id = c.id group by group_id),
v as (select *, case when lethal_trifecta_at is not null then 5 else 0 end lethal_trifecta, case when dangerous_sink_at is not null then 4 else 0 end dangerous_sink, case when exfil_or_write_at is not null then 3 else 0 end exfil_or_write,
  case when writes_db_at is not null then 3 else 0 end writes_db, case when typ in ('user_upload', 'rag_corpus') then 2 else 0 end user_writable_source, case when typ = 'mcp_tool_description' then 1 else 0 end user_readable_source,
  case when hops <= 6 then 1 else 0 end short_chain, case when stale_node_at is not null then -2 else 0 end stale_node from m),
u as (select *, (lethal_trifecta + dangerous_sink + exfil_or_write + writes_db + user_writable_source + user_readable_source + short_chain + stale_node)::double score from v)
"""
_NEAR = LATEST + """,
b as (select source_id a, target_id b from e where status = 'active' union select target_id, source_id from e where status = 'active'),
x as (select id st, id, 0 d from n where status = 'active' and kind = 'store' union select x.st, b.b, x.d + 1 from x join b on b.a = x.id where x.d < {depth})
select st as start, id, min(d)::int distance from x group by all"""

SQL = {
    "nodes_by_kind": LATEST + " select kind, count(*) n from n group by kind",
    "edges_by_kind": LATEST + " select kind, count(*) n from e group by kind",
    "subgraph_control": LATEST + """, k as (select id from n where status = 'active' and kind in ('agent', 'tool', 'llm_endpoint'))
select id, source_id, target_id, kind from e where status = 'active' and kind in ('uses_model', 'uses_tool', 'provides_tool', 'delegates_to') and source_id in (select id from k) and target_id in (select id from k)""",
    "neighbors_depth1": _NEAR.replace("{depth}", "1"),
    "neighbors_depth2": _NEAR.replace("{depth}", "2"),
    "sinks_by_capability": LATEST + " select id from n where status = 'active' and list_has_any(capabilities, ['executes_code', 'executes_shell', 'writes_filesystem', 'writes_db', 'http_egress'])",
    "find_chains": _FOUND + "select chain_id, nodes, edges, length from f",
    "find_chains_capped": _FOUND + "select chain_id, nodes, edges, length from f qualify row_number() over (order by st, es) <= 1000",
    "find_chains_data_only": _FOUND + "select chain_id, nodes, edges, length from f where rt",
    "chains_by_entry": _FOUND + "select st entry, count(*) n, min(length) shortest from f group by st",
    "projected_chains_by_entry": """
with recursive ed as (
  select 'entry_point:N' || c_nationkey s, 'agent:C' || c_custkey t, 'edge:NC' || c_custkey id from customer join nation on n_nationkey = c_nationkey and n_regionkey = 0
  union all select 'agent:C' || o_custkey, 'tool:O' || o_orderkey, 'edge:CO' || o_orderkey from orders
  union all select distinct 'tool:O' || l_orderkey, 'sink:P' || l_partkey, 'edge:OP' || l_orderkey || '_' || l_partkey from lineitem),
p as (select 'entry_point:N' || n_nationkey st, 'entry_point:N' || n_nationkey cur, 0 hops from nation where n_regionkey = 0 union all select st, t, hops + 1 from p join ed on s = cur where hops < 6 and cur not like 'sink:%')
select st entry, count(*) n, min(hops)::int shortest from p where cur like 'sink:%' group by st""",
    "write_chains_to_store": _SINKS + _BACK + " select anchor, chain_id, array_to_string(ns, '>') nodes, link from w where anchor in (select id from n where kind = 'store')",
    "read_chains_from_source": _FORWARD.replace("{kind}", "untrusted_source") + _READS + " select anchor, chain_id, array_to_string(ns, '>') nodes from r",
    "store_groups_strong": _GROUPS + _GROUP_COLUMNS + " where not weak",
    "store_groups_include_weak": _GROUPS + _GROUP_COLUMNS,
    "store_groups_capped": _GROUPS + _GROUP_COLUMNS + " qualify row_number() over (order by store_id nulls first, source_id, write_id, read_id) <= 500",
    "group_scores": _SCORED + """select group_id, score, lethal_trifecta, dangerous_sink, exfil_or_write, writes_db, user_writable_source, user_readable_source, short_chain, stale_node,
  lethal_trifecta_at, dangerous_sink_at, exfil_or_write_at, writes_db_at, stale_node_at from u""",
    "group_priority_topn": _SCORED + """, f as (select group_id, row_number() over (order by store_id nulls first, source_id, write_id, read_id) i from groups), so as (select u.group_id, u.score from u join f using (group_id) where i <= 10000),
  bo as (select group_id, case when score >= 15 then 'high' when score >= 10 then 'medium' else 'low' end priority from so where score >= 3 order by score desc, group_id limit 100)
  select group_id, score, priority from f left join so using (group_id) left join bo using (group_id)""",
    "validate_edges": LATEST + """, x as (select id, unnest(chain_edges) ref, unnest(range(1, len(chain_edges) + 1)) pos from c)
select c.id chain_id, (select count(*) from x where x.id = c.id and ref in (select id from e)) n_existing,
  coalesce((select string_agg(ref, '>' order by pos) from x where x.id = c.id and ref is not null and ref not in (select id from e)), '') missing from c""",
    "validate_chains": LATEST + """,
cn as (select id, unnest(coalesce(chain_nodes, [])) ref, unnest(range(1, len(coalesce(chain_nodes, [])) + 1)) pos from c), ce as (select id, unnest(coalesce(chain_edges, [])) ref, unnest(range(1, len(coalesce(chain_edges, [])) + 1)) pos from c),
us as (select distinct n.id from n join e on e.source_id = n.id and e.kind = 'has_access_to' join n r on r.id = e.target_id and list_contains(r.capabilities, 'reads_untrusted')
  where n.kind = 'untrusted_source' and json_extract_string(n.attributes, '$.source_type') in ('rag_corpus', 'mcp_tool_description', 'email_inbox')),
x as (select id, coalesce(chain_nodes, []) n, coalesce(chain_edges, []) e from c),
ex as (select id, 'no nodes' note from x where len(n) = 0 union all select id, 'no edges' from x where len(n) > 0 and len(e) = 0
  union all select id, 'missing node ' || coalesce(ref, '(null)') from cn where ref is null or ref not in (select id from n) union all select id, 'missing edge ' || coalesce(ref, '(null)') from ce where (ref is null or ref not in (select id from e)) and id in (select id from x where len(n) > 0)),
rs as (select id, 'hop count: ' || len(e) || ' edge(s) for ' || len(n) || ' node(s), expected ' || (len(n) - 1) note from x where len(e) <> len(n) - 1
  union all select x.id, 'disconnected: edge ' || ce.ref || ' links ' || e.source_id || ' -> ' || e.target_id || ', expected ' || x.n[ce.pos] || ' -> ' || x.n[ce.pos + 1] from x join ce on ce.id = x.id join e on e.id = ce.ref where ce.pos < len(x.n) and (e.source_id <> x.n[ce.pos] or e.target_id <> x.n[ce.pos + 1])
  union all select x.id, 'first node ' || x.n[1] || ' is not a entry_point' from x left join n f on f.id = x.n[1] where f.kind is distinct from 'entry_point'
  union all select x.id, 'last node ' || x.n[-1] || ' is not a sink' from x left join n l on l.id = x.n[-1] where not coalesce(l.kind = 'sink' or list_has_any(l.capabilities, ['executes_code', 'executes_shell', 'writes_filesystem', 'writes_db', 'http_egress']), false)
  union all select cn.id, 'untrusted anchor ' || cn.ref || ' is not a usable source' from cn join n on n.id = cn.ref where n.kind = 'untrusted_source' and n.id not in (select id from us)),
al as (select * from ex union all select * from rs where id not in (select id from ex)), nt as (select id, list_sort(list_distinct(list(note))) notes from al group by id)
select x.id, nt.id is null ok, case when nt.id is null then 'semantic' else 'existence' end validated_kind, coalesce(len(notes), 0)::bigint n_notes, coalesce(array_to_string(notes, chr(10)), '') notes from x left join nt on nt.id = x.id""",
    "anchors_usable": LATEST + """ select distinct n.id from n join e on e.source_id = n.id and e.kind = 'has_access_to' join n r on r.id = e.target_id and r.kind <> 'untrusted_source' and list_contains(r.capabilities, 'reads_untrusted')
  where n.kind = 'untrusted_source' and split_part(n.name, ':', 1) in ('rag_corpus', 'mcp_tool_description', 'email_inbox')""",
    "lethal_trifecta": LATEST + """, f as (select json_extract_string(attributes, '$.file') file, list_distinct(flatten(list(coalesce(capabilities, [])))) c from n where json_extract_string(attributes, '$.file') is not null group by 1)
select file, array_to_string(list_sort(list_distinct(list_concat(['reads_untrusted'], list_intersect(c, ['reads_secrets', 'reads_env', 'http_egress', 'writes_filesystem', 'executes_shell', 'executes_code'])))), '+') hits from f
  where list_contains(c, 'reads_untrusted') and list_has_any(c, ['reads_secrets', 'reads_env']) and list_has_any(c, ['http_egress', 'writes_filesystem', 'executes_shell', 'executes_code'])""",
    "orphan_entries": LATEST + " select id from n where status = 'active' and kind = 'entry_point' and id not in (select source_id from e where status = 'active' and kind = 'delegates_to' and list_contains(observed_by, 'runtime'))",
    "chain_faces": LATEST + """, x as (select id, coalesce(chain_nodes, []) n, coalesce(chain_edges, []) e from c),
xn as (select id, unnest(n) ref, unnest(range(1, len(n) + 1)) pos, len(n) last from x), xe as (select id, unnest(e) ref, unnest(range(1, len(e) + 1)) pos, n from x),
an as (select xn.id, bool_and(n.kind is not null) there, bool_or(pos = 1 and n.kind = 'entry_point') bs, bool_or(pos = last and (n.kind = 'sink' or coalesce(list_has_any(n.capabilities, ['executes_code', 'executes_shell', 'writes_filesystem', 'writes_db', 'http_egress']), false))) es from xn left join n on n.id = xn.ref group by 1),
ae as (select xe.id, bool_and(e.source_id is not null) there, bool_and(coalesce(e.source_id = xe.n[pos] and e.target_id = xe.n[pos + 1], false)) lead from xe left join e on e.id = xe.ref group by 1)
select x.id, len(x.n) > 0 and len(x.e) > 0 and coalesce(an.there, false) and coalesce(ae.there, false) as "exists", len(x.n) > 0 and len(x.e) > 0 and len(x.e) = len(x.n) - 1 and coalesce(lead, false) connected, coalesce(bs, false) and coalesce(es, false) typed from x left join an using (id) left join ae using (id)""",
    "neighbour_edges": LATEST + """, a as (select id, source_id, target_id from e where status = 'active'), b as (select source_id a, target_id b from a union select target_id, source_id from a),
x as (select id st, id, 0 d from n where status = 'active' and kind = 'guardrail' union select x.st, b.b, x.d + 1 from x join b on b.a = x.id where x.d < 1)
select distinct st as start, a.id edge_id from x join a on a.source_id = x.id or a.target_id = x.id""",
    "nodes_listed": LATEST + " select id from n where kind = 'tool' and status = 'active' order by id limit 200",
    "nodes_of_chains": LATEST + ", x as (select id list, unnest(chain_nodes) ref, unnest(range(len(chain_nodes))) pos from c) select list, pos::bigint pos, n.id, n.kind from x join n on n.id = x.ref",
    "projected_store_groups": """
with w as (select 'store:S' || l_suppkey store, cast(1 + max(l_linenumber) % 5 + l_suppkey % 3 as double) / 8 c from lineitem where l_discount >= 0.09 and l_quantity >= 40 group by l_orderkey, l_suppkey),
r as (select 'store:S' || s_suppkey store, s_nationkey source, cast(1 + s_suppkey % 7 as double) / 8 c from supplier),
k as (select n_nationkey source, count(*) n from nation join part on p_partkey % 25 = n_nationkey and p_size <= 4 group by 1),
t as (select least(w.c, r.c) c, n from w join r using (store) join k using (source))
select coalesce(sum(n), 0)::bigint as "every", coalesce(sum(n) filter (where c >= 0.3), 0)::bigint believed, coalesce(sum(n) filter (where c >= 0.7), 0)::bigint strong from t""",
    "paths_named": LATEST + """ select x.id, string_agg(case when n.id is null then x.ref else concat_ws(':', n.kind, n.name) end, ' -> ' order by pos) path
  from (select id, unnest(chain_nodes) ref, unnest(range(1, len(chain_nodes) + 1)) pos from c) x left join n on n.id = x.ref group by x.id""",
}
