"""Queries and SQL of the orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import Citing, orphan_references, orphan_report
from ..tables import table


def _found(spark: SparkSession, folder: str) -> DataFrame:
    citing = [
        Citing("chains", table(spark, folder, "chains"), {"chain_nodes": "nodes", "chain_edges": "edges"}),
        Citing("chain_groups", table(spark, folder, "chain_groups"), {"write_chain_ids": "chains", "read_chain_ids": "chains"}),
    ]
    targets = {name: table(spark, folder, name).select("id", "status", "created_at", "updated_at") for name in ("nodes", "edges", "chains")}
    return orphan_references(citing, targets)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("ref_table", "record_id", "ref_field", "ref_key")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_found(spark, folder))


_ORPHANS = r"""
with refs as (
  select distinct 'chains' ref_table, id record_id, 'chain_nodes' ref_field, 'nodes' target, lower(trim(unnest(chain_nodes))) k, created_at as cat from chains
  union select 'chains', id, 'chain_edges', 'edges', lower(trim(unnest(chain_edges))), created_at from chains
  union select 'chain_groups', id, 'write_chain_ids', 'chains', lower(trim(unnest(write_chain_ids))), created_at from chain_groups
  union select 'chain_groups', id, 'read_chain_ids', 'chains', lower(trim(unnest(read_chain_ids))), created_at from chain_groups),
rows_ as (
  select 'nodes' target, lower(trim(id)) k, created_at c, updated_at u, status s from nodes
  union all select 'edges', lower(trim(id)), created_at, updated_at, status from edges
  union all select 'chains', lower(trim(id)), created_at, updated_at, status from chains),
known as (select target, k, min(c) born, max_by(s, (u, s)) s, max(u) u from rows_ group by all),
orphans as (
  select ref_table, record_id, ref_field, r.k ref_key, min(date_trunc('month', cat)) as m,
    min(case when p.k is null then 'missing' when p.born > r.cat then 'later' when p.s = 'stale' and p.u <= r.cat then 'gone' end) reason
  from refs r left join known p on p.target = r.target and p.k = r.k
  where r.k is not null and r.k <> '' and (p.k is null or p.born > r.cat or (p.s = 'stale' and p.u <= r.cat))
  group by ref_table, record_id, ref_field, r.k)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _ORPHANS + "select ref_table, record_id, ref_field, ref_key from orphans",
    "p1_report": _ORPHANS + "select ref_table, ref_field, cast(m as date) as month, reason, count(*) n_refs, count(distinct record_id) n_records from orphans group by all",
}
