"""Listing, counting, summaries and upkeep of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import object_json, object_of

# The closed vocabularies that summaries fill with zeros, and the limit of an actionable chain.
SEVERITIES = ("critical", "high", "medium", "low")
VERDICTS = ("exploitable", "not_exploitable", "uncertain")
ACTIONABLE = 0.5


def listed(rows: DataFrame, order: list[Column | str] | None = None, limit: int | None = None, **equal) -> DataFrame:
    """Rows with the given column values (None: any), in order, at most ``limit``."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if order:
        rows = rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows


def counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, n)."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) with a row for each of ``values``, zero where there is none, and their total."""
    value = F.lower(F.trim(column))
    known = rows.select(F.when(value.isin(*values), value).alias(column)).filter(F.col(column).isNotNull())
    tallied = known.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    pairs = [F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values] + [F.struct(F.lit("total").alias(column), reduce(Column.__add__, [F.col(v) for v in values]).alias("n"))]
    return tallied.select(F.inline(F.array(*pairs)))


def severity_summary(findings: DataFrame) -> DataFrame:
    return summary(findings.filter("status = 'active'"), "severity", SEVERITIES)


def verdict_summary(chains: DataFrame) -> DataFrame:
    return summary(chains.filter("status = 'active' and validated"), "verdict", VERDICTS)


def actionable(chains: DataFrame, threshold: float = ACTIONABLE) -> DataFrame:
    """Active, validated, exploitable chains of at least the confidence, surest first, then newest, then by id."""
    found = chains.filter((F.col("status") == "active") & F.col("validated") & (F.lower(F.trim("verdict")) == "exploitable") & (F.col("confidence") >= threshold))
    return found.orderBy(F.col("confidence").desc(), F.col("created_at").desc(), "id")


def stale_for_node(chains: DataFrame, node: str) -> DataFrame:
    """``chains`` with those stale that were active and contain the node, and ``changed`` telling which."""
    hit = (F.col("status") == "active") & F.coalesce(F.array_contains("chain_nodes", node), F.lit(False))
    return chains.withColumn("changed", hit).withColumn("status", F.when(hit, "stale").otherwise(F.col("status")))


def stale_for_nodes(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of the active chains that contain one of many nodes (column ``id``)."""
    cells = chains.filter("status = 'active'").select("id", F.explode("chain_nodes").alias("node"))
    return cells.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("id").distinct()


def findings_stale_for(findings: DataFrame, column: str, target: str) -> DataFrame:
    """``findings`` with the active ones on the node or edge (``column``) stale, and ``changed`` telling which."""
    hit = (F.col("status") == "active") & F.coalesce(F.col(column) == target, F.lit(False))
    return findings.withColumn("changed", hit).withColumn("status", F.when(hit, "stale").otherwise(F.col("status")))


def shifted(confidence: Column, delta: Column | float) -> Column:
    """A confidence moved by ``delta``, kept between 0 and 1; null stays null."""
    moved = confidence + delta
    return F.when(moved.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))


def marked_active(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.lit("active")).withColumn("confidence", F.lit(1.0))


def marked_stale(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.lit("stale"))


def with_attribute(rows: DataFrame, key: str, value: Column | str) -> DataFrame:
    """``rows`` whose JSON attributes have the key set to the value, which keeps its type; what is no object becomes one."""
    value = value if isinstance(value, Column) else F.lit(value)
    as_json = F.coalesce(F.regexp_replace(F.nullif(F.to_json(F.struct(value.alias("v"))), F.lit("{}")), r'(?s)^\{"v":(.*)\}$', "$1"), F.lit("null"))
    old = F.map_filter(object_of(F.col("attributes")), lambda k, v: k != key)
    return rows.withColumn("attributes", object_json(F.map_concat(old, F.create_map(F.lit(key), F.parse_json(as_json)))))


def update_attribute(nodes: DataFrame, id: str, key: str, value: Column | str) -> DataFrame:
    """``nodes`` with one attribute of one node set; an unknown node raises KeyError."""
    if nodes.filter(F.col("id") == id).isEmpty():
        raise KeyError(id)
    return nodes.filter(F.col("id") != id).unionByName(with_attribute(nodes.filter(F.col("id") == id), key, value))


def retained(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """``rows`` without those stale for longer than ``days``; a null time is kept."""
    old = (F.col("status") == "stale") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days)))
    return rows.filter(~F.coalesce(old, F.lit(False)))


#: The keys of the thresholds, in days, after which stale rows of a table are deleted.
RETENTION = {"nodes": "cleanup_stale_days", "findings": "cleanup_findings_days", "chains": "cleanup_chains_days"}
# The keys of the state of a host, and those whose values are true or false.
STATE_KEYS = ("phase1_done", "scan_done", "report_fresh", "last_report_at", "dynamic_enabled", *RETENTION.values(), "cleanup_reports_days")
FLAG_KEYS = ("phase1_done", "scan_done", "report_fresh", "dynamic_enabled")


def retention(tables: dict[str, DataFrame], state: DataFrame, host: str, now: Column) -> dict[str, DataFrame]:
    """The tables (of ``RETENTION``) without the rows stale for longer than the host's state allows each; each with the column
    ``kept``, so deleted rows can be counted. A missing or wrong threshold raises ValueError."""
    out = {}
    days = {r.key: r.value for r in state.filter((F.col("host_id") == host) & F.col("key").isin(*RETENTION.values())).select("key", "value").collect()}
    for name, rows in tables.items():
        limit = days.get(RETENTION[name])
        if limit is None or not str(limit).lstrip("-").isdigit():
            raise ValueError(f"{RETENTION[name]} is {limit!r} for {host}")
        old = (F.col("status") == "stale") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(int(limit))))
        out[name] = rows.withColumn("kept", ~F.coalesce(old, F.lit(False)))
    return out


def set_state(state: DataFrame, host: str, key: str, value: str | bool | None) -> DataFrame:
    """``state`` (host_id, key, value) with one value set; unknown keys, and values of the wrong type, raise ValueError."""
    if key not in STATE_KEYS:
        raise ValueError(f"unknown state key {key!r}")
    if value is not None and isinstance(value, bool) != (key in FLAG_KEYS):
        raise ValueError(f"{key!r} takes {'true or false' if key in FLAG_KEYS else 'text'}")
    text = ("true" if value else "false") if isinstance(value, bool) else value
    mine = (F.col("host_id") == host) & (F.col("key") == key)
    row = state.sparkSession.createDataFrame([(host, key, text)], "host_id string, key string, value string")
    return state.select("host_id", "key", "value").filter(~mine).unionByName(row)


def typed_state(state: DataFrame) -> DataFrame:
    """(host_id, key, value, flag, number): values read as what their keys hold; wrong numbers are null."""
    return state.select("host_id", "key", "value", F.when(F.col("key").isin(*FLAG_KEYS), F.coalesce(F.col("value") == "true", F.lit(False))).alias("flag"), F.when(~F.col("key").isin(*FLAG_KEYS), F.col("value").try_cast("int")).alias("number"))


def register_host(hosts: DataFrame, host: str, platform: str, at: Column) -> DataFrame:
    """``hosts`` (id, platform, status, last_heartbeat) with the host active on the platform; it keeps its heartbeat."""
    if platform not in ("swarm", "k8s", "standalone"):
        raise ValueError(f"unknown platform {platform!r}")
    row = hosts.sparkSession.range(1).select(F.lit(host).alias("id"), F.lit(platform).alias("platform"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("last_heartbeat"))
    both = hosts.select("id", "platform", "status", "last_heartbeat", F.lit(0).alias("seq")).unionByName(row.withColumn("seq", F.lit(1)))
    return both.groupBy("id").agg(F.max_by("platform", "seq").alias("platform"), F.max_by("status", "seq").alias("status"), F.max("last_heartbeat").alias("last_heartbeat"))


def heartbeat(hosts: DataFrame, beats: DataFrame) -> DataFrame:
    """``hosts`` with the latest of their beats (host_id, at): a host that beats is active."""
    last = beats.groupBy(F.col("host_id").alias("id")).agg(F.max("at").alias("_at"))
    joined = hosts.join(last, "id", "left")
    return joined.withColumn("status", F.when(F.col("_at").isNotNull(), "active").otherwise(F.col("status"))).withColumn("last_heartbeat", F.greatest("last_heartbeat", "_at")).drop("_at")


def unreachable(hosts: DataFrame, since: Column) -> DataFrame:
    """``hosts`` with those unreachable that have not been heard of since then."""
    silent = (F.col("status") == "active") & (F.coalesce("last_heartbeat", F.lit("0001-01-01").cast("timestamp")) < since)
    return hosts.withColumn("status", F.when(silent, "unreachable").otherwise(F.col("status")))


def global_flag(hosts: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """(flag): whether there are hosts and the key is ``true`` for all of them."""
    own = state.filter(F.col("key") == key).select("host_id", "value")
    joined = hosts.select(F.col("id").alias("host_id")).join(own, "host_id", "left")
    return joined.agg((F.count(F.lit(1)) > 0).alias("some"), F.coalesce(F.bool_and(F.coalesce(F.col("value") == "true", F.lit(False))), F.lit(False)).alias("every")).select((F.col("some") & F.col("every")).alias("flag"))


def global_int_min(hosts: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """(least): the smallest integer value of the key over the hosts that have it; reading it fails if no host has one."""
    least = hosts.select(F.col("id").alias("host_id")).join(state.filter(F.col("key") == key), "host_id").agg(F.min(F.col("value").try_cast("int")).alias("least"))
    return least.select(F.coalesce("least", F.raise_error(F.lit(f"no host has a value for {key}")).cast("int")).alias("least"))


def task_counters(events: DataFrame) -> DataFrame:
    """(host_id, kind, active, done, failed, timed_out) of task events in the order of ``seq``.

    An event is ``started``, ``done``, ``failed``, ``timeout`` or ``reset``; the active count never falls under zero, which
    makes it the running sum minus its own lowest point, and a reset starts all counts again.
    """
    host = Window.partitionBy("host_id", "kind").orderBy("seq")
    epochs = events.withColumn("epoch", F.sum((F.col("event") == "reset").cast("long")).over(host)).withColumn("last", F.max("epoch").over(Window.partitionBy("host_id", "kind")))
    live = epochs.filter("epoch = last")
    step = F.when(F.col("event") == "started", 1).when(F.col("event") == "reset", 0).otherwise(-1)
    running = live.withColumn("sum", F.sum(step).over(host)).withColumn("low", F.least(F.lit(0), F.min("sum").over(host)))
    return running.groupBy("host_id", "kind").agg(
        F.max_by(F.col("sum") - F.col("low"), "seq").alias("active"),
        *[F.count_if(F.col("event") == e).alias(n) for e, n in (("done", "done"), ("failed", "failed"), ("timeout", "timed_out"))],
    )


def task_status(events: DataFrame) -> DataFrame:
    """(host_id, scan_done, dynamic_alive): whether no static task is active, and whether a dynamic cycle has ever completed.
    Events are those of ``task_counters``, and ``cycle`` marks a completed cycle."""
    counted = task_counters(events.filter("event <> 'cycle'")).filter("kind = 'static'").select("host_id", (F.col("active") == 0).alias("scan_done"))
    lived = events.filter("kind = 'dynamic' and event in ('done', 'failed', 'timeout', 'cycle')").select("host_id", F.lit(True).alias("dynamic_alive")).distinct()
    hosts = events.select("host_id").distinct()
    return hosts.join(counted, "host_id", "left").join(lived, "host_id", "left").select("host_id", F.coalesce("scan_done", F.lit(False)).alias("scan_done"), F.coalesce("dynamic_alive", F.lit(False)).alias("dynamic_alive"))


def set_current(reports: DataFrame, host: str, report: str) -> DataFrame:
    """``reports`` with the one report current for its host and the others of the host archived."""
    return reports.withColumn("is_current", F.when(F.col("host_id") == host, F.col("id") == report).otherwise(F.col("is_current")))


def add_report(reports: DataFrame, id: str, host: str, tier: str, at: Column) -> DataFrame:
    """``reports`` (id, host_id, tier, is_current, generated_at) with a new one, current for its host; others are archived."""
    row = reports.sparkSession.range(1).select(F.lit(id).alias("id"), F.lit(host).alias("host_id"), F.lit(tier).alias("tier"), F.lit(True).alias("is_current"), at.alias("generated_at"))
    return set_current(reports.select(*row.columns).unionByName(row), host, id)


def current_report(reports: DataFrame, host: str) -> DataFrame:
    """The host's current report, at most one row."""
    return reports.filter((F.col("host_id") == host) & F.col("is_current")).orderBy(F.col("generated_at").desc(), "id").limit(1)


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, rule, n) of the invariants of the data model that rows break."""
    checks = [
        ("nodes", "confidence between 0 and 1", nodes.filter("confidence < 0 or confidence > 1")),
        ("nodes", "known status", nodes.filter("status not in ('active', 'stale')")),
        ("edges", "ends differ", edges.filter("source_id = target_id")),
        ("edges", "confidence between 0 and 1", edges.filter("confidence < 0 or confidence > 1")),
        ("edges", "known flow kind", edges.filter("flow_kind not in ('control', 'data', 'structural')")),
        ("edges", "identity only on store links", edges.filter("identity_confidence is not null and kind not in ('writes_to', 'reads_from')")),
    ]
    out = None
    for table, rule, rows in checks:
        row = rows.agg(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
