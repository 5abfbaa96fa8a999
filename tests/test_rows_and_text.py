import datetime as dt

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import calls, text
from skeinflow.operators import closure, evaluation, facts, reports, rows
from skeinflow.sources import files as src


def test_summaries(spark):
    findings = spark.createDataFrame([("active", "high"), ("active", " HIGH"), ("stale", "low"), ("active", None)], "status string, severity string")
    assert {tuple(r) for r in rows.severity_summary(findings).collect()} == {("critical", 0), ("high", 2), ("medium", 0), ("low", 0), ("total", 2)}
    assert {tuple(r) for r in rows.severity_summary(findings.limit(0)).collect()} >= {("total", 0)}


def test_flags_and_counters(spark):
    hosts = spark.createDataFrame([("a",), ("b",)], "id string")
    state = spark.createDataFrame([("a", "k", "true"), ("b", "k", "true"), ("a", "n", "4"), ("b", "n", "x")], "host_id string, key string, value string")
    assert rows.global_flag(hosts, state, "k").collect()[0].flag and not rows.global_flag(hosts, state, "z").collect()[0].flag
    assert not rows.global_flag(hosts.limit(0), state, "k").collect()[0].flag
    assert rows.global_int_min(hosts, state, "n").collect()[0].least == 4
    events = [("h", "s", e, i) for i, e in enumerate(["done", "started", "started", "timeout", "failed", "done", "started"])]
    got = rows.task_counters(spark.createDataFrame(events, "host_id string, kind string, event string, seq int")).collect()[0]
    assert (got.active, got.done, got.failed, got.timed_out) == (1, 2, 1, 1)


def test_upkeep(spark):
    t = dt.datetime(2025, 1, 1)
    frame = spark.createDataFrame([("a", "stale", t, '{"k":"1"}', 0.1), ("b", "stale", None, None, None), ("c", "active", t, "[]", 0.9)], "id string, status string, updated_at timestamp, attributes string, confidence double")
    assert {r.id for r in rows.retained(frame, F.lit("2025-03-01").cast("timestamp"), 30).collect()} == {"b", "c"}
    assert [r[0] for r in frame.orderBy("id").select(rows.shifted(F.col("confidence"), 0.5)).collect()] == [0.6, None, 1.0]
    assert {r.id: r.attributes for r in rows.with_attribute(frame, "k", "2").collect()} == {"a": '{"k":"2"}', "b": '{"k":"2"}', "c": '{"k":"2"}'}
    typed = frame.filter("id = 'a'")
    assert [rows.with_attribute(typed, "v", v).first().attributes for v in (F.lit(1), F.lit(True), F.lit(None).cast("int"), F.array(F.lit("q\"")))] == ['{"k":"1","v":1}', '{"k":"1","v":true}', '{"k":"1","v":null}', '{"k":"1","v":["q\\""]}']
    assert {r.id: r.attributes for r in rows.update_attribute(frame, "b", "x", F.lit(2)).collect()} == {"a": '{"k":"1"}', "b": '{"x":2}', "c": "[]"}
    with pytest.raises(KeyError):
        rows.update_attribute(frame, "nobody", "x", "1")
    chains = spark.createDataFrame([("x", "active", ["a"]), ("y", "active", None), ("z", "stale", ["a"])], "id string, status string, chain_nodes array<string>")
    assert [r.id for r in rows.stale_for_node(chains, "a").filter("changed").collect()] == ["x"]


def test_votes(spark):
    votes = spark.createDataFrame([("c", 0, "a", True, 0.8, ["e"], False), ("c", 1, "b", False, 0.4, None, False), ("c", 2, "z", False, 0.5, ["q"], True), ("d", 0, "a", None, 0.5, None, False)], "chain_id string, pos int, voter string, exploitable boolean, confidence double, evidence array<string>, timeout boolean")
    weights = spark.createDataFrame([("A ", 3.0), ("b", 1.0)], "name string, weight double")
    got = {r.chain_id: (r.verdict, round(r.confidence, 6), r.n_valid) for r in evaluation.aggregate_votes(votes, weights).collect()}
    assert got == {"c": ("exploitable", 0.7, 2), "d": ("uncertain", 0.0, 0)}
    chains = spark.createDataFrame([("c", ["e"]), ("d", None)], "id string, chain_edges array<string>")
    assert {tuple(r) for r in evaluation.evidence_present(votes, chains).collect()} == {("c", True, 1), ("d", False, 0)}


def test_statistics(spark):
    runs = spark.createDataFrame([("m", float(i), i % 2 == 0, True) for i in range(20)], "model string, latency double, valid boolean, agrees boolean")
    got = reports.latency_statistics(runs).collect()[0]
    assert (got["median"], got.p95, got.valid_rate) == (9.5, 19.0, 0.5)
    assert "| m |" in reports.markdown("t", {"s": reports.latency_statistics(runs)})


def test_call_shapes(spark):
    rules = calls.rule_table(spark)
    targets = ["re.compile", "self.db.commit", "_db.add_user", "x.text", "self._llm.chat", "llm_client.chat", "llmviewer.chat", "os.environ.get", "a.openai.chat.completions.create", "collection.query", "nothing", None]
    got = {}
    for r in calls.evidence(spark.createDataFrame([(t,) for t in targets], "target string"), rules).collect():
        got.setdefault(r.target, set()).add(r.capability)
    assert got == {"re.compile": {"executes_code"}, "self.db.commit": {"writes_db", "commit"}, "_db.add_user": {"writes_db"}, "x.text": {"db_statement"}, "self._llm.chat": {"calls_llm"}, "llm_client.chat": {"calls_llm"}, "os.environ.get": {"reads_env"}, "a.openai.chat.completions.create": {"calls_llm"}, "collection.query": {"reads_untrusted"}}


def test_source_facts(spark):
    code = b'''import os
from a.b import c
class X(Base):
    def m(self):
        return os.getenv("API_KEY")
@app.post("/p")
def handler(x):
    subprocess.run(x, shell=True)
    open("f", "w")
    cursor.execute("UPDATE t SET a=1")
    helper(x)
if __name__ == "__main__":
    handler(1)
'''
    found = facts.facts(spark.createDataFrame([("f.py", " Python", bytearray(code)), ("bad.py", "python", bytearray(b"def (")), ("n.py", "python", None)], "path string, language string, content binary"))
    assert {(r.kind, r.name, r.class_name) for r in facts.symbols(found).collect()} == {("class", "X", None), ("method", "m", "X"), ("function", "handler", None)}
    caps = {r.name: r.caps for r in facts.symbol_capabilities(found).collect()}
    assert caps == {"X": ["reads_env", "reads_secrets"], "m": ["reads_env", "reads_secrets"], "handler": ["executes_code", "executes_shell", "writes_db", "writes_filesystem"]}
    assert {(r.kind, r.handler, r.method, r.target) for r in facts.entry_points(found).collect()} == {("http", "handler", "POST", "/p"), ("cli", "<module>", None, None)}
    assert {tuple(r) for r in facts.call_graph(found).collect()} == {("handler", "open"), ("handler", "helper")}


def test_capabilities_stay_in_their_class(spark):
    code = b"class A:\n    def run(self):\n        os.system('x')\nclass B:\n    home = os.getenv('HOME')\n    def run(self):\n        def inner():\n            requests.get(1)\n        return 1\n\xff = 1\n"[:-6]
    found = facts.facts(spark.createDataFrame([("f.py", "python", bytearray(code + b"# \xff\n"))], "path string, language string, content binary"))
    got = {(r.name, r.class_name): r.caps for r in facts.definition_capabilities(found).collect()}
    assert got == {("A", None): ["executes_code", "executes_shell"], ("run", "A"): ["executes_code", "executes_shell"], ("B", None): ["http_egress", "reads_env"], ("run", "B"): ["http_egress"], ("inner", None): ["http_egress"]}
    assert calls.render_rules(calls.parse_rules()) == calls.RULES


def test_places(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = closure.closure(spark.createDataFrame([("a",)], "start string"), steps)
    assert {r.name for r in got.collect()} == {"a", "b", "c"}
    spans = spark.createDataFrame([("f", "out", 1, 100), ("f", "in", 50, 70)], "file string, name string, line_start int, line_end int")
    points = spark.createDataFrame([("f", 60), ("f", 80), ("f", 200), ("g", 1)], "file string, line int")
    assert {tuple(r) for r in closure.enclosing(points, spans).collect()} == {("f", 60, "in"), ("f", 80, "out"), ("f", 200, None), ("g", 1, None)}
    marks = spans.select("file", F.col("line_start").alias("line"), "name")
    assert {tuple(r) for r in closure.nearest_before(points, marks).collect()} == {("f", 60, "in"), ("f", 80, "in"), ("f", 200, "in"), ("g", 1, None)}
    classes = spark.createDataFrame([("f", "A", "B"), ("g", "B", None), ("f", "C", "D"), ("g", "D", None), ("h", "D", None), ("f", "E", "E")], "file string, name string, base string")
    assert {(r["name"], r.base_file) for r in closure.single_bases(classes).collect()} == {("A", "g"), ("B", None), ("C", None), ("D", None), ("E", None)}


def test_text_predicates(spark):
    frame = spark.createDataFrame([("a", "a"), ("ab", "a"), (None, "a"), (None, None), ("x", "y")], "a string, b string")
    assert [r[0] for r in frame.select(text.literal_match(F.col("a"), F.col("b"))).collect()] == [0.6, 0.3, 0.2, None, None]
    answers = ['{"exploitable": true, "confidence": 3}', "```json\n{\"exploitable\": \"yes\"}\n```", 'so: {"exploitable": false} ok', "none", "{} {", None]
    got = [tuple(r) for r in spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").orderBy("i").select(text.normal_vote(text.answer_json(F.col("a"))).alias("v")).select("v.exploitable", "v.timeout").collect()]
    assert got == [(True, False), (None, True), (False, False), (None, True), (None, True), (None, True)]
    paths = spark.createDataFrame([("x/mcp/servers/mail/tools.py",), ("mcp/servers/a.py",), ("servers/a/b.py",)], "p string")
    assert [r[0] for r in paths.select(text.server_of_path(F.col("p"))).collect()] == ["mail", None, None]
    pairs = text.match_modules(spark.createDataFrame([("pkg.mod",), ("deep.pkg.other",)], "module string"), spark.createDataFrame([("src/pkg/mod.py",), ("pkg/other/__init__.py",), ("notpkg/mod.py",)], "file string"))
    assert {tuple(r) for r in pairs.collect()} == {("pkg.mod", "src/pkg/mod.py"), ("deep.pkg.other", "pkg/other/__init__.py")}


def test_scan(spark, tmp_path):
    for name, body in (("a/x.py", "MODEL = 1\n"), ("a/.env", "LLM_MODEL=m\nOPENAI_BASE_URL='u'\n"), ("node_modules/y.js", ""), ("z.png", "p"), (".hidden", ""), ("conf.json", '{"llm": {"model": "q"}}'), ("a/__init__.py", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    files, skipped = src.scan(spark, f"file:{tmp_path}")
    assert {(r.path, r.language) for r in files.collect()} == {("a/x.py", "python"), ("a/.env", "dotenv"), ("conf.json", "json"), ("a/__init__.py", "python")}
    assert {r.path: r.reason for r in skipped.collect()} == {"z.png": "excluded extension: .png", ".hidden": "hidden file"}
    ends = src.endpoints(src.config_keys(files)).collect()
    assert {(r.provider, r.model, r.base_url) for r in ends} == {("openai", "m", "u"), (None, "q", None)}


def test_stream_merges_observations(spark, tmp_path):
    from skeinflow.streaming import runtime

    stored = runtime.as_edges(spark.createDataFrame([("a", "b", "k", "h", dt.datetime(2025, 1, 1))], runtime.SCHEMA)).drop("seq").withColumn("observed_by", F.array(F.lit("ast")))
    runtime.store_edges(stored, f"{tmp_path}/store")
    seen = [("a", "b", "k", "h", dt.datetime(2025, 1, 2)), ("a", "b", "k", "h", dt.datetime(2025, 1, 2)), ("a", "c", "k", "h", dt.datetime(2025, 1, 2)), ("q", "q", "k", "h", dt.datetime(2025, 1, 2))]
    spark.createDataFrame(seen, runtime.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    runtime.merge_stream(runtime.observations(spark, f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    got = {(r.source_id, r.target_id): sorted(r.observed_by) for r in runtime.stored_edges(spark, f"{tmp_path}/store").collect()}
    assert got == {("a", "b"): ["ast", "runtime"], ("a", "c"): ["runtime"]}
