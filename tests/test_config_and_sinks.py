import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import evaluation, flow, reports, rows, sites, stages
from skeinflow.operators.graph import Graph
from skeinflow.sources import block_yaml, config, files, sinks


def test_yaml():
    text = "# c\na: 1\nb:\n  - x\n  - y: \"z # no\"   # yes\n    w: [1, 'q, r', {k: v, l: [2]}]\n  - - n\nc: |\n  two\n   lines\n\nd: >-\n  one\n  line\ne: http://h:1/v#f\nf:\ng: -1.5e3\nh: off\n'i': \"\"\n"
    assert block_yaml.load(text) == {"a": 1, "b": ["x", {"y": "z # no", "w": [1, "q, r", {"k": "v", "l": [2]}]}, "- n"], "c": "two\n lines\n", "d": "one line", "e": "http://h:1/v#f", "f": None, "g": -1500.0, "h": False, "i": ""}
    assert block_yaml.load("") is None and block_yaml.load("---\nk:\n- 1\n- 2\n") == {"k": [1, 2]} and block_yaml.load("just text") == "just text"
    for bad in ("a: [1", "a:\n\tb: 1", "a: &x 1", "a: 1\n  b: 2", "a: 'x", "---\na: 1\n---\nb: 1"):
        with pytest.raises(ValueError):
            block_yaml.load(bad)


def test_policy():
    assert config.policy("") == config.Policy()
    p = config.policy("detectors:\n  disabled: [a]\nllm_classifier:\n  mode: auto\nstore:\n  confidence_threshold: 0.5\nlogs:\n  keep_archives: 2\nruntime:\n  mode: off\n  test_command: ' x '\n")
    assert (p.detectors(["a", "b"]), p.llm_classifier, p.confidence_threshold, p.keep_archives, p.runtime, p.test_command) == (["b"], "auto", 0.5, 2, "off", "x")
    for bad in ("[]", "store: 1", "store:\n  confidence_threshold: 2", "store:\n  confidence_threshold: true", "unclassified:\n  action: go", "detectors:\n  enabled: x", "logs:\n  keep_archives: -1"):
        with pytest.raises(config.ConfigError):
            config.policy(bad)
    models = "evaluation:\n  mode: full\n  defaults:\n    timeout: 5\n  models:\n    - name: a\n      role: voter\n    - name: b\n      role: fast\n      timeout: 9\n    - {name: j, role: judge}\n"
    full, fast = config.ensemble(models), config.ensemble(models, "fast")
    assert ([m.name for m in full.voters], full.judge.name, full.parallel, full.voters[0].timeout) == (["a"], "j", False, 5)
    assert (fast.voters[0].timeout, fast.judge, fast.parallel) == (9, None, True)
    for mode in ("solo", "none"):
        with pytest.raises(config.ConfigError):
            config.ensemble(models, mode)


def test_target_and_workspace(tmp_path):
    assert config.target(str(tmp_path)).root == str(tmp_path) and config.target("name:tag", "image").kind == "image"
    with pytest.raises(FileNotFoundError):
        config.target(str(tmp_path / "no"))
    with pytest.raises(config.ConfigError):
        config.target(str(tmp_path), "disk")
    w = config.Workspace(tmp_path / "w").prepare()
    w.policy_file.write_text("store:\n  confidence_threshold: 0.4\n")
    (w.cache / "x").write_text("1")
    w.clean()
    assert w.policy().confidence_threshold == 0.4 and not (w.cache / "x").exists() and w.graph.exists()


NODE = "id string, kind string, name string, host_id string, content_hash string, status string, attributes string, capabilities array<string>, observed_by array<string>, confidence double, seq long"
EDGE = "id string, source_id string, target_id string, kind string, host_id string, status string, edge_precision string, flow_kind string, data_flow_confirmed string, identity_confidence double, attributes string, capabilities array<string>, observed_by array<string>, confidence double, seq long"


def test_graph_is_written_and_merged(spark, tmp_path):
    node = lambda i, n, seq: (i, "tool", n, "h", None, "active", json.dumps({"v": seq}), [], ["ast"], 1.0, seq)
    edge = ("e", "a", "b", "uses_tool", "h", "active", "syntactic", "control", None, None, "{}", [], ["ast"], 1.0, 1)
    folder = f"file:{tmp_path}/g"
    first = sinks.write_graph(spark.createDataFrame([node("a", "x", 1), node("b", "y", 2)], NODE), spark.createDataFrame([edge], EDGE), folder)
    again = sinks.write_graph(spark.createDataFrame([node("a", "z", 1), node("c", "w", 2), node("c", "v", 3)], NODE), spark.createDataFrame([edge], EDGE), folder)
    assert first == {"nodes": {"added": 2, "updated": 0}, "edges": {"added": 1, "updated": 0}} and again == {"nodes": {"added": 1, "updated": 2}, "edges": {"added": 0, "updated": 1}}
    assert {(r.id, r["name"], r.attributes) for r in spark.read.parquet(f"{folder}/nodes.parquet").collect()} == {("a", "z", '{"v":1}'), ("b", "y", '{"v":2}'), ("c", "v", '{"v":3}')}


def test_bundle(spark, tmp_path):
    chains = spark.createDataFrame([("c1", "exploitable", 0.5, True, ["e"])], "id string, verdict string, confidence double, validated boolean, chain_edges array<string>")
    paths = spark.createDataFrame([("c1", "a -> b")], "id string, path string")
    groups = spark.createDataFrame([("g", "u", 1.0, None, None, False, ["c1"], ["c2"])], "id string, untrusted_source_id string, score double, priority string, verdict string, validated boolean, write_chain_ids array<string>, read_chain_ids array<string>")
    for stamp in ("1", "2", "3"):
        sinks.write_bundle(f"file:{tmp_path}/r", "t", {"chains": chains.select("id")}, chains, paths, groups, keep=1, stamp=stamp)
    assert "| c1 |" in (tmp_path / "r/current/report.md").read_text() and [p.name for p in (tmp_path / "r/archive").iterdir()] == ["3"]
    got = json.loads(spark.read.text(f"file:{tmp_path}/r/current/chain_groups").first().value)
    assert [(c["side"], c["chain_id"], c.get("path")) for c in got["chains"]] == [("read", "c2", None), ("write", "c1", "a -> b")]


def test_scan_enters_no_excluded_directory(spark, tmp_path):
    for name in ("a/b/c.py", "a/.venv/x.py", "node_modules/deep/y.js", "t.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    kept, skipped = files.scan(spark, str(tmp_path))
    assert {r.path for r in kept.collect()} == {"a/b/c.py", "t.txt"} and skipped.count() == 0
    assert [tuple(r) for r in files.manifest(kept).orderBy("language").collect()] == [("", 1, 1), ("python", 1, 1)]
    yaml = spark.createDataFrame([("c.yml", "yaml", bytearray(b"llm:\n  openai:\n    model: m\n    base_url: u\n")), ("d.yml", "yaml", bytearray(b"a: ["))], "path string, language string, content binary")
    assert {(r.key, r.value) for r in files.config_keys(yaml).collect()} == {("LLM_OPENAI_MODEL", "m"), ("LLM_OPENAI_BASE_URL", "u")}


def test_store_hints_meet_by_beginnings(spark):
    site = [("a.py", "fs", "write", "data/x", 1), ("b.py", "fs", "read", "data/", 2), ("c.py", "fs", "read", None, 3), ("d.py", "db", "read", None, 4), ("e.py", "fs", "read", "other", 5)]
    sites_ = spark.createDataFrame(site, "path string, family string, side string, hint string, line int")
    imports = spark.createDataFrame([("a.py", ["w.py"]), ("b.py", ["w.py"]), ("c.py", ["a.py"])], "path string, imports array<string>")
    got = {(r.path, r.key): round(r.confidence, 9) for r in stages.store_links(sites_, imports).collect()}
    want = {("a.py", "data/x"): [0.6, 0.3], ("a.py", "data/"): [0.3, 0.3], ("b.py", "data/"): [0.6, 0.3], ("b.py", "data/x"): [0.3, 0.3], ("c.py", "data/x"): [0.2, 0.1], ("c.py", "data/"): [0.2, 0.1], ("c.py", "other"): [0.2], ("e.py", "other"): [0.6]}
    for key, signals in want.items():
        left = 0.7
        for s in signals:
            left *= 1 - s
        assert got[key] == pytest.approx(1 - left)
    assert set(got) == set(want)
    with pytest.raises(ValueError):
        sites.register("fs", sites.objects)


def test_later_stages(spark):
    node = "id string, kind string, name string, file string, capabilities array<string>, parent string, line int, framework string, detail string, stage int"
    nodes = spark.createDataFrame([("e1", "entry_point", "x", "f", [], "h", 1, None, "http", 3), ("e2", "entry_point", "y", "f", [], "i", 2, None, "http", 3), ("a", "agent", "A", "f", [], None, 1, "langchain", None, 5)], node)
    edges = spark.createDataFrame([("q", "e1", "z", "delegates_to", "localhost", "control", None, None)], "id string, source_id string, target_id string, kind string, host_id string, flow_kind string, identity_confidence double, via string")
    assert [(r.source_id, r.target_id, r.via) for r in stages.orphan_entries(nodes, edges).collect()] == [("e2", "a", "orphan_entry_to_single_agent")]
    two = nodes.unionByName(nodes.filter("id = 'a'").withColumn("id", F.lit("b")))
    assert stages.orphan_entries(two, edges).count() == 0
    assert flow.flow_kind("local_var_match") == "data" and flow.flow_kind("literal_only") == "control"
    assert flow.of_tools(["find"], "use find_all") == ("unknown", ["no tool named in the prompt"]) and flow.of_tools(["find"], "use find.")[0] == "parameter_match"


def test_hosts_and_state(spark):
    now = dt.datetime(2025, 1, 10)
    hosts = spark.createDataFrame([("a", "k8s", "active", now), ("b", "k8s", "active", None)], "id string, platform string, status string, last_heartbeat timestamp")
    assert {(r.id, r.platform, r.status) for r in rows.register_host(hosts, "b", "swarm", F.lit(now)).collect()} == {("a", "k8s", "active"), ("b", "swarm", "active")}
    assert {r.id: r.status for r in rows.unreachable(hosts, F.lit(now) - F.expr("interval 1 day")).collect()} == {"a": "active", "b": "unreachable"}
    state = rows.set_state(spark.createDataFrame([("h", "scan_done", "false")], "host_id string, key string, value string"), "h", "scan_done", True)
    assert [(r.flag, r.number) for r in rows.typed_state(state).collect()] == [(True, None)]
    for key, value in (("scan_done", "x"), ("nothing", "x"), ("cleanup_stale_days", True)):
        with pytest.raises(ValueError):
            rows.set_state(state, "h", key, value)
    reported = rows.add_report(spark.createDataFrame([("r1", "h", "t", True, now)], "id string, host_id string, tier string, is_current boolean, generated_at timestamp"), "r2", "h", "t", F.lit(now))
    assert rows.current_report(reported, "h").first().id == "r2" and reported.filter("is_current").count() == 1
    with pytest.raises(Exception, match="no host"):
        rows.global_int_min(hosts, state, "cleanup_stale_days").collect()


def test_asking(spark):
    chains = spark.createDataFrame([("c", ["n"], ["e"])], "id string, chain_nodes array<string>, chain_edges array<string>")
    nodes = spark.createDataFrame([("n", "tool", "x", [], ["ast"], 1.0, "{}", "active")], "id string, kind string, name string, capabilities array<string>, observed_by array<string>, confidence double, attributes string, status string")
    edges = spark.createDataFrame([], "id string, kind string, source_id string, target_id string, flow_kind string, capabilities array<string>, observed_by array<string>, edge_precision string, data_flow_confirmed string, attributes string, status string")
    prompted = evaluation.prompts(evaluation.payloads(chains, Graph(nodes, edges)))
    got = evaluation.ask(prompted, lambda system, user: json.dumps({"n": user.count("unknown")}), ["m1", "m2"]).collect()
    assert {(r.model, r.answer) for r in got} == {("m1", '{"n": 2}'), ("m2", '{"n": 2}')}
    judge = evaluation.prompts(evaluation.payloads(chains, Graph(nodes, edges)), spark.createDataFrame([("c", "[m1] yes")], "chain_id string, reasoning string")).first()
    assert "[m1] yes" in judge.user and "verdict" in judge.system
    assert "| kind |" in reports.markdown("t", {"n": reports.by_kind(nodes)})
