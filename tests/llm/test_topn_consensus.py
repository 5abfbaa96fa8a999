import random

from pyspark.sql import functions as F

from skeinflow.llm import consensus as c
from skeinflow.llm.topn import parted, top_n


def test_top_n_against_sorting(spark):
    rng = random.Random(5)
    rows = [(f"id{i}", rng.choice(["hot", "hot", "hot", f"g{i % 40}", None]), rng.choice([None, float("nan"), 1.0, 2.0, 3.0, rng.random()]), "x") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id string, grp string, score double, place string").repartition(7)
    got = {}
    for r in top_n(frame, "grp", "score", [F.col("id")], 4).collect():
        got.setdefault(r.grp, []).append(r.id)
    assert sorted(map(str, top_n(parted(frame, "id", "p"), "grp", "score", [F.col("id")], 4, "p").drop("p").collect())) == sorted(map(str, top_n(frame, "grp", "score", [F.col("id")], 4).collect()))
    want = {}
    for i, g, s, _ in sorted(rows, key=lambda r: (-(r[2] if r[2] is not None and r[2] == r[2] else -1e9), r[0])):
        if s is not None and s == s and len(want.setdefault(g, [])) < 4:
            want[g].append(i)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert top_n(frame.limit(0), "grp", "score", [], 2).count() == 0
    clashing = frame.withColumn("_group_", F.lit("x")).withColumn("_part_", F.lit(1)).withColumn("_place_________", F.lit(None).cast("string")).withColumn("_key_", F.lit(2))
    assert sorted(r.id for r in top_n(clashing, "grp", "score", [F.col("id")], 4).collect()) == sorted(r.id for r in top_n(frame, "grp", "score", [F.col("id")], 4).collect())
    zeros = spark.createDataFrame([("a", 0.0), ("b", -0.0), ("c", 0.0)], "id string, score double").withColumn("g", F.lit(1))
    assert [r.id for r in top_n(zeros, "g", "score", [F.col("id")], 2).orderBy("id").collect()] == ["a", "b"]


VOTE = "array<struct<model:string,exploitable:boolean,confidence:double,reasoning:string,evidence:array<string>,timeout:boolean>>"


def vote(model, yes, timeout=False):
    return (model, yes, 0.5, None, [], timeout)


def test_answers(spark):
    rows = [(1, [vote("A", True), vote(" a ", False), vote("b", None), vote("c", True, True), vote(None, True), None]), (2, None), (3, [])]
    frame = spark.createDataFrame(rows, f"id int, v {VOTE}").select("id", c.answers(F.col("v")).alias("votes"))
    assert {r.id: [tuple(x) for x in r.votes] for r in frame.collect()} == {1: [("a", False)], 2: [], 3: []}


def test_consensus_finds_the_truth_and_the_contrarian(spark):
    rng = random.Random(11)
    right = {"good1": 0.92, "good2": 0.88, "good3": 0.85, "contra": 0.15, "coin": 0.5, "yes": None}
    truth, rows = {}, []
    for i in range(1500):
        truth[i] = rng.random() < 0.45
        panel = rng.sample(sorted(right), 4)
        rows.append((i, [vote(m, True if right[m] is None else truth[i] == (rng.random() < right[m])) for m in panel]))
    rows.append((9999, []))
    items = spark.createDataFrame(rows, f"id int, v {VOTE}").select("id", c.answers(F.col("v")).alias("votes"))
    panel = c.fit_voters(items, "votes")
    voters = {v.name: v for v in panel.voters}
    worth = {n: v.knows - v.opposes for n, v in voters.items()}
    assert worth["good1"] > 0.7 and worth["contra"] < -0.5 and abs(worth["coin"]) < 0.2 and abs(worth["yes"]) < 0.2
    got = {r.id: r for r in c.consensus(items, "votes", panel).collect()}
    assert got[9999].consensus is None and got[9999].agreement is None
    majority = sum((sum(v[1] for v in vs) * 2 > len(vs)) == truth[i] for i, vs in rows if vs)
    assert sum(got[i].consensus == truth[i] for i in truth) > max(majority, 0.88 * 1500)


def test_no_votes(spark):
    items = spark.createDataFrame([(1, [])], f"id int, v {VOTE}").select("id", c.answers(F.col("v")).alias("votes"))
    panel = c.fit_voters(items, "votes")
    assert panel.voters == [] and panel.rates(spark).count() == 0 and c.consensus(items, "votes", panel).collect()[0].consensus is None


def test_a_long_panel_is_fitted_alike(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        truth = rng.random() < 0.5
        rows.append((i, [vote(f"v{m}", truth == (rng.random() < 0.6 + 0.05 * m)) for m in range(6) if rng.random() < 0.8]))
    items = spark.createDataFrame(rows, f"id int, v {VOTE}").select("id", c.answers(F.col("v")).alias("votes"))
    short, long = c.fit_voters(items, "votes", max_rounds=6), c.fit_voters(items, "votes", max_rounds=6, short_panel=2)
    a, b = ({r.voter: (round(r.knows, 6), round(r.opposes, 6), round(r.support_yes, 6)) for r in p.rates(spark).collect()} for p in (short, long))
    assert long.table is not None and a == b
    x, y = ({r.id: (r.consensus, r.agreement, r.probability and round(r.probability, 6)) for r in c.consensus(items, "votes", p).collect()} for p in (short, long))
    assert x == y and len(x) == 300
    clashing = items.withColumn("row", F.lit(1)).withColumn("_odds", F.lit("x")).withColumn("consensus", F.lit("old")).withColumn("_row", F.lit(None).cast("int"))
    for p in (short, long):
        assert {r.id: r.consensus for r in c.consensus(clashing, "votes", p).collect()} == {i: v[0] for i, v in x.items()}
