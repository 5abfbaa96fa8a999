import datetime as dt
import random

from skeinflow.operators.orphans import Citing, orphan_references, orphan_report

D = lambda d, h=0: dt.datetime(2025, 1, 1) + dt.timedelta(days=d, hours=h)
CITES = "id string, created_at timestamp, refs array<string>, day int, key string"
KNOWN = "id string, status string, created_at timestamp, updated_at timestamp"


def run(spark, cites, known, **options):
    c = spark.createDataFrame([(i, at, refs, 1, "x") for i, at, refs in cites], CITES)
    k = spark.createDataFrame(known, KNOWN)
    found = orphan_references([Citing("c", c, {"refs": "k"})], {"k": k}, **options)
    return found, {(r.record_id, r.ref_key): r.reason for r in found.collect()}


def expected(cites, known):
    rows = {}
    for i, status, created, updated in known:
        if i and i.strip():
            rows.setdefault(i.strip().lower(), []).append((updated or dt.datetime.min, status, created, updated))
    out = {}
    for i, at, refs in cites:
        for ref in refs or []:
            key = (ref or "").strip().lower()
            if not key:
                continue
            own = rows.get(key)
            if not own:
                out[(i, key)] = "missing"
                continue
            if at is None:
                continue
            created = [r[2] for r in own if r[2]]
            last = max(own, key=lambda r: (r[0], r[1] == "stale"))
            if created and min(created) > at:
                out[(i, key)] = "later"
            elif last[1] == "stale" and last[3] and last[3] <= at:
                out.setdefault((i, key), "gone")
    return out


def test_cases(spark):
    cites = [("a", D(5), ["K1", " k2 ", None, "", "nope", "nope"]), ("b", D(1), ["k1"]), ("c", None, ["k1", "gone"]), ("d", D(5), None), ("e", D(20), ["old"]), ("f", D(9), ["old"])]
    known = [("k1", "active", D(3), D(3)), ("k2", "active", D(5, 1), D(6)), ("old", "active", D(0), D(0)), ("old", "stale", D(0), D(10)), (None, "active", D(0), D(0)), (" ", "active", D(0), D(0))]
    _, got = run(spark, cites, known)
    assert got == {("a", "k2"): "later", ("a", "nope"): "missing", ("b", "k1"): "later", ("c", "gone"): "missing", ("e", "old"): "gone"}


def test_empty_tables(spark):
    assert run(spark, [], [])[1] == {}
    assert run(spark, [("a", D(0), ["x"])], [])[1] == {("a", "x"): "missing"}
    assert run(spark, [], [("x", "active", D(0), D(0))])[1] == {}


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(300)]
    known = []
    for k in keys[:250]:
        made = D(rng.randrange(60), rng.randrange(24))
        known.append((k, "active", made, made))
        if rng.random() < 0.4:
            known.append((k.upper(), rng.choice(["stale", "active"]), made, made + dt.timedelta(days=rng.randrange(30), hours=rng.randrange(24))))
    cites = [(f"r{i}", None if rng.random() < 0.02 else D(rng.randrange(80), rng.randrange(24)), [rng.choice(keys) if rng.random() < 0.6 else "k7" for _ in range(3)]) for i in range(600)]
    found, got = run(spark, cites, known, buckets=3, filter_bits=1 << 8)
    assert got == expected(cites, known)
    assert sum(r.n_refs for r in orphan_report(found).collect()) == len(got)
