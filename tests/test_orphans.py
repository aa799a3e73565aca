import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.operators import orphans
from codeloom.operators.skew import canonical_id, hot_keys, lookup
from codeloom.sources.versions import Versions

START = datetime(2025, 1, 1)
EDGES = "uuid string, from_uuid string, to_uuid string, created_at timestamp_ntz"
NODES = "uuid string, created_at timestamp_ntz"


def spelt(rng, key):
    return rng.choice([key, key.upper(), f" {key}", f"{{{key}}}", f"{key} "])


def brute(edges, nodes):
    first = {}
    for u, at in nodes:
        if u is not None and at is not None:
            k = u.strip().strip("{}").strip().lower()
            first[k] = min(first.get(k, at), at)
    out = set()
    for uuid, a, b, at in edges:
        for endpoint, raw in (("from", a), ("to", b)):
            if raw is None:
                continue
            seen = first.get(raw.strip().strip("{}").strip().lower())
            if seen is None or at is None or seen > at:
                out.add((uuid, endpoint))
    return out


def tables(spark, edges, nodes):
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES)


def found(state):
    return {tuple(r) for r in state.pending.select("ref_id", "endpoint").collect()}


def test_increments_give_what_brute_force_gives(spark):
    rng = random.Random(5)
    day = lambda: START + timedelta(hours=rng.randrange(5000))
    nodes = [(spelt(rng, f"k{rng.randrange(120)}"), day()) for _ in range(200)]
    edges = [(f"e{i}", spelt(rng, f"k{rng.randrange(160)}"), None if rng.random() < 0.05 else spelt(rng, f"k{rng.randrange(160)}"), None if rng.random() < 0.02 else day()) for i in range(600)]
    edges += rng.sample(edges, 30)
    e, n = tables(spark, edges, nodes)
    want = brute(edges, nodes)
    assert found(orphans.run_increments(e, n)) == want
    state = orphans.run_increments(e, n, ("2025-03-01", "2025-05-01"))
    assert found(state) == want
    totals = orphans.counts(state).agg(F.sum("orphans"), F.sum("waiting"), F.sum("resolved")).first()
    assert totals[0] == len(want) and totals[1] + totals[2] == totals[0]


def test_hot_parent(spark):
    edges = [(f"e{i}", "hot" if i % 3 == 0 else f"k{i}", "hot", START + timedelta(days=i % 10)) for i in range(3000)]
    nodes = [("HOT", START + timedelta(days=5)), ("k1", START)]
    e, n = tables(spark, edges, nodes)
    assert hot_keys(orphans.references(e), "key") == ["hot"]
    assert found(orphans.run_increments(e, n)) == brute(edges, nodes)


def test_empty_tables(spark):
    e, n = tables(spark, [], [])
    assert found(orphans.run_increments(e, n)) == set()
    e, n = tables(spark, [("e", "a", "", START)], [])
    assert found(orphans.run_increments(e, n)) == {("e", "from"), ("e", "to")}


AUDIT = "uuid string, timestamp timestamp_ntz, action string, entity_type string, entity_uuid string"


def test_deletion_reopens(spark):
    day = lambda n: START + timedelta(days=n)
    e, n = tables(spark, [("e", "a", None, day(1)), ("f", "a", None, day(6))], [("a", day(0)), ("a", day(5))])
    audit = spark.createDataFrame([("1", day(2), " Delete_Entity", "node", "{A}"), ("2", None, "delete_entity", "node", "a"), ("3", day(3), "delete_entity", "edge", "a")], AUDIT)
    assert found(orphans.run_increments(e, n)) == set()
    for cuts in ((), ("2025-01-04",), ("2025-01-02", "2025-01-03", "2025-01-04", "2025-01-07")):
        state = orphans.run_increments(e, n, cuts, audit)
        assert [(r.ref_id, r.resolved_at) for r in state.pending.collect()] == [("e", day(5))]
        assert [tuple(r) for r in state.parents.collect()] == [("a", day(5), day(2))]


def test_random_deletions_equal_brute_force(spark):
    """Whatever the increments: a parent exists from its first row after its last deletion on."""
    rng = random.Random(8)
    day = lambda: START + timedelta(hours=rng.randrange(4000))
    nodes = [(spelt(rng, f"k{rng.randrange(40)}"), day()) for _ in range(120)]
    edges = [(f"e{i}", spelt(rng, f"k{rng.randrange(50)}"), None, day()) for i in range(300)]
    gone = [(f"d{i}", day(), "delete_entity", "node", f"k{rng.randrange(40)}") for i in range(25)]
    last = {}
    for _, at, _, _, k in gone:
        last[k] = max(last.get(k, at), at)
    plain = lambda u: u.strip().strip("{}").strip().lower()
    alive = [(u, at) for u, at in nodes if plain(u) not in last or at > last[plain(u)]]
    e, n = tables(spark, edges, nodes)
    audit = spark.createDataFrame(gone, AUDIT)
    for cuts in ((), ("2025-02-01", "2025-04-01")):
        assert found(orphans.run_increments(e, n, cuts, audit)) == brute(edges, alive)


def test_kept_state_goes_on_in_a_new_session(spark, tmp_path):
    rng = random.Random(6)
    day = lambda: START + timedelta(hours=rng.randrange(4000))
    nodes = [(f"k{rng.randrange(60)}", day()) for _ in range(100)]
    edges = [(f"e{i}", f"k{rng.randrange(80)}", f"k{rng.randrange(80)}", day()) for i in range(200)]
    e, n = tables(spark, edges, nodes)
    first = Versions(spark, str(tmp_path / "state"))
    orphans.run_increments(e, n, kept=first, until="2025-03-01", snapshots=True)
    assert first.current() == 1
    other = spark.newSession()
    e2, n2 = tables(other, edges, nodes)
    again = Versions(other, str(tmp_path / "state"))
    state = orphans.run_increments(e2, n2, ("2025-03-01", "2025-05-01"), kept=again, snapshots=True)
    assert found(state) == brute(edges, nodes) and again.all() == [3]
    taken = {r.as_of for r in orphans.history(again).select("as_of").collect()}
    assert taken == {datetime(2025, 3, 1), datetime(2025, 5, 1), None}
    whole = orphans.history(again).where("as_of is null").agg(F.sum("orphans")).first()[0]
    assert whole == len(brute(edges, nodes))


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"), keep=2)
    assert v.current() == 0 and v.read("a", "x int") is None
    for k in range(3):
        v.write({"a": spark.range(k).selectExpr("cast(id as int) x")})
    assert v.all() == [2, 3] and v.read("a", "x int").count() == 2 and v.read("b", "x int") is None
    (tmp_path / "v" / "v9" / "a").mkdir(parents=True)
    assert v.current() == 3


def test_lookup_equals_a_plain_left_join(spark):
    large = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), "id")
    index = spark.createDataFrame([("hot", 1), ("k5", 2), ("k6", 3)], "key string, v int")
    got = {tuple(r) for r in lookup(large, index, "key", ["v"]).select("id", "v").collect()}
    assert got == {tuple(r) for r in large.join(index, "key", "left").select("id", "v").collect()}


def test_canonical_id(spark):
    df = spark.createDataFrame([(" {ABC-1} ",), ("abc-1",), ("{ abc-1",), (None,)], "u string")
    assert [r[0] for r in df.select(canonical_id("u")).collect()] == ["abc-1", "abc-1", "abc-1", None]
