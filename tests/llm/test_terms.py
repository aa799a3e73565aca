import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.llm import terms

AT = datetime(2025, 1, 1)
NODES = "uuid string, name string, tags array<string>, created_at timestamp_ntz"


def counted(rows):
    last = {}
    old = datetime(1, 1, 1)
    for u, n, t, at in rows:
        if u is not None and (u not in last or (at or old) >= (last[u][2] or old)):
            last[u] = (n, t, at)
    occ, rec = Counter(), Counter({(terms.RECORDS, "."): len(last)})
    occ.update(rec)
    for n, t, _ in last.values():
        for field, values in (("name", [n]), ("tags", t or [])):
            found = [x for x in map(terms.normal, values) if x]
            occ.update((field, x) for x in found)
            rec.update((field, x) for x in set(found))
    return {(f, t, o, rec[f, t]) for (f, t), o in occ.items()}


def make(seed=1, n=400):
    rng = random.Random(seed)
    words = ["Load ", "load", "CAFE\u0301", "café", "", "  ", None, "x y", "Ünï", "größe", "GRÖSSE", "\ttab\n"]
    rows = [(f"u{i}", rng.choice(words), None if rng.random() < 0.1 else [rng.choice(words) for _ in range(rng.randrange(5))], AT + timedelta(days=rng.randrange(300))) for i in range(n)]
    return rows + [(u, n_, t, at + timedelta(days=40)) for u, n_, t, at in rng.sample(rows, 40)] + rows[:10]


def test_increments_equal_a_recount(spark, tmp_path):
    rows = make()
    df = spark.createDataFrame(rows, NODES).withColumn("term", F.lit("clash")).withColumn("field", F.lit(1))
    for k, cuts in enumerate(((), ("2025-06-01",), ("2020-01-01", "2025-04-01", "2025-08-01"))):
        counts = terms.node_terms(df, cuts, str(tmp_path / str(k)))
        assert {(r.field, r.term, r.occurrences, r.records) for r in counts.collect()} == counted(rows)


def test_rows_without_a_time_are_the_oldest(spark, tmp_path):
    rows = [("a", "old", ["t"], AT), ("a", "none", ["u"], None), ("b", "only", None, None), (None, "x", None, AT)]
    df = spark.createDataFrame(rows, NODES)
    for k, cuts in enumerate(((), ("2024-01-01",), ("2025-06-01",))):
        got = {(r.field, r.term) for r in terms.node_terms(df, cuts, str(tmp_path / str(k))).collect()}
        assert got == {("name", "old"), ("tags", "t"), ("name", "only"), (terms.RECORDS, ".")}


def test_changed_and_deleted_records_in_a_new_session(spark, tmp_path):
    image = lambda s, rows: s.createDataFrame(rows, "record string, name array<string>")
    store = terms.Counts(spark, str(tmp_path / "c"), buckets=3)
    store.apply(terms.deltas(terms.signed(None, image(spark, [("a", ["x", "x"]), ("b", ["x"]), ("c", ["y"])])), ["name"]))
    other = spark.newSession()
    again = terms.Counts(other, str(tmp_path / "c"), buckets=3)
    assert again.version == 1
    now = again.apply(terms.deltas(terms.signed(image(other, [("a", ["x", "x"]), ("c", ["y"])]), image(other, [("a", ["z"])])), ["name"]))
    assert {(r.field, r.term, r.occurrences, r.records) for r in now.collect()} == {("name", "x", 1, 1), ("name", "z", 1, 1), (terms.RECORDS, ".", 2, 2)}
    # Only the current version is left, and a folder half written by a lost run isn't one.
    (tmp_path / "c" / "v7" / "counts").mkdir(parents=True)
    assert store.version == again.version == 2 and not (tmp_path / "c" / "v1").exists()


def test_normal_forms():
    import pyarrow as pa

    texts = ["A b ", "CAFE\u0301", "", " \t", None, "\x1cx\x1f", "\u00a0Ünï\u2003", "ΣΑΣ", "İ"]
    assert terms.normals(pa.array(texts)).to_pylist() == [terms.normal(t) for t in texts]


def test_marks(spark, tmp_path):
    rows = [("name", "a", 9, 2), ("name", "b", 9, 3), ("name", "c", 11, 11), ("name", "d", 10, 10), (terms.RECORDS, ".", 1000, 1000)]
    counts = spark.createDataFrame(rows, "field string, term string, occurrences bigint, records bigint")
    assert {r.term: r.mark for r in terms.marked(counts).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}


def test_empty(spark, tmp_path):
    counts = terms.node_terms(spark.createDataFrame([], NODES), ("2025-06-01",), str(tmp_path / "e"))
    assert terms.marked(counts).count() == 0
