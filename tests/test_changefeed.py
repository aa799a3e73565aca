import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators import changefeed

FIELDS = ("name", "file_path")
START = datetime(2025, 1, 1)


def audit_row(i, at, action, entity, details, kind="node"):
    return (f"id{i}", at, "user", action, kind, entity, details)


def replay(rows):
    """The rules, one row at a time."""
    state = {}
    seen = set()
    for uuid, at, _, action, kind, entity, details in sorted(rows, key=lambda r: (r[1] or START)):
        if kind != "node" or at is None or uuid in seen:
            continue
        try:
            given = json.loads(details) if details is not None else {}
        except ValueError:
            continue
        if not isinstance(given, dict):
            continue
        seen.add(uuid)
        action, key = action.strip().lower(), entity.strip().lower()
        if action == "delete_entity":
            state.pop(key, None)
        elif action in ("add_node", "create_entity"):
            state.setdefault(key, {}).update(given)
        elif action in ("update_entity", "tag_entity") and key in state:
            state[key].update(given)
    return {(k, v.get("name"), v.get("file_path")) for k, v in state.items()}


def rebuilt(spark, rows):
    audit = spark.createDataFrame(rows, schema.AUDIT)
    out = changefeed.apply_changes(changefeed.audit_changes(audit, FIELDS), FIELDS)
    return {tuple(r) for r in out.select("key", *FIELDS).collect()}


def test_random_feed_equals_replay(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        at = None if rng.random() < 0.02 else START + timedelta(seconds=i)
        # One entity has a third of all rows.
        entity = "hot" if rng.random() < 0.33 else f"e{rng.randrange(60)}"
        action = rng.choice(["add_node", "create_entity", "update_entity", " Update_Entity ", "tag_entity", "delete_entity", "add_edge"])
        details = rng.choice([None, "{}", '{"name": "n%d"}' % i, '{"name": null}', '{"file_path": "p%d", "name": "m%d"}' % (i, i), "[1]", '{"name": "x', '"text"'])
        rows.append(audit_row(i, at, action, entity.upper() if rng.random() < 0.1 else entity, details, rng.choice(["node"] * 9 + ["edge"])))
    rng.shuffle(rows)
    rows += rng.sample(rows, 50)
    assert rebuilt(spark, rows) == replay(rows)


def test_hot_keys_take_the_broadcast_way(spark):
    rows = [audit_row(i, START + timedelta(seconds=i), "create_entity" if i % 7 == 0 else "update_entity", "hot" if i % 3 else f"e{i}", '{"name": "n%d"}' % i) for i in range(4000)]
    rows.append(audit_row(9999, START + timedelta(seconds=2000.5), "delete_entity", "hot", None))
    assert rebuilt(spark, rows) == replay(rows)


def test_empty_feed_and_base(spark):
    assert rebuilt(spark, []) == set()
    base = spark.createDataFrame([("a", "old", "p"), ("b", "keep", None), ("c", "gone", "q")], "key string, name string, file_path string")
    rows = [
        audit_row(1, START, "update_entity", "a", '{"name": "new"}'),
        audit_row(2, START, "delete_entity", "c", None),
        audit_row(3, START + timedelta(1), "update_entity", "c", '{"name": "ignored"}'),
        audit_row(4, START, "create_entity", "d", '{"file_path": "made"}'),
    ]
    audit = spark.createDataFrame(rows, schema.AUDIT)
    out = changefeed.apply_changes(changefeed.audit_changes(audit, FIELDS), FIELDS, base)
    assert {tuple(r) for r in out.collect()} == {("a", "new", "p"), ("b", "keep", None), ("d", None, "made")}


def test_extra_columns_with_clashing_names_are_ignored(spark):
    rows = [audit_row(1, START, "add_node", "a", '{"name": "n"}')]
    audit = spark.createDataFrame(rows, schema.AUDIT).withColumn("key", F.lit("clash")).withColumn("op", F.lit(1)).withColumn("name", F.lit("x"))
    out = changefeed.apply_changes(changefeed.audit_changes(audit, FIELDS), FIELDS)
    assert [tuple(r) for r in out.collect()] == [("a", "n", None)]


def test_changes_without_identifier_and_one_identifier_twice(spark):
    at = lambda n: START + timedelta(n)
    rows = [(None, at(1), "u", "create_entity", "node", "k1", '{"name": "a"}'), (None, at(2), "u", "update_entity", "node", "k1", '{"name": "b"}'), (None, at(2), "u", "update_entity", "node", "k1", '{"name": "b"}')]
    rows += [("x", at(1), "u", "create_entity", "node", "k2", '{"name": "old"}'), ("x", at(3), "u", "create_entity", "node", "k2", '{"name": "new"}')]
    assert rebuilt(spark, rows) == {("k1", "b", None), ("k2", "new", None)}


def test_merging_into_a_base_equals_one_replay(spark):
    """Any division of the feed by time."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        action = rng.choice(["create_entity", "update_entity", "update_entity", "delete_entity"])
        details = rng.choice([None, '{"name": "n%d"}' % i, '{"file_path": "p%d"}' % i, '{"name": null}'])
        rows.append(audit_row(i, START + timedelta(seconds=i), action, f"e{rng.randrange(40)}", details))
    audit = spark.createDataFrame(rows, schema.AUDIT)
    changes = changefeed.deduplicated(changefeed.audit_changes(audit, FIELDS))
    for second in (0, 200, 450, 600):
        late = F.col("seq") >= F.lit(START + timedelta(seconds=second))
        base = changefeed.apply_changes(changes.where(~late), FIELDS, distinct=True)
        out = changefeed.apply_changes(changes.where(late), FIELDS, base, distinct=True)
        assert {tuple(r) for r in out.select("key", *FIELDS).collect()} == replay(rows)
