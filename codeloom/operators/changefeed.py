"""Applying a feed of inserts, updates and deletes to a base table.

The feed is ordered by a sequence column, not by arrival. Changes are deduplicated by identifier, changes up to a
key's last delete are dropped, and the last value given for each field is found with a window ranking, of which
Spark evaluates the limit before the shuffle, so a key with a third of all rows sends one row per task.

Rules: of changes with one identifier the one with the largest sequence counts, of those the largest in its other
columns; changes without identifier are each their own, equal ones count once. An *insert* creates, or overwrites the given fields of what exists; an *update* overwrites the given fields of
what exists and otherwise changes nothing; a *delete* removes, and a later insert starts afresh. Changes without key
or sequence don't count. Of changes with the same key and sequence, deletes apply first, then the one with the larger
identifier wins. An empty feed leaves the base as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.skew import lookup
from codeloom.session import cut

INSERT, UPDATE, DELETE = "insert", "update", "delete"
MADE = "\0made"


def deduplicated(changes: DataFrame) -> DataFrame:
    """Each change once, by its identifier; changes without key or sequence are left out. Combined where the rows are."""
    rows = changes.where(F.col("key").isNotNull() & F.col("seq").isNotNull())
    others = [c for c in changes.columns if c != "seq"]
    # A change without identifier is told by what it says.
    ident = F.coalesce(F.col("change_id").cast("string"), F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string")))
    return rows.groupBy(ident.alias("i_")).agg(F.max(F.struct("seq", *others)).alias("c_")).select(*[F.col(f"c_.{c}").alias(c) for c in changes.columns])


def apply_changes(changes: DataFrame, fields: Sequence[str], base: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """The table (key and fields) after the last change.

    changes: change_id, key, seq, op and, per field f, `f` (new value) and `has_f` (whether the change gives it; a
    given null overwrites). base: key and fields as they were before the first change. distinct: the changes are
    deduplicated and written already.
    """
    if not distinct:
        changes = cut(deduplicated(changes))
    deletes = changes.where(F.col("op") == DELETE).groupBy("key").agg(F.max("seq").alias("deleted_at_"))
    writes = lookup(changes.where(F.col("op").isin(INSERT, UPDATE)), deletes, "key", ["deleted_at_"])
    # At equal sequence the delete applies first, so a write at the same time stands.
    writes = writes.where(F.col("deleted_at_").isNull() | (F.col("seq") >= F.col("deleted_at_")))

    # One cell per given field, and one for every insert: of those the first after the last delete is wanted, from
    # which on the key exists, of the others the last. A field whose last value is older than the insert has none.
    cells = F.array(
        *[_cell(f, F.coalesce(F.col(f"has_{f}"), F.lit(False)), F.col(f), F.col("seq"), F.col("change_id")) for f in fields],
        _cell(MADE, F.col("op") == INSERT, F.lit(None), F.col("seq"), F.lit(None)),
    )
    cells = writes.select("key", F.explode(F.filter(cells, lambda x: x["given"])).alias("cell")).select("key", "cell.*")
    rank = F.row_number().over(W.partitionBy("key", "field").orderBy(F.desc("at"), F.desc("id"), F.desc("value")))
    latest = cells.where(F.col("field") != MADE).withColumn("rank_", rank).where("rank_ = 1")
    first = cells.where(F.col("field") == MADE).groupBy("key").agg(F.min("at").alias("made_at_"))
    last = latest.groupBy("key").agg(
        *[F.max(F.when(F.col("field") == f, F.struct("at", F.struct(F.col("value").alias("v")).alias("cell")))).alias(f) for f in fields]
    )
    if base is None:
        made = first.join(last, "key", "left")
        return made.select("key", *[F.when(F.col(f)["at"] >= F.col("made_at_"), F.col(f)["cell"]["v"]).alias(f) for f in fields])
    # What the base still holds exists from before the first change.
    old = base.select("key", F.lit(True).alias("old_"), *[F.col(f).cast("string").alias(f"old_{f}_") for f in fields])
    merged = old.join(deletes, "key", "left_anti").join(first, "key", "full").join(last, "key", "left")
    counts = lambda f: F.col(f).isNotNull() & (F.col("old_").isNotNull() | (F.col(f)["at"] >= F.col("made_at_")))
    return merged.select("key", *[F.when(counts(f), F.col(f)["cell"]["v"]).otherwise(F.col(f"old_{f}_")).alias(f) for f in fields])


def _cell(field: str, given: Column, value: Column, at: Column, change_id: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"), given.alias("given"), value.cast("string").alias("value"), at.alias("at"), change_id.cast("string").alias("id")
    )


# What each action of the audit log does.
OPS = {
    "add_node": INSERT,
    "create_entity": INSERT,
    "update_entity": UPDATE,
    "tag_entity": UPDATE,
    "delete_entity": DELETE,
}


def audit_changes(audit: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Audit rows of entities as changes.

    Rows whose details are neither null nor a JSON object, rows without a timestamp and rows of other entity types
    don't count. Actions and ids are read regardless of case and blanks at the ends. Extra columns are ignored.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), r"^\s+|\s+$", "")
    op = F.coalesce(*[F.when(F.col("action_") == a, F.lit(o)) for a, o in OPS.items()])
    parsed = F.try_parse_json("details")
    rows = audit.select(
        F.col("uuid").alias("change_id"),
        plain("entity_uuid").alias("key"),
        F.col("timestamp").alias("seq"),
        plain("action").alias("action_"),
        "entity_type",
        "details",
        F.when(parsed.isNotNull(), F.json_object_keys("details")).alias("keys_"),
        parsed.alias("parsed_"),
    ).where((F.col("entity_type") == "node") & F.col("seq").isNotNull() & (F.col("details").isNull() | F.col("keys_").isNotNull()))
    out = rows.withColumn("op", op).where("op is not null")
    return out.select(
        "change_id",
        "key",
        "seq",
        "op",
        *[F.try_variant_get("parsed_", f"$.{f}", "string").alias(f) for f in fields],
        *[F.coalesce(F.array_contains("keys_", f), F.lit(False)).alias(f"has_{f}") for f in fields],
    )
