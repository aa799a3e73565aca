"""Creating, updating and deleting entities and links: each returns the new tables and the audit rows to append."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema

EDITABLE = ("name", "type", "file_path", "start_line", "end_line", "docstring", "tags", "metadata")


def audit(spark, action: str, entity_type: str, ids: DataFrame, user: str, at, details: Mapping | None = None) -> DataFrame:
    """One audit row for each of ids (uuid), with an id that follows from what it says."""
    said = json.dumps(dict(details), sort_keys=True) if details is not None else None
    rows = ids.select(
        F.sha2(F.concat_ws("|", F.lit(action), F.col("uuid"), F.lit(str(at)), F.lit(user)), 256).alias("uuid"),
        F.lit(at).cast("timestamp_ntz").alias("timestamp"),
        F.lit(user).alias("user"),
        F.lit(action).alias("action"),
        F.lit(entity_type).alias("entity_type"),
        F.col("uuid").alias("entity_uuid"),
        F.lit(said).cast("string").alias("details"),
    )
    return rows


def create(nodes: DataFrame, new: DataFrame, user: str, at) -> tuple[DataFrame, DataFrame]:
    """Add entities made by hand; columns that `new` lacks are null, a uuid that exists is merged over the old row."""
    columns = [F.col(c) if c in new.columns else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]
    rows = new.select(*columns).withColumn("manual", F.lit(True)).withColumn("created_at", F.coalesce("created_at", F.lit(at).cast("timestamp_ntz"))).withColumn("created_by", F.coalesce("created_by", F.lit(user)))
    old = nodes.join(rows.select("uuid"), "uuid", "left_anti")
    return old.unionByName(rows), audit(nodes.sparkSession, "create_entity", "node", rows, user, at)


def update(nodes: DataFrame, uuid: str, patch: Mapping, user: str, at, skip_nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Overwrite the given fields of one entity and add to its history. Unknown fields are ignored; with skip_nulls a
    null leaves the field as it is. An unknown uuid changes nothing and has no audit row."""
    given = {k: v for k, v in patch.items() if k in EDITABLE and not (skip_nulls and v is None)}
    hit = F.col("uuid") == uuid
    changes = {}
    for k, v in given.items():
        value = F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        changes[k] = F.when(hit, value.cast(nodes.schema[k].dataType)).otherwise(F.col(k))
    entry = F.struct(F.lit(at).cast("timestamp_ntz").alias("timestamp"), F.lit("update").alias("action"), F.lit(json.dumps(given, sort_keys=True, default=str)).alias("changes"))
    history = F.coalesce("history", F.array().cast(schema.HISTORY))
    changes["history"] = F.when(hit, F.concat(history, F.array(entry).cast(schema.HISTORY))).otherwise(F.col("history"))
    return nodes.withColumns(changes), audit(nodes.sparkSession, "update_entity", "node", nodes.where(hit), user, at, given)


def delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame, user: str, at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the entities of ids (uuid) and without the links at either end of them."""
    kept = nodes.join(ids, "uuid", "left_anti")
    links = edges.join(ids.select(F.col("uuid").alias("from_uuid")), "from_uuid", "left_anti").join(ids.select(F.col("uuid").alias("to_uuid")), "to_uuid", "left_anti")
    return kept, links.select(*edges.columns), audit(nodes.sparkSession, "delete_entity", "node", nodes.join(ids, "uuid", "left_semi"), user, at)


def relate(nodes: DataFrame, edges: DataFrame, new: DataFrame, user: str, at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, rejected, audit): links whose ends both exist are put in, over an older one of the same pair; the others
    are rejected."""
    known = nodes.select(F.col("uuid").alias("k_")).distinct()
    ok = new.join(known, F.col("from_uuid") == F.col("k_"), "left_semi").join(known, F.col("to_uuid") == F.col("k_"), "left_semi")
    rejected = new.join(ok.select("from_uuid", "to_uuid").distinct(), ["from_uuid", "to_uuid"], "left_anti")
    columns = [F.col(c) if c in new.columns else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns]
    rows = ok.select(*columns).withColumn("manual", F.lit(True)).withColumn("created_at", F.coalesce("created_at", F.lit(at).cast("timestamp_ntz")))
    old = edges.join(rows.select("from_uuid", "to_uuid"), ["from_uuid", "to_uuid"], "left_anti").select(*edges.columns)
    return old.unionByName(rows), rejected, audit(nodes.sparkSession, "create_relation", "edge", rows, user, at)
