"""The graph of the stored tables: one row per entity and one per ordered pair of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.paths import plain_path
from codeloom.operators.skew import canonical_id


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; the ranking's limit is applied before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def entities(nodes: DataFrame) -> DataFrame:
    """One row per entity: canonical uuid, plain path, lower-case type, trimmed name. Rows without uuid are skipped."""
    rows = nodes.where("uuid is not null").select(
        canonical_id("uuid").alias("uuid"),
        "repo_id",
        plain_path("file_path").alias("file_path"),
        F.lower(F.trim("type")).alias("type"),
        F.trim("name").alias("name"),
        "start_line",
        "end_line",
        "docstring",
        "tags",
        "metadata",
        "created_by",
        "created_at",
        "manual",
    )
    return last_wins(rows, ["uuid"], [F.desc("created_at")])


def relations(edges: DataFrame) -> DataFrame:
    """One row per ordered pair, the last one written: src, dst, type, uuid, created_at. Null ends are skipped."""
    rows = edges.where("from_uuid is not null and to_uuid is not null").select(
        canonical_id("from_uuid").alias("src"), canonical_id("to_uuid").alias("dst"), F.lower(F.trim("type")).alias("type"), "uuid", "created_at", "properties"
    )
    return last_wins(rows, ["src", "dst"], [F.desc("created_at"), F.desc("uuid")])


def relations_at(edges: DataFrame, ids: DataFrame, end: str) -> DataFrame:
    """relations(edges) with the end "src" or "dst" among ids (uuid), which are sought before pairs are compared: all rows of
    a pair have that end."""
    column = {"src": "from_uuid", "dst": "to_uuid"}[end]
    near = edges.withColumn("k_", canonical_id(column)).join(ids.select(F.col("uuid").alias("k_")), "k_", "left_semi")
    return relations(near.drop("k_"))


def ends(links: DataFrame) -> DataFrame:
    """(uuid, n_out, n_in) of everything that is an end of a link; a self-loop counts in both."""
    both = F.explode(F.array(F.struct(F.col("src").alias("uuid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("uuid"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return links.select(both.alias("e")).select("e.*").groupBy("uuid").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Every entity with n_out, n_in and degree; 0 for isolated ones."""
    met = nodes.join(ends(links), "uuid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return met.select(*nodes.columns, zero("n_out"), zero("n_in")).withColumn("degree", F.col("n_out") + F.col("n_in"))


def by_repo(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """links with the repo_id of their source entity; links of unknown sources are left out."""
    home = nodes.select(F.col("uuid").alias("src"), "repo_id")
    return links.join(home, "src")
