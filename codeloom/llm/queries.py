"""The queries of this subpackage and the SQL that those expressible in SQL are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, chunking, credentials, lexing, mixing, pairs, provenance, terms
from codeloom.llm.syntax import syntax_rates, unparsable
from codeloom.session import ensure_checkpoint_dir, spread

#: Where p1 divides the snapshot into a first load and increments.
INCREMENTS = ("2026-01-01", "2026-03-01")
PIECE_LIMIT, PIECE_OVERLAP = 512, 64


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every name and tag with its occurrences, its records and, if it's of no use, why."""
    place = f"{ensure_checkpoint_dir(spark)}/term-counts-{uuid.uuid4().hex}"
    return terms.marked(terms.node_terms(_table(spark, folder, "nodes"), INCREMENTS, place))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark is not null").select("field", "term")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return unparsable(_table(spark, folder, "source_files")).select("repo_id", "file_path").distinct()


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax_rates(_table(spark, folder, "source_files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = provenance.classify(_table(spark, folder, "source_files"), _table(spark, folder, "third_party_files"))
    return kinds.where("kind is not null").select("repo_id", "file_path").distinct()


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = provenance.classify(_table(spark, folder, "source_files"), _table(spark, folder, "third_party_files"))
    return kinds.groupBy("repo_id", F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.paired(_table(spark, folder, "nodes"), _table(spark, folder, "source_files")).select("uuid")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.paired(_table(spark, folder, "nodes"), _table(spark, folder, "source_files"), code=True)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.found(_table(spark, folder, "source_files"), _table(spark, folder, "nodes"))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The files and metadata that held credentials, masked; the lines are those on which one began."""
    files = credentials.scan_files(_table(spark, folder, "source_files"), redacted=True)
    nodes = credentials.scan_metadata(_table(spark, folder, "nodes"), redacted=True)
    return files.select(
        F.lit("source_files").alias("source_table"), F.concat_ws(":", "repo_id", "file_path").alias("record_key"), "content"
    ).unionByName(nodes.select(F.lit("nodes").alias("source_table"), F.col("uuid").alias("record_key"), F.col("metadata").alias("content")))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(spread(_table(spark, folder, "documents").select("doc_id", "text")))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that come back differently, which should be none."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    back = bpe.decode(p8_ids(spark, folder)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("back")).select("doc_id")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    drawn, _ = mixing.mixture(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))
    return drawn.drop("q")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = _table(spark, folder, "mix_targets")
    drawn, _ = mixing.mixture(_table(spark, folder, "documents"), targets)
    return mixing.report(drawn, targets)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.split_oversized(spread(_table(spark, folder, "documents").select("doc_id", "text")), PIECE_LIMIT, PIECE_OVERLAP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_terms, p2_found, p2_rates, p3_found, p3_kinds, p4_found, p4_pairs, p7_found, p7_redacted,
        p8_ids, p8_decoded, p9_mixture, p9_shares, p10_pieces,
    )
}

_P1 = """
with entity as (
    select uuid, arg_max(name, created_at) as name, arg_max(tags, created_at) as tags from nodes where uuid is not null group by uuid
), term as (
    select 'name' as field, uuid, nfc_normalize(lower(trim(name, ' ' || chr(9) || chr(10) || chr(13)))) as term from entity
    union all
    select 'tags', uuid, nfc_normalize(lower(trim(t, ' ' || chr(9) || chr(10) || chr(13)))) from (select uuid, unnest(tags) as t from entity)
), counted as (
    select field, term, count(*) as occurrences, count(distinct uuid) as records from term where term <> '' group by field, term
), marked as (
    select *, case when records < 3 then 'rare' when records > 0.01 * (select count(*) from entity) then 'common' end as mark from counted
)
"""

SQL = {
    "p1_found": _P1 + "select field, term from marked where mark is not null",
    "p1_terms": _P1 + "select field, term, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records, mark from marked",
    "p8_decoded": "select doc_id from documents where false",
}
