"""Filtered, fuzzy and ranked search over entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import SIMILAR, can_be_similar, exact_score, relevance, similarity


def index(nodes: DataFrame, whole_doc: bool = True) -> DataFrame:
    """The slim table searches read: uuid, name, type, file_path, start_line, tags, short_doc."""
    doc = F.col("docstring") if whole_doc else F.element_at(F.split("docstring", "\n"), 1)
    return nodes.select("uuid", "repo_id", "name", "type", "file_path", "start_line", "tags", F.substring(doc, 1, 100).alias("short_doc"))


def filtered(rows: DataFrame, type: str | None = None, path: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:  # noqa: A002
    """Entities of the type, whose path contains `path` and which have any of the tags; what is None doesn't filter."""
    if type is not None:
        rows = rows.where(F.col("type") == type)
    if path is not None:
        rows = rows.where(F.col("file_path").contains(path))
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return rows


def fuzzy(rows: DataFrame, name: str) -> DataFrame:
    """rows with score: exact, prefix, part, or half the similarity where that is large enough; others are dropped.

    Only distinct names that none of the first three fits, and whose length and letters allow it, are compared, in Arrow
    batches.
    """
    scored = rows.withColumn("score", exact_score(F.col("name"), name))
    near = scored.where("score is not null")
    rest = scored.where(F.col("score").isNull() & can_be_similar(F.col("name"), F.lit(name))).drop("score")
    ratios = rest.select("name").distinct().withColumn("ratio", similarity("name", F.lit(name))).where(F.col("ratio") >= SIMILAR)
    matched = rest.join(ratios, "name").withColumn("score", F.col("ratio") * 0.5).select(*rows.columns, "score")
    return near.unionByName(matched)


def search(rows: DataFrame, name: str | None = None, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Filter, match the name, rank by relevance, then score, then uuid, and give one page."""
    found = filtered(rows, **filters)
    found = fuzzy(found, name) if name else found.withColumn("score", F.lit(1.0))
    ranked = found.withColumn("relevance", relevance(F.col("type"), F.col("docstring"), F.col("tags"), F.col("file_path")))
    return ranked.orderBy(F.desc("relevance"), F.desc("score"), "uuid").offset(offset).limit(limit)


def autocomplete(rows: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """The first `limit` distinct entities, by uuid, whose name starts with prefix regardless of case; by name."""
    found = rows.where(F.lower("name").startswith(prefix.lower())).select("uuid", "name", "type")
    return found.orderBy("uuid").limit(limit).orderBy("name", "uuid")


def _similar(pairs: DataFrame, a: str, b: str, sure: Column) -> DataFrame:
    """The rows of pairs, whose columns a and b are distinct together, that are sure or similar; only those that could be
    and aren't sure are compared."""
    rows = pairs.withColumn("sure_", F.coalesce(sure, F.lit(False))).where(F.col("sure_") | can_be_similar(F.col(a), F.col(b)))
    ratio = similarity(F.when(~F.col("sure_"), F.col(a)), F.col(b))
    return rows.withColumn("ratio_", ratio).where("sure_ or ratio_ >= %s" % SIMILAR).drop("sure_", "ratio_")


def probable(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, uuid) for requests "file:name" or "name": names equal, containing or similar, in files likewise.

    requests is a bounded list (a person's input) and is broadcast. Names and paths are compared once per distinct value.
    """
    asked = requests.select(
        "request",
        F.when(F.col("request").contains(":"), F.regexp_extract("request", "^([^:]*):", 1)).otherwise("").alias("in_file"),
        F.when(F.col("request").contains(":"), F.regexp_extract("request", "^[^:]*:(.*)$", 1)).otherwise(F.col("request")).alias("wanted"),
    )
    names = rows.select("name").where("name is not null").distinct().join(F.broadcast(asked.select("wanted").distinct()))
    named = _similar(names, "name", "wanted", (F.col("name") == F.col("wanted")) | F.lower("name").contains(F.lower("wanted")))
    met = rows.select("uuid", "name", "file_path").join(named, "name").join(F.broadcast(asked), "wanted")
    anywhere = met.where("in_file = ''").select("request", "uuid")
    there = met.where("in_file <> ''")
    paths = there.select("file_path", "in_file").distinct()
    near = _similar(paths, "file_path", "in_file", F.col("file_path").contains(F.col("in_file")))
    return anywhere.unionByName(there.join(near, ["file_path", "in_file"], "left_semi").select("request", "uuid"))


def page(rows: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    """One page with `total`, the number of rows before paging.

    The total is a second aggregation, so the page itself stays a bounded top-k.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def relations_page(links: DataFrame, type: str | None = None, src: str | None = None, dst: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:  # noqa: A002
    for column, value in (("type", type), ("src", src), ("dst", dst)):
        if value is not None:
            links = links.where(F.col(column) == value)
    return page(links, ["src", "dst"], limit, offset)


def first_per_group(rows: DataFrame, group: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    """The first n rows of each group; the limit is applied before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("r_", rank).where(F.col("r_") <= n).drop("r_")
