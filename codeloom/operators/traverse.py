"""Neighbours, subgraphs, call trees and the context of an entity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import plain_path
from codeloom.operators.search import first_per_group
from codeloom.session import cut

TREE_TYPES = ("calls", "inherits", "uses")
GROUPS = {"imports": "imported_by", "calls": "called_by", "uses": "used_by", "inherits": "inherited_by"}


def neighbours(links: DataFrame, nodes: DataFrame, uuid: str, direction: str = "both", type: str | None = None, limit: int | None = None) -> DataFrame:  # noqa: A002
    """Entities next to one: "out", "in" or both, each once, by uuid. An unknown entity has none."""
    if type is not None:
        links = links.where(F.col("type") == type)
    parts = []
    if direction in ("out", "both"):
        parts.append(links.where(F.col("src") == uuid).select(F.col("dst").alias("uuid")))
    if direction in ("in", "both"):
        parts.append(links.where(F.col("dst") == uuid).select(F.col("src").alias("uuid")))
    ids = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    met = nodes.join(ids.distinct(), "uuid", "left_semi")
    return met if limit is None else met.orderBy("uuid").limit(limit)


def links_of(links: DataFrame, uuid: str, direction: str = "both") -> DataFrame:
    """The links of an entity; a self-loop comes twice for both directions."""
    out, into = links.where(F.col("src") == uuid), links.where(F.col("dst") == uuid)
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


#: Links, or what gives those with one end ("src" or "dst") among ids (uuid) without reading more than that takes.
Links = DataFrame | Callable[[DataFrame, str], DataFrame]


def links_at(links: Links, ids: DataFrame, end: str) -> DataFrame:
    if callable(links):
        return links(ids, end)
    return links.join(ids.select(F.col("uuid").alias(end)), end, "left_semi")


def reach(links: Links, roots: DataFrame, depth: int) -> DataFrame:
    """(uuid, depth): what the roots (uuid) reach over outgoing links in at most `depth` steps.

    A step reads the links of the frontier; the frontier, not the links, is written, and known entities are dropped.
    """
    frontier = seen = cut(roots.select("uuid", F.lit(0).alias("depth")).distinct())
    for step in range(1, depth + 1):
        found = links_at(links, frontier, "src").select(F.col("dst").alias("uuid")).distinct()
        frontier = cut(found.join(seen, "uuid", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def induced(links: Links, ids: DataFrame) -> DataFrame:
    """The links with both ends among ids (uuid)."""
    return links_at(links, ids, "src").join(ids.select(F.col("uuid").alias("dst")), "dst", "left_semi")


def subgraph(links: Links, root: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entities with depth, links among them) around the entities of root (uuid)."""
    ids = reach(links, root, depth)
    return ids, induced(links, ids)


def call_tree(links: DataFrame, roots: DataFrame, depth: int = 3, children: int = 5, direction: str = "out", types: Sequence[str] = TREE_TYPES) -> DataFrame:
    """(root, path, depth, uuid, parent): the simple paths from each root (root), flat.

    Each entity takes part with its first `children` links by uuid; a child already on the path takes its place but
    yields no row. direction "both" gives the root only.
    """
    typed = links.where(F.col("type").isin(*types))
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    steps = cut(first_per_group(typed.select(F.col(a).alias("uuid"), F.col(b).alias("child")).distinct(), ["uuid"], ["child"], children))
    level = roots.select("root", F.array("root").alias("path"), F.lit(0).alias("depth"), F.col("root").alias("uuid"), F.lit(None).cast("string").alias("parent"))
    rows = level
    for d in range(1, depth + 1 if direction != "both" else 1):
        met = level.join(steps, "uuid").where(~F.array_contains("path", F.col("child")))
        level = met.select("root", F.array_append("path", F.col("child")).alias("path"), F.lit(d).alias("depth"), F.col("child").alias("uuid"), F.col("uuid").alias("parent"))
        rows = rows.unionByName(level)
    return rows


def dependencies(links: DataFrame, nodes: DataFrame, ids: DataFrame, incoming: bool = False) -> DataFrame:
    """(id, kind, uuid, name) of the four kinds of outgoing links of ids (id), or, incoming, of who links to them."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    typed = links.where(F.col("type").isin(*GROUPS))
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(v if incoming else k)) for k, v in GROUPS.items()])
    met = typed.join(ids.withColumnRenamed("id", a), a, "left_semi").select(F.col(a).alias("id"), kind.alias("kind"), F.col(b).alias("uuid"))
    return met.join(nodes.select("uuid", "name"), "uuid").select("id", "kind", "uuid", "name")


def lines(content: Column | str) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def between(rows: Column, first: Column, last: Column) -> Column:
    """The lines first to last, from 1, as one text; cut to what there is."""
    low = F.greatest(first, F.lit(1))
    n = F.least(last, F.size(rows)) - low + 1
    return F.array_join(F.slice(rows, low, F.greatest(n, F.lit(0))), "\n")


def texts(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, l_): each file once, with its lines. Split before any join, so once per file and not for
    each of its entities."""
    whole = files.groupBy("repo_id", plain_path("file_path").alias("file_path")).agg(F.first("content", ignorenulls=True).alias("content"))
    return whole.where("content is not null").select("repo_id", "file_path", lines("content").alias("l_"))


def snippets(nodes: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
    """(uuid, before, code, after, signature, imports): the code of entities with the lines around it.

    Only entities with lines whose file is in the table; the signature is the first line and up to five more until one
    has a colon; imports are the trimmed lines of the code that begin with import or from.
    """
    wanted = nodes.where("start_line is not null and end_line is not null").select("uuid", "repo_id", "file_path", "start_line", "end_line")
    rows = wanted.join(texts(files), ["repo_id", "file_path"]).where(F.col("start_line") <= F.size("l_"))
    s, e = F.col("start_line"), F.col("end_line")
    head = F.slice("l_", F.greatest(s, F.lit(1)), F.lit(6))
    grown = F.aggregate(
        head,
        F.struct(F.lit("").alias("t"), F.lit(False).alias("done")),
        lambda a, x: F.struct(F.when(a["done"], a["t"]).otherwise(F.concat_ws(" ", F.when(a["t"] != "", a["t"]), F.trim(x))).alias("t"), (a["done"] | x.contains(":")).alias("done")),
    )
    code = between(F.col("l_"), s, e)
    brought = F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("import ") | x.startswith("from "))
    return rows.select(
        "uuid",
        between(F.col("l_"), s - around, s - 1).alias("before"),
        code.alias("code"),
        between(F.col("l_"), e + 1, e + around).alias("after"),
        grown["t"].alias("signature"),
        F.array_join(brought, "\n").alias("imports"),
    )


def context(nodes: DataFrame, links: DataFrame, files: DataFrame, ids: DataFrame, most: int = 10) -> DataFrame:
    """(uuid, name, code, neighbours, n_links, links) of the entities among ids (uuid): up to `most` neighbours by uuid.

    links: how many links of each kind lead out or in ("calls>", "<uses"), by kind. Ids that are no entities are dropped.
    """
    own = nodes.join(ids, "uuid", "left_semi")
    touching = F.explode(F.array(F.struct(F.col("src").alias("uuid"), F.col("dst").alias("other"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("uuid"), F.col("src").alias("other"), F.lit(False).alias("out")))).alias("t")
    pairs = links.select("type", touching).select("type", "t.*").join(ids, "uuid", "left_semi")
    known = pairs.select("uuid", "other").distinct().join(nodes.select(F.col("uuid").alias("other")), "other", "left_semi")
    near = first_per_group(known, ["uuid"], ["other"], most).groupBy("uuid").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))
    kind = F.when(F.col("out"), F.concat(F.coalesce("type", F.lit("unknown")), F.lit(">"))).otherwise(F.concat(F.lit("<"), F.coalesce("type", F.lit("unknown"))))
    kinds = pairs.groupBy("uuid", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    said = F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string"))))
    count = kinds.groupBy("uuid").agg(F.sum("n").alias("n_links"), said.alias("links"))
    code = snippets(own, files, 0).select("uuid", "code")
    rows = own.select("uuid", "name").join(code, "uuid", "left").join(near, "uuid", "left").join(count, "uuid", "left")
    return rows.select("uuid", "name", "code", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("neighbours", "links")], F.coalesce("n_links", F.lit(0)).alias("n_links"))


def entity_at(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, uuid): the entity with the tightest lines around each place; bucketed interval join."""
    width = 128
    bucket = lambda c: (F.col(c) / width).cast("int")
    spans = nodes.where("start_line is not null and end_line >= start_line").select(
        "repo_id", "file_path", "uuid", "start_line", "end_line", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("bucket")
    )
    met = places.withColumn("bucket", bucket("line")).join(spans, ["repo_id", "file_path", "bucket"]).where("line between start_line and end_line")
    tightest = F.min(F.struct(F.col("end_line") - F.col("start_line"), "uuid"))["uuid"]
    return met.groupBy("repo_id", "file_path", "line").agg(tightest.alias("uuid"))
