"""The registry of named queries: name -> function of (session, folder of the tables)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names
from codeloom.functions.paths import module_name, plain_path, relative_path
from codeloom.operators import changefeed, graph, graphalg, ingest, language, metrics, mutate, orphans, patterns, reach, rules, search, semantic, traverse
from codeloom.operators.skew import canonical_id
from codeloom.session import cut, ensure_checkpoint_dir
from codeloom.sources import files as source_files
from codeloom.sources import store
from codeloom.sources.versions import Versions
from codeloom.streaming import audit as audit_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Where p5 divides the rows into increments.
INCREMENTS = ("2025-09-01", "2026-01-01")
#: When p5_snapshots counts.
SNAPSHOTS = ("2025-07-01", "2025-10-01", "2026-01-01", "2026-04-01")
#: Up to when p6 takes the feed for its base.
BASE_UNTIL = "2026-04-01"
ENTITY_FIELDS = ("name", "file_path")


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run in the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _orphans(spark: SparkSession, folder: str) -> orphans.OrphanState:
    kept = Versions(spark, own_folder(spark, "orphans"))
    return orphans.run_increments(table(spark, folder, "edges"), table(spark, folder, "nodes"), INCREMENTS, kept=kept)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).pending.selectExpr("ref_id as uuid", "endpoint").distinct()


@query
def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per endpoint and month, and how many of them still wait for their entity."""
    return orphans.counts(_orphans(spark, folder))


@query
def p5_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """What p5_counts gives, as of several times, with the deletions of the audit log reopening references."""
    kept = Versions(spark, own_folder(spark, "orphans"))
    edges, nodes, audit = (table(spark, folder, t) for t in ("edges", "nodes", "audit"))
    orphans.run_increments(edges, nodes, SNAPSHOTS[:-1], audit, kept, snapshots=True, until=SNAPSHOTS[-1])
    return orphans.history(kept)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The feed up to the snapshot gives the base, into which the changes since then are merged."""
    changes = cut(changefeed.deduplicated(changefeed.audit_changes(table(spark, folder, "audit"), ENTITY_FIELDS)))
    since = F.col("seq") >= F.lit(BASE_UNTIL).cast("timestamp_ntz")
    base = changefeed.apply_changes(changes.where(~since), ENTITY_FIELDS, distinct=True)
    return changefeed.apply_changes(changes.where(since), ENTITY_FIELDS, base, distinct=True).withColumnRenamed("key", "entity_uuid")


# ------------------------------------------------------------------------------------------------ the graph's tables


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.entities(table(spark, folder, "nodes"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return graph.relations(table(spark, folder, "edges"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Each file once; rows that came twice are equal."""
    return table(spark, folder, "source_files").dropDuplicates(["repo_id", "file_path"])


def _hub(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(uuid) of the known entity with the most incoming links: where traversals start. A top one of aggregated counts."""
    ids = nodes.select("uuid").distinct()
    into = links.groupBy(F.col("dst").alias("uuid")).agg(F.count(F.lit(1)).alias("n_in"))
    return ids.join(into, "uuid", "left").orderBy(F.desc_nulls_last("n_in"), "uuid").limit(1).select("uuid")


def _hub_of(spark: SparkSession, folder: str) -> DataFrame:
    """The hub, written, so that what starts from it doesn't search it again."""
    ids = table(spark, folder, "nodes").where("uuid is not null").select(canonical_id("uuid").alias("uuid"))
    return cut(_hub(ids, _links(spark, folder)))


def _hub_id(spark: SparkSession, folder: str) -> str:
    row = _hub_of(spark, folder).first()
    return row[0] if row else ""


def _links_at(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    return lambda ids, end: graph.relations_at(table(spark, folder, "edges"), ids, end)


def both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: f(_nodes(spark, folder), _links(spark, folder))


def named(name: str, f: Query) -> None:
    QUERIES[name] = f


# ------------------------------------------------------------------------------------------------ figures

named("node_type_distribution", lambda s, d: metrics.type_counts(_nodes(s, d)))
named("edge_type_distribution", lambda s, d: metrics.type_counts(_links(s, d)))
named("extension_distribution", lambda s, d: metrics.ending_counts(_nodes(s, d)))
named("repository_sizes", both(metrics.sizes))
named("degree_top10", both(metrics.most_connected))
named("complexity_top20", both(metrics.complexity_top))
named("complexity_histogram", both(metrics.complexity_histogram))
named("high_dependency_functions", both(metrics.high_dependency))
named("class_members", lambda s, d: metrics.containing_class(_nodes(s, d)).select("uuid", "class_uuid"))
named("god_classes", lambda s, d: metrics.god_classes(_nodes(s, d), most=3))
named("fan_in_out_issues", both(metrics.fan_issues))
named("dependency_summary", both(metrics.dependency_summary))
named("most_depended", both(lambda n, e: metrics.most_depended(n, e, "n_in")))
named("most_dependent", both(lambda n, e: metrics.most_depended(n, e, "n_out")))
named("language_distribution", lambda s, d: metrics.language_counts(_nodes(s, d)))
named("language_summary", lambda s, d: metrics.language_summary(_nodes(s, d)))
named("quality_metrics", both(metrics.quality))
named("quality_scores", both(metrics.quality_scores))
named("quality_scores_compact", both(lambda n, e: metrics.quality_scores(n, e, compact=True)))
named("quality_rounded", both(lambda n, e: metrics.rounded(metrics.quality_scores(n, e))))
named("quality_recommendations", both(metrics.recommendations))
named("repository_components", both(metrics.repository_components))


@query
def impact_summary(spark: SparkSession, folder: str) -> DataFrame:
    nodes, links = _nodes(spark, folder), _links(spark, folder)
    return metrics.impact(links, nodes, _hub(nodes, links).withColumnRenamed("uuid", "target"))


@query
def affected_files(spark: SparkSession, folder: str) -> DataFrame:
    nodes, links = _nodes(spark, folder), _links(spark, folder)
    return metrics.affected_files(links, nodes, _hub(nodes, links).withColumnRenamed("uuid", "target"))


@query
def affected_entities(spark: SparkSession, folder: str) -> DataFrame:
    nodes, links = _nodes(spark, folder), _links(spark, folder)
    return metrics.affected_entities(links, nodes, _hub(nodes, links).withColumnRenamed("uuid", "target"))


# ------------------------------------------------------------------------------------------------ search and pages

_PAGE = ("uuid", "name", "type", "file_path")


@query
def search_filters(spark: SparkSession, folder: str) -> DataFrame:
    return search.filtered(_nodes(spark, folder), type="function", path="core/", tags=["ASYNC", "UTILITY"]).select(*_PAGE)


@query
def search_relevance(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(_nodes(spark, folder), limit=50, offset=10, type="class")
    return found.select("uuid", "name", F.round("relevance", 6).alias("relevance"))


@query
def search_exact_name(spark: SparkSession, folder: str) -> DataFrame:
    """Names equal to, beginning with or containing a word, by score."""
    rows = _nodes(spark, folder).withColumn("score", names.exact_score(F.col("name"), "load"))
    return rows.where("score is not null").select("uuid", "name", "score")


@query
def search_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(_nodes(spark, folder), name="load_config", limit=100).select("uuid", "name", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query
def autocomplete(spark: SparkSession, folder: str) -> DataFrame:
    return search.autocomplete(_nodes(spark, folder), "par", 20)


@query
def probable_names(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame([("utils.py:load_config",), ("validate",), ("types:render_theme",)], "request string")
    return search.probable(_nodes(spark, folder), asked)


@query
def entity_index(spark: SparkSession, folder: str) -> DataFrame:
    return search.index(_nodes(spark, folder)).select("uuid", "name", "type", "file_path", "start_line", "short_doc")


@query
def entities_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.filtered(_nodes(spark, folder), type="method").select(*_PAGE)
    return search.page(rows, ["uuid"], 50, 100)


@query
def entity_by_id(spark: SparkSession, folder: str) -> DataFrame:
    nodes, links = _nodes(spark, folder), _links(spark, folder)
    return nodes.join(_hub(nodes, links), "uuid", "left_semi").select(*_PAGE)


@query
def relations_page(spark: SparkSession, folder: str) -> DataFrame:
    return search.relations_page(_links(spark, folder), type="calls", limit=50, offset=20).select("src", "dst", "type", "total")


@query
def repositories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nodes").select("repo_id").distinct()


@query
def auto_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = _nodes(spark, folder)
    return rows.select("uuid", F.array_join(names.auto_tags(F.col("name"), F.col("type")), ",").alias("tags"))


@query
def file_priority(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return files.select("repo_id", "file_path", names.priority(F.col("file_path"), F.col("n_bytes")).alias("priority"))


@query
def file_priority_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The first four fifths, by priority, of the files of every repository of more than five."""
    return source_files.prioritised(_files(spark, folder), large=5, least=3).select("repo_id", "file_path", "priority")


@query
def relative_paths(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.concat(F.lit("file:///data/trees/"), F.col("file_path"))
    return _files(spark, folder).select("repo_id", "file_path", relative_path(whole, "/data/trees/").alias("relative"))


named("module_names", lambda s, d: _files(s, d).select("repo_id", "file_path", module_name("file_path").alias("module")))


@query
def analysed_files(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).where(source_files.wanted(F.col("file_path"))).select("repo_id", "file_path")


@query
def repository_size_class(spark: SparkSession, folder: str) -> DataFrame:
    n = _files(spark, folder).groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    return n.withColumn("size", source_files.size_class(F.col("files")))


@query
def link_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).groupBy("dst").agg(F.round(F.sum(names.link_weight(F.col("type"))), 6).alias("weight"))


@query
def ranking_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored link with its weight, repeated ones too, as a ranking takes them."""
    rows = table(spark, folder, "edges").where("from_uuid is not null and to_uuid is not null")
    return rows.select(canonical_id("from_uuid").alias("src"), canonical_id("to_uuid").alias("dst"), names.link_weight(F.lower(F.trim("type"))).alias("weight"))


@query
def importance_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The heuristic rank of the stored entities, from stored links."""
    nodes, links = _nodes(spark, folder), _links(spark, folder)
    calls = links.where("type = 'calls'").join(nodes.select(F.col("uuid").alias("dst"), "repo_id", "name"), "dst").groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("calls"))
    return ingest.ranked(nodes, links, calls).select("uuid", F.round("importance", 6).alias("importance"))


# ------------------------------------------------------------------------------------------------ traversal


@query
def neighbors_both(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.neighbours(_links(spark, folder), _nodes(spark, folder), _hub_id(spark, folder)).select(*_PAGE)


@query
def edges_for_node(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.links_of(_links(spark, folder), _hub_id(spark, folder)).select("src", "dst", "type")


@query
def subgraph_bfs(spark: SparkSession, folder: str) -> DataFrame:
    ids, _ = traverse.subgraph(_links_at(spark, folder), _hub_of(spark, folder), 3)
    return ids


@query
def subgraph_links(spark: SparkSession, folder: str) -> DataFrame:
    _, links = traverse.subgraph(_links_at(spark, folder), _hub_of(spark, folder), 3)
    return links.select("src", "dst", "type")


@query
def call_tree(spark: SparkSession, folder: str) -> DataFrame:
    roots = _hub(_nodes(spark, folder), _links(spark, folder)).withColumnRenamed("uuid", "root")
    rows = traverse.call_tree(_links(spark, folder), roots, 4)
    return rows.select(F.array_join("path", ">").alias("path"), "depth", "uuid", "parent")


@query
def caller_tree(spark: SparkSession, folder: str) -> DataFrame:
    roots = _hub(_nodes(spark, folder), _links(spark, folder)).withColumnRenamed("uuid", "root")
    rows = traverse.call_tree(_links(spark, folder), roots, 3, direction="in")
    return rows.select(F.array_join("path", ">").alias("path"), "depth", "uuid", "parent")


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).where("type = 'class'").select(F.col("uuid").alias("id"))


named("dependencies_by_type", lambda s, d: traverse.dependencies(_links(s, d), _nodes(s, d), _classes(s, d)))
named("dependents_by_type", lambda s, d: traverse.dependencies(_links(s, d), _nodes(s, d), _classes(s, d), incoming=True))


@query
def entity_context(spark: SparkSession, folder: str) -> DataFrame:
    nodes, links = _nodes(spark, folder), _links(spark, folder)
    ids = nodes.where("type = 'endpoint'").select("uuid")
    rows = traverse.context(nodes, links, table(spark, folder, "source_files"), ids)
    return rows.select("uuid", "name", "code", *[F.array_join(c, ",").alias(c) for c in ("neighbours", "links")], "n_links")


@query
def code_snippets(spark: SparkSession, folder: str) -> DataFrame:
    rows = traverse.snippets(_nodes(spark, folder), table(spark, folder, "source_files"))
    return rows.select("uuid", "before", "code", "after", "imports")


@query
def signatures(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder).where("type in ('function', 'method')")
    return traverse.snippets(nodes, table(spark, folder, "source_files"), 0).select("uuid", "signature")


@query
def entity_at_line(spark: SparkSession, folder: str) -> DataFrame:
    """The tightest entity around every line of every file."""
    sizes = _files(spark, folder).where("content is not null").select("repo_id", plain_path("file_path").alias("file_path"), F.size(traverse.lines("content")).alias("n"))
    sizes = sizes.groupBy("repo_id", "file_path").agg(F.max("n").alias("n"))
    places = sizes.select("repo_id", "file_path", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("line"))
    return traverse.entity_at(_nodes(spark, folder), places)


# ------------------------------------------------------------------------------------------------ graph algorithms

#: From how many pivots the estimates of path measures start.
PIVOTS = 256


@query
def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    ranks = graphalg.pagerank(_links(spark, folder), _nodes(spark, folder))
    return ranks.select("uuid", F.round(F.col("rank") * 1e6, 3).alias("rank_per_million"))


def _whole(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All links, and all entities with the unknown ends of links, as the reference's graph has them."""
    links = cut(_links(spark, folder).select("src", "dst"))
    known = table(spark, folder, "nodes").where("uuid is not null").select(canonical_id("uuid").alias("uuid"))
    ids = known.unionByName(links.select(F.explode(F.array("src", "dst")).alias("uuid"))).distinct()
    return links, cut(ids)


@query
def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    links, ids = _whole(spark, folder)
    rows = reach.paths(links, ids) if reach.fits(links, ids) else graphalg.shortest_paths(links, ids)
    return rows.where("depth > 0").select("source", "uuid", "depth", "paths")


def _millionths(column: str) -> Column:
    return F.round(F.col(column) * 1e6, 3).alias(f"{column}_millionths")


@query
def closeness(spark: SparkSession, folder: str) -> DataFrame:
    links, ids = _whole(spark, folder)
    return graphalg.closeness(links, ids).select("uuid", _millionths("closeness"))


@query
def betweenness(spark: SparkSession, folder: str) -> DataFrame:
    links, ids = _whole(spark, folder)
    return graphalg.betweenness(links, ids).select("uuid", _millionths("betweenness"))


@query
def hotspots(spark: SparkSession, folder: str) -> DataFrame:
    links, ids = _whole(spark, folder)
    top = graphalg.hotspots(links, ids)
    about = _nodes(spark, folder).select("uuid", "name", "type", "file_path")
    figures = [_millionths(c) for c in ("score", "betweenness", "closeness", "rank", "average")]
    return top.join(about, "uuid", "left").select("uuid", "name", "type", "file_path", "connections", *figures)


@query
def betweenness_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """From a sample of pivots: the way for graphs of any size."""
    links, ids = _whole(spark, folder)
    return graphalg.betweenness(links, ids, sources=PIVOTS).select("uuid", _millionths("betweenness"))


@query
def hotspots_estimate(spark: SparkSession, folder: str) -> DataFrame:
    links, ids = _whole(spark, folder)
    return graphalg.hotspots(links, ids, sources=PIVOTS).select("uuid", "connections", *[_millionths(c) for c in ("score", "betweenness", "closeness", "rank")])


@query
def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    """Of all links and entities: how many components there are of each size."""
    sizes = graphalg.strong_components(*_whole(spark, folder)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query
def import_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Circuits of any length over imports and dependencies."""
    links = _links(spark, folder).where("type in ('imports', 'depends_on')")
    return graphalg.cycles(links, None).select(F.array_join("path", ">").alias("path"), "length", "severity")


@query
def dependency_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Circuits of any length over imports, dependencies and uses."""
    links = _links(spark, folder).where("type in ('imports', 'depends_on', 'uses')")
    return graphalg.cycles(links, None).select(F.array_join("path", ">").alias("path"), "length", "severity")


@query
def link_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Circuits of at most four links over links of all types."""
    return graphalg.cycles(_links(spark, folder), 4).select(F.array_join("path", ">").alias("path"), "length", "severity")


# ------------------------------------------------------------------------------------------------ text

_MATCH = ("rule_id", "severity", "repo_id", "file_path", "line", "column", "matched")


def _rule(*ids: str) -> Query:
    """Every match over whole texts."""
    return lambda s, d: rules.matches(table(s, d, "source_files"), [r for r in rules.RULES if r.id in ids]).select(*_MATCH)


named("rule_long_lines", _rule("long_lines"))
named("rule_var", _rule("js_var_usage"))
named("rule_todo", _rule("todo_comments"))
named("rule_secrets", _rule("hardcoded_secret"))
named("rule_semicolons", _rule("js_missing_semicolon"))
named("rule_complex", _rule("complex_function"))


@query
def rule_bare_except(spark: SparkSession, folder: str) -> DataFrame:
    """Over files in which what "except (TypeError, ValueError)" names is left out, as the tables have no bare except."""
    files = table(spark, folder, "source_files").withColumn("content", F.replace("content", F.lit(" (TypeError, ValueError)"), F.lit("")))
    return rules.matches(files, [r for r in rules.RULES if r.id == "python_bare_except"]).select(*_MATCH)


@query
def rule_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All rules, those over several lines and the callables too: matches per rule and repository."""
    return rules.matches(table(spark, folder, "source_files")).groupBy("rule_id", "severity", "repo_id").agg(F.count(F.lit(1)).alias("matches"))


@query
def language_detection(spark: SparkSession, folder: str) -> DataFrame:
    rows = language.detect(_files(spark, folder))
    return rows.select("repo_id", "file_path", "language", F.round("confidence", 6).alias("confidence"), "method")


named("python_figures", lambda s, d: language.figures(_files(s, d), "python"))
named("javascript_figures", lambda s, d: language.figures(_files(s, d), "javascript"))
named("language_capabilities", lambda s, d: language.capabilities(s))


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.with_code(_nodes(spark, folder), table(spark, folder, "source_files"))


named("entity_patterns", lambda s, d: patterns.entity_patterns(_code(s, d)))
named("file_patterns", lambda s, d: patterns.file_patterns(_nodes(s, d), _code(s, d)))
named("pattern_members", lambda s, d: patterns.pattern_members(_nodes(s, d), _code(s, d)))
named("idioms", lambda s, d: patterns.idioms(table(s, d, "source_files")))
named("magic_numbers", lambda s, d: patterns.magic_numbers(table(s, d, "source_files")))


@query
def duplicate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Over source files and documents, the texts of which repeat lines more often."""
    files = table(spark, folder, "source_files").select("repo_id", "file_path", "content")
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("repo_id"), F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return patterns.duplicate_blocks(files.unionByName(docs))


named("pattern_entities", lambda s, d: semantic.pattern_entities(table(s, d, "source_files")))
named("variables_constants", lambda s, d: semantic.variables(table(s, d, "source_files")))
named("handlers", lambda s, d: semantic.handlers(table(s, d, "source_files")))
named("text_relations", lambda s, d: semantic.text_relations(table(s, d, "source_files")))
named("decorated_functions", lambda s, d: semantic.decorated(table(s, d, "source_files"), _nodes(s, d)))
named("contextual_entities", lambda s, d: semantic.contextual(_nodes(s, d), table(s, d, "source_files")).withColumn("tags", F.array_join("tags", ",")))
named("endpoint_handlers", lambda s, d: semantic.served(table(s, d, "source_files"), _nodes(s, d)))
named("relations_of_text", lambda s, d: semantic.relations(table(s, d, "source_files"), _nodes(s, d)))
named("config_usage", lambda s, d: semantic.configured(_nodes(s, d), table(s, d, "source_files")))


@query
def extracted_entities(spark: SparkSession, folder: str) -> DataFrame:
    """All ways of finding entities in text together: how many of each kind in each file."""
    rows = semantic.extracted(_nodes(spark, folder), table(spark, folder, "source_files"))
    return rows.groupBy("repo_id", "file_path", "type", F.array_join("tags", ",").alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@query
def dictionary_handlers(spark: SparkSession, folder: str) -> DataFrame:
    """Over files made of the first and the last name of each file's entities, one a dictionary that holds the other."""
    nodes = _nodes(spark, folder).where(F.col("name").rlike("^[A-Za-z0-9_]+$"))
    ends_ = nodes.groupBy("repo_id", "file_path").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    files = ends_.where(F.col("file_path").endswith(".py")).select("repo_id", "file_path", F.format_string('%s = {"key": %s}\n', "a", "b").alias("content"))
    return semantic.handled(files, nodes)


def _with_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The entities, and of each function a test named after it, as the tables have no tests."""
    nodes = _nodes(spark, folder)
    tests = nodes.where("type = 'function'").withColumns({"uuid": F.concat("uuid", F.lit("-test")), "name": F.concat(F.lit("test_"), "name")})
    return nodes.unionByName(tests)


named("test_subjects", lambda s, d: semantic.tested(_with_tests(s, d)))
named("tests_by_calls", lambda s, d: semantic.tested_by_calls(_with_tests(s, d), table(s, d, "source_files")))


# ------------------------------------------------------------------------------------------------ ingest


@query
def parsed_entities(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.parsed_entities(ingest.parse(table(spark, folder, "source_files"))).drop("tags", "context", "ordinal")


@query
def parsed_javascript(spark: SparkSession, folder: str) -> DataFrame:
    """Classes and functions of JavaScript and TypeScript files by their form."""
    rows = ingest.parse(table(spark, folder, "source_files").where(F.lower("file_path").rlike(r"\.(js|jsx|ts|tsx)$")))
    return rows.select("repo_id", "file_path", "name", "type", F.col("extra").alias("form"), "line")


named("definition_tags", lambda s, d: ingest.tags(ingest.parse(table(s, d, "source_files"))))


@query
def javascript_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of JavaScript and TypeScript files."""
    return ingest.tags(ingest.parse(table(spark, folder, "source_files").where(F.lower("file_path").rlike(r"\.(js|jsx|ts|tsx)$"))))


@query
def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files")
    parsed = cut(ingest.parse(files))
    return ingest.counters(parsed, files, ingest.resolve_calls(parsed, cut(ingest.parsed_entities(parsed))))


@query
def call_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.call_counts(ingest.parse(table(spark, folder, "source_files")))


@query
def local_calls(spark: SparkSession, folder: str) -> DataFrame:
    parsed = cut(ingest.parse(table(spark, folder, "source_files")))
    return ingest.local_links(parsed, ingest.parsed_entities(parsed))


@query
def resolved_calls(spark: SparkSession, folder: str) -> DataFrame:
    parsed = cut(ingest.parse(table(spark, folder, "source_files")))
    return ingest.resolve_calls(parsed, cut(ingest.parsed_entities(parsed)))


@query
def ranked_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved calls as links with the ranks of their ends."""
    parsed = cut(ingest.parse(table(spark, folder, "source_files")))
    entities = cut(ingest.parsed_entities(parsed))
    resolved = cut(ingest.resolve_calls(parsed, entities))
    return ingest.ranked_links(resolved, ingest.ranked(entities, resolved, ingest.call_counts(parsed)))


@query
def parsed_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    parsed = cut(ingest.parse(table(spark, folder, "source_files")))
    return ingest.inheritance_links(parsed, ingest.parsed_entities(parsed))


# ------------------------------------------------------------------------------------------------ changes and audit


@query
def upsert_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).select("src", "dst", "type", "uuid")


@query
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """The links that are left when the external entities are deleted."""
    nodes = _nodes(spark, folder)
    edges = _links(spark, folder).withColumnsRenamed({"src": "from_uuid", "dst": "to_uuid"})
    gone = nodes.where("type = 'external'").select("uuid")
    _, left, _ = mutate.delete(nodes, edges, gone, "user", "2026-04-01")
    return left.select("from_uuid", "to_uuid", "type")


@query
def patch_update(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "nodes")
    first = nodes.where("type = 'function'").agg(F.min("uuid")).first()[0] or ""
    new, _ = mutate.update(nodes, first, {"name": "renamed", "docstring": None, "unknown": 1}, "user", "2026-04-01")
    return new.select("uuid", "name", "docstring", F.size("history").alias("n_history"))


@query
def rejected_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Links of which an end doesn't exist, as they would be rejected when created."""
    nodes = _nodes(spark, folder).select("uuid")
    new = _links(spark, folder).select(F.col("src").alias("from_uuid"), F.col("dst").alias("to_uuid"), "type", "uuid", "created_at")
    empty = spark.createDataFrame([], schema.EDGES)
    _, rejected, _ = mutate.relate(nodes, empty, new, "user", "2026-04-01")
    return rejected.select("from_uuid", "to_uuid", "type")


@query
def created_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities after every repository got one more, and after the first of each was written again."""
    nodes = table(spark, folder, "nodes").where("uuid is not null")
    made = table(spark, folder, "repos").select(F.concat(F.lit("made-"), "repo_id").alias("uuid"), "repo_id", F.lit("readme").alias("name"), F.lit("module").alias("type"))
    again = nodes.groupBy("repo_id").agg(F.min("uuid").alias("uuid")).select("uuid", "repo_id", F.lit("again").alias("name"), F.lit("class").alias("type"))
    new, _ = mutate.create(nodes, made.unionByName(again), "user", "2026-04-01")
    return new.select("uuid", "repo_id", "name", "type", "manual").distinct()


@query
def accepted_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The links of which both ends exist, as they would be created over those of type imports."""
    nodes = _nodes(spark, folder).select("uuid")
    new = _links(spark, folder).select(F.col("src").alias("from_uuid"), F.col("dst").alias("to_uuid"), "type", "uuid", "created_at")
    old = new.where("type = 'imports'").select(*[F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.EDGES])
    links, _, _ = mutate.relate(nodes, old, new.withColumn("type", F.concat("type", F.lit("!"))), "user", "2026-04-01")
    return links.select("from_uuid", "to_uuid", "type", "manual")


# ------------------------------------------------------------------------------------------------ stored tables


def _stored(spark: SparkSession, folder: str) -> store.Store:
    kept = store.Store(spark, own_folder(spark, "store"))
    for name in ("nodes", "edges", "audit"):
        rows = table(spark, folder, name)
        kept.write(name, rows.distinct() if name == "audit" else rows)
    return kept


@query
def stored_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Written by repository and read back, without the rows that lack what they need."""
    return _stored(spark, folder).read("nodes").select("uuid", "repo_id", "name", "type", "created_at")


@query
def stored_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder).read("edges").select("uuid", "from_uuid", "to_uuid", "type")


@query
def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index as JSON, with a second writing of the classes over the first."""
    path = own_folder(spark, "index")
    nodes = _nodes(spark, folder)
    new = nodes.where("type = 'class'").withColumn("name", F.concat(F.lit("new "), "name"))
    both = store.upserted(nodes, new, ["uuid"])
    store.write_index(search.index(both), path)
    return store.read_index(spark, path).select("uuid", "name", "type", "start_line", "short_doc")


@query
def stored_log(spark: SparkSession, folder: str) -> DataFrame:
    """The audit log appended in two parts, then all rows of it."""
    path = own_folder(spark, "log")
    rows = table(spark, folder, "audit").distinct()
    for part in (F.col("timestamp") < F.lit("2026-01-01").cast("timestamp_ntz"), F.col("timestamp") >= F.lit("2026-01-01").cast("timestamp_ntz")):
        store.append_log(rows.where(part), path)
    return store.read_log(spark, path, limit=2**31 - 1).select("uuid", "timestamp", "action", "entity_uuid")


@query
def deleted_repository(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each stored table still has when the first repository is deleted."""
    kept = _stored(spark, folder)
    first = table(spark, folder, "nodes").agg(F.min("repo_id")).first()[0]
    kept.delete_repo(first)
    parts = [kept.read(t, valid=False).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("nodes", "edges", "audit")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def file_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: its language, how many entities of each kind it yields, and whether it could be read."""
    files = table(spark, folder, "source_files")
    found = ingest.parse(files).groupBy("repo_id", "file_path").agg(
        F.count_if(F.col("kind") == "entity").alias("entities"), F.count_if(F.col("kind") == "import").alias("imports"), F.count_if(F.col("kind") == "call").alias("calls")
    )
    known = language.detect(_files(spark, folder)).select("repo_id", plain_path("file_path").alias("file_path"), "language", F.round("confidence", 6).alias("confidence"))
    able = language.capabilities(spark).select("language", "typing", "test_frameworks", "has_analyzer", "has_parser", "depth")
    rows = known.join(found, ["repo_id", "file_path"], "left").withColumn("parsed", F.col("entities").isNotNull()).na.fill(0)
    return rows.join(F.broadcast(able), "language", "left")


@query
def ingest_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = store.ingest_audit(_nodes(spark, folder), "add_node", "node")
    return rows.select("timestamp", "user", "action", "entity_type", "entity_uuid")


@query
def audit_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "audit").where("timestamp is not null").distinct()
    return store.audit_page(rows, 100, 50)


@query
def audit_by_entity(spark: SparkSession, folder: str) -> DataFrame:
    """The audit rows of the entity that has most, whole log."""
    rows = table(spark, folder, "audit").distinct()
    per = rows.where("entity_type = 'node'").groupBy(F.lower(F.trim("entity_uuid")).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return store.audit_of(rows, per.orderBy(F.desc("n"), "entity").limit(1))


@query
def audit_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audit_stream.windowed_counts(table(spark, folder, "audit"))


named("audit_deduplicated", lambda s, d: audit_stream.deduplicated(table(s, d, "audit")).select("uuid"))


def _audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The audit table as a stream: of its folder, or of the one file it is."""
    path = f"{folder}/audit.parquet"
    if os.path.isfile(path):
        return spark.readStream.schema(schema.AUDIT).option("pathGlobFilter", "audit.parquet").parquet(folder)
    return audit_stream.read(spark, path)


@query
def audit_stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each entity, kept by a stream that is read to its end."""
    place = own_folder(spark, "stream")
    rows = _audit_stream(spark, folder).where("timestamp is not null")
    sink = audit_stream.upsert_into(f"{place}/latest", ["entity_uuid"])
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/offsets").trigger(availableNow=True).start().awaitTermination()
    return audit_stream.latest(spark, f"{place}/latest").select("entity_uuid", "timestamp", "uuid")
