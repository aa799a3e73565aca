"""Counts, degrees, complexity, dependency, impact, language and quality figures of the graph.

All take the entities and links of codeloom.operators.graph and give figures for every repository at once; a link
belongs to the repository of its source. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.paths import ending, language
from codeloom.operators.graph import by_repo, degrees, ends
from codeloom.operators.graphalg import cycles, strong_components

FUNCTIONS = ("function",)
DEPENDENCY_TYPES = ("imports", "calls", "uses")


def type_counts(rows: DataFrame) -> DataFrame:
    """(type, n) of entities or links; a null type is unknown."""
    return rows.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def ending_counts(nodes: DataFrame) -> DataFrame:
    """(repo_id, ending, n): entities per file ending; paths without one are left out."""
    rows = nodes.select("repo_id", ending("file_path").alias("ending")).where("ending <> ''")
    return rows.groupBy("repo_id", "ending").agg(F.count(F.lit(1)).alias("n"))


def sizes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, n_nodes, n_edges, density, average_degree, max_degree) of each repository."""
    count = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    inner = by_repo(nodes, links)
    m = inner.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_edges"))
    top = degrees(nodes, links).groupBy("repo_id").agg(F.sum("degree").alias("s_"), F.max("degree").alias("max_degree"))
    n = F.col("n_nodes")
    rows = count.join(m, "repo_id", "left").join(top, "repo_id").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    density = F.when(n > 1, F.col("n_edges") / (n.cast("double") * (n - 1))).otherwise(0.0)
    return rows.select("repo_id", "n_nodes", "n_edges", density.alias("density"), (F.col("s_") / n).alias("average_degree"), "max_degree")


def repository_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, components): strong components of each repository, over the links within it; an isolated entity is one."""
    home = nodes.select("uuid", "repo_id")
    ends_ = links.select("src", "dst").join(home.toDF("src", "a"), "src").join(home.toDF("dst", "b"), "dst").where("a = b")
    found = strong_components(ends_.select("src", "dst"), home.select("uuid"))
    return found.join(home, "uuid").groupBy("repo_id").agg(F.countDistinct("component").alias("components"))


def most_connected(nodes: DataFrame, links: DataFrame, limit: int = 10) -> DataFrame:
    """The entities of the largest degree; ties by uuid."""
    rows = degrees(nodes, links).select("uuid", "name", "type", "degree", "n_in", "n_out")
    return rows.orderBy(F.desc("degree"), "uuid").limit(limit)


def complexity(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, uuid, name, file_path, score, incoming, outgoing) of every function."""
    rows = degrees(nodes, links).where(F.col("type").isin(*FUNCTIONS))
    return rows.select("repo_id", "uuid", "name", "file_path", F.col("degree").alias("score"), F.col("n_in").alias("incoming"), F.col("n_out").alias("outgoing"))


def complexity_top(nodes: DataFrame, links: DataFrame, limit: int = 20) -> DataFrame:
    return complexity(nodes, links).orderBy(F.desc("score"), "uuid").limit(limit)


def complexity_histogram(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, low up to 2, medium up to 5, high)."""
    s = F.col("score")
    return complexity(nodes, links).groupBy("repo_id").agg(
        F.count_if(s <= 2).alias("low"), F.count_if((s > 2) & (s <= 5)).alias("medium"), F.count_if(s > 5).alias("high"), F.avg(s).alias("average")
    )


def high_dependency(nodes: DataFrame, links: DataFrame, top: int = 20, least: int = 5, limit: int = 10) -> DataFrame:
    """Of the `top` most complex functions the first `limit` with more than `least` incoming links."""
    return complexity_top(nodes, links, top).where(F.col("incoming") > least).orderBy(F.desc("score"), "uuid").limit(limit)


def containing_class(nodes: DataFrame) -> DataFrame:
    """Functions and methods with the class of the same file whose lines enclose their first; the innermost wins.

    Lines of a file are bucketed so the interval join is an equi-join on (repository, file, bucket) first.
    """
    width = 256
    classes = nodes.where("type = 'class' and start_line is not null and end_line is not null and end_line >= start_line").select(
        "repo_id", "file_path", F.col("uuid").alias("class_uuid"), F.col("name").alias("class_name"), F.col("start_line").alias("low"), F.col("end_line").alias("high"),
        F.explode(F.sequence((F.col("start_line") / width).cast("int"), (F.col("end_line") / width).cast("int"))).alias("bucket"),
    )
    inner = nodes.where("type in ('function', 'method') and start_line is not null").select(
        "repo_id", "file_path", "uuid", "name", "start_line", (F.col("start_line") / width).cast("int").alias("bucket")
    )
    met = inner.join(classes, ["repo_id", "file_path", "bucket"]).where("low < start_line and start_line <= high")
    return met.groupBy("repo_id", "file_path", "uuid", "name", "start_line").agg(F.min(F.struct(F.col("high") - F.col("low"), "class_uuid", "class_name")).alias("c")).select(
        "repo_id", "file_path", "uuid", "name", "start_line", "c.class_uuid", "c.class_name"
    )


def god_classes(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Classes that hold more than `most` functions."""
    return containing_class(nodes).groupBy("repo_id", "file_path", "class_uuid", "class_name").agg(F.count(F.lit(1)).alias("functions")).where(F.col("functions") > most)


def imports(links: DataFrame) -> DataFrame:
    return links.where("type = 'imports'")


def fan_issues(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(uuid, issue, n, severity): more than 10 imports out (high beyond 20), or 15 in (high beyond 25)."""
    e = ends(imports(links))
    issue = F.array(
        F.when(F.col("n_out") > 10, F.struct(F.lit("high_fan_out").alias("issue"), F.col("n_out").alias("n"), F.when(F.col("n_out") > 20, "high").otherwise("medium").alias("severity"))),
        F.when(F.col("n_in") > 15, F.struct(F.lit("high_fan_in").alias("issue"), F.col("n_in").alias("n"), F.when(F.col("n_in") > 25, "high").otherwise("medium").alias("severity"))),
    )
    rows = e.select("uuid", F.explode(F.array_compact(issue)).alias("x")).select("uuid", "x.*")
    return rows.join(nodes.select("uuid", "name"), "uuid", "left").withColumn("name", F.coalesce("name", F.lit("")))


def most_depended(nodes: DataFrame, links: DataFrame, column: str = "n_in", limit: int = 10) -> DataFrame:
    """Most imported (n_in) or most importing (n_out) entities; ties by uuid."""
    top = ends(imports(links)).where(F.col(column) > 0).orderBy(F.desc(column), "uuid").limit(limit)
    named = top.join(nodes.select("uuid", "name"), "uuid", "left")
    return named.select("uuid", F.coalesce("name", F.lit("")).alias("name"), F.col(column).alias("n"))


def dependency_summary(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes and edges of the import graph, how many entities have a fan issue and how many circuits there are."""
    e = imports(links).agg(F.count(F.lit(1)).alias("edges"))
    n = ends(imports(links)).agg(F.count(F.lit(1)).alias("nodes"))
    issues = fan_issues(nodes, links).agg(F.count(F.lit(1)).alias("issues"))
    circuits = cycles(imports(links), None).agg(F.count(F.lit(1)).alias("cycles"))
    return n.join(F.broadcast(e)).join(F.broadcast(issues)).join(F.broadcast(circuits))


def dependents(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, uuid, hops): who imports, calls or uses a target (1), or does so with one of those (2).

    targets: (target), a bounded list. Only the target's own links are expanded.
    """
    typed = links.where(F.col("type").isin(*DEPENDENCY_TYPES)).select("src", "dst")
    one = typed.join(F.broadcast(targets), F.col("dst") == F.col("target")).select("target", F.col("src").alias("uuid")).distinct()
    two = typed.join(one.withColumnRenamed("uuid", "dst"), "dst").select("target", F.col("src").alias("uuid")).distinct()
    return one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))


def impact(links: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, direct, transitive, affected, files, score, risk) for each target."""
    reached = dependents(links, targets)
    places = reached.join(nodes.select("uuid", "file_path"), "uuid", "left")
    per = places.groupBy("target").agg(
        F.count_if(F.col("hops") == 1).alias("direct"),
        F.count_if(F.col("hops") == 2).alias("transitive"),
        F.countDistinct("uuid").alias("affected"),
        F.countDistinct(F.coalesce("file_path", F.lit("unknown"))).alias("files"),
    )
    all_ = targets.join(per, "target", "left").na.fill(0)
    score = F.col("direct") * 3 + F.col("transitive")
    risk = F.when(score > 20, "high").when(score > 10, "medium").otherwise("low")
    return all_.withColumn("score", score).withColumn("risk", risk)


def affected_entities(links: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, file_path, uuid, name, type): every entity that depends on a target, with its file."""
    reached = dependents(links, targets).select("target", "uuid").distinct()
    rows = reached.join(nodes.select("uuid", "file_path", "name", "type"), "uuid", "left")
    return rows.select("target", F.coalesce("file_path", F.lit("unknown")).alias("file_path"), "uuid", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("type", F.lit("")).alias("type"))


def affected_files(links: DataFrame, nodes: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """(target, file_path, entities): the first `limit` files, by path, with entities that depend on a target."""
    reached = dependents(links, targets).select("target", "uuid").distinct()
    rows = reached.join(nodes.select("uuid", "file_path"), "uuid", "left")
    per = rows.groupBy("target", F.coalesce("file_path", F.lit("unknown")).alias("file_path")).agg(F.count(F.lit(1)).alias("entities"))
    rank = F.row_number().over(W.partitionBy("target").orderBy("file_path"))
    return per.withColumn("r_", rank).where(F.col("r_") <= limit).drop("r_")


def language_counts(nodes: DataFrame) -> DataFrame:
    """(repo_id, language, n, percentage): entities per language; percentage of those with a path."""
    rows = nodes.where("file_path is not null and file_path <> ''").withColumn("ending", ending("file_path"))
    total = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("all_"))
    per = rows.where("ending <> ''").groupBy("repo_id", language("file_path").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return per.join(total, "repo_id").select("repo_id", "language", "n", (F.col("n") / F.col("all_") * 100).alias("percentage"))


def language_summary(nodes: DataFrame) -> DataFrame:
    """(repo_id, primary_language, dominance, diversity, multilingual, files, main_languages): the last are the five most
    frequent with their counts, "python:12,go:3"; ties by name, downwards."""
    files = nodes.where("file_path <> ''").groupBy("repo_id").agg(F.countDistinct("file_path").alias("files"))
    first = F.max(F.struct("n", "percentage", F.col("language"))).alias("top")
    # A repository has at most as many languages as there are known ones.
    ordered = F.slice(F.sort_array(F.collect_list(F.struct("n", "language")), asc=False), 1, 5)
    main = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["language"], x["n"].cast("string"))), ",")
    rows = language_counts(nodes).groupBy("repo_id").agg(first, F.count(F.lit(1)).alias("diversity"), F.count_if(F.col("percentage") > 10).alias("major"), main.alias("main_languages"))
    return rows.join(files, "repo_id").select(
        "repo_id", F.col("top.language").alias("primary_language"), F.col("top.percentage").alias("dominance"), "diversity", (F.col("major") > 1).alias("multilingual"), "files", "main_languages"
    )


def _clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def quality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, low, medium, high, documented_ratio, functions_per_file, average_degree, n) in one pass."""
    rows = degrees(nodes, links)
    d = F.col("degree")
    documented = F.coalesce(F.trim("docstring") != "", F.lit(False))
    per = rows.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("degree").alias("average_degree"),
        F.count_if(d <= 3).alias("low"),
        F.count_if((d > 3) & (d <= 7)).alias("medium"),
        F.count_if(d > 7).alias("high"),
        F.count_if(documented).alias("documented"),
        F.count_if(F.col("type").isin(*FUNCTIONS)).alias("functions"),
        F.countDistinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("files"),
    )
    return per.withColumn("documented_ratio", F.col("documented") / F.col("n")).withColumn("functions_per_file", F.when(F.col("files") > 0, F.col("functions") / F.col("files")).otherwise(0.0))


def quality_scores(nodes: DataFrame, links: DataFrame, compact: bool = False) -> DataFrame:
    """(repo_id, maintainability, complexity, documentation[, structure], overall, grade); compact: without structure."""
    rows = quality(nodes, links)
    rows = rows.select(
        "repo_id",
        _clamp(100 - 10 * F.col("average_degree")).alias("maintainability"),
        _clamp(100 - 100 * F.col("high") / F.col("n")).alias("complexity"),
        (100 * F.col("documented_ratio")).alias("documentation"),
        _clamp(100 - 5 * F.abs(F.col("functions_per_file") - 10)).alias("structure"),
    )
    if compact:
        overall = 0.4 * F.col("maintainability") + 0.4 * F.col("complexity") + 0.2 * F.col("documentation")
        rows = rows.drop("structure")
    else:
        overall = 0.3 * F.col("maintainability") + 0.3 * F.col("complexity") + 0.2 * F.col("documentation") + 0.2 * F.col("structure")
    o = F.col("overall")
    grade = F.when(o >= 90, "A").when(o >= 80, "B").when(o >= 70, "C").when(o >= 60, "D").otherwise("F")
    return rows.withColumn("overall", overall).withColumn("grade", grade)


def rounded(scores: DataFrame, places: int = 2) -> DataFrame:
    """scores with its fractional columns rounded half to even, as they are shown."""
    fractional = [f.name for f in scores.schema.fields if f.dataType.typeName() == "double"]
    return scores.withColumns({c: F.bround(c, places) for c in fractional})


def recommendations(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, recommendation) for every score that is below its bar."""
    s = quality_scores(nodes, links)
    said = F.array_compact(
        F.array(
            F.when(F.col("maintainability") < 70, F.lit("reduce coupling between entities")),
            F.when(F.col("complexity") < 70, F.lit("split entities with many links")),
            F.when(F.col("documentation") < 50, F.lit("document more entities")),
            F.when(F.col("structure") < 70, F.lit("balance the number of functions per file")),
        )
    )
    return s.select("repo_id", F.explode(said).alias("recommendation"))
