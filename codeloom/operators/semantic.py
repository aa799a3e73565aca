"""Entities and relations recognised by patterns in Python text: every match, over whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import ending
from codeloom.operators.traverse import lines
from codeloom.session import cut, spread

# Name, type, pattern, group of the name, confidence, tags.
ENTITY_PATTERNS = (
    ("flask_route", "endpoint", r"@app\.route\([\"']([^\"']+)[\"']", 1, 0.9, ("API", "FLASK", "ENDPOINT")),
    ("fastapi_endpoint", "endpoint", r"@app\.(get|post|put|delete|patch)\([\"']([^\"']+)[\"']", 1, 0.9, ("API", "FASTAPI", "ENDPOINT")),
    ("decorator", "decorator", r"@(\w+)", 1, 0.8, ("DECORATOR",)),
    ("constants", "constant", r"^([A-Z][A-Z0-9_]*)\s*=", 1, 0.7, ("CONSTANT",)),
    ("exception_class", "exception", r"class\s+(\w*(?:Error|Exception))\s*\(", 1, 0.9, ("EXCEPTION", "CLASS")),
    ("test_function", "test", r"def\s+(test_\w+)\s*\(", 1, 0.9, ("TEST", "FUNCTION")),
    ("model_class", "model", r"class\s+(\w+)(?:Model|Schema|Entity)\s*\(", 1, 0.8, ("MODEL", "CLASS")),
    ("utility_function", "utility", r"def\s+(_?\w*(?:util|helper|tool)\w*)\s*\(", 1, 0.7, ("UTILITY", "FUNCTION")),
)
#: Of the value of a variable so many characters are kept.
PREVIEW = 50
# Relation, pattern, groups of source and target, confidence.
RELATION_FORMS = (("inherits", r"class\s+(\w+)\s*\(\s*(\w+)", 1, 2, 0.9), ("imports", r"from\s+(\w+)\s+import\s+(\w+)", 2, 1, 0.9), ("composes", r"self\.(\w+)\s*=\s*(\w+)\(", 1, 2, 0.7))
# What the surroundings of an entity mention, by prefix: words, type it applies to, type and tags of what it
# suggests, confidence.
MENTIONS = {
    "api": (("@app.route", "@app.get", "@app.post", "request", "response", "HTTP", "API"), "function", "endpoint", 0.8, ("API", "ENDPOINT", "ENHANCED")),
    "test_util": (("assert", "pytest", "unittest", "mock", "test_", "@pytest"), "function", "test", 0.7, ("TEST", "UTILITY", "ENHANCED")),
    "model": (("pydantic", "BaseModel", "dataclass", "SQLAlchemy", "Table", "Column", "relationship"), "class", "model", 0.8, ("MODEL", "DATA", "ENHANCED")),
}
UTILITY_TAGS = ("UTILITY", "HELPER", "ENHANCED")
# Fixed value: a dictionary's name, its last string key with a word for its value, and that.
HANDLER = r"(\w+)\s*=\s*\{[^}]*[\"'](\w+)[\"']\s*:\s*(\w+)"
UTILITY_WORDS = ("helper", "util", "tool", "common", "shared")
NO_SUBJECTS = ("assert", "assertEqual", "assertTrue", "mock", "patch")


def _python(files: DataFrame) -> DataFrame:
    rows = files.where(ending("file_path") == ".py").where("content is not null").dropDuplicates(["repo_id", "file_path"])
    return rows.select("repo_id", "file_path", F.posexplode(lines("content")).alias("n", "text"))


def _matched(files: DataFrame, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """(repo_id, file_path, line, form, groups) of every match of each pattern (form, pattern) over whole Python texts."""
    rows = spread(files.where(ending("file_path") == ".py").where("content is not null").dropDuplicates(["repo_id", "file_path"]).select("repo_id", "file_path", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(form, re.compile(p, re.M)) for form, p in patterns]
        for batch in batches:
            out = []
            for repo, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text.replace("\r\n", "\n")
                for form, pattern in compiled:
                    line, at = 1, 0
                    for m in pattern.finditer(text):
                        line, at = line + text.count("\n", at, m.start()), m.start()
                        out.append((repo, path, line, form, list(m.groups())))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["repo_id", "file_path", "line", "form", "groups"])

    return rows.mapInArrow(run, "repo_id string, file_path string, line int, form string, groups array<string>")


def pattern_entities(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, pattern, type, name, confidence, metadata) of every match of each pattern."""
    forms = files.sparkSession.createDataFrame([(n, k, g, c) for n, k, _, g, c, _ in ENTITY_PATTERNS], "pattern string, type string, g int, confidence double")
    rows = _matched(files, tuple((n, p) for n, _, p, *_ in ENTITY_PATTERNS)).withColumnRenamed("form", "pattern").join(F.broadcast(forms), "pattern")
    path = F.when(F.col("pattern") == "fastapi_endpoint", F.get("groups", F.lit(1)))
    return rows.select("repo_id", "file_path", "line", "pattern", "type", F.get("groups", F.col("g") - 1).alias("name"), "confidence", path.alias("metadata"))


def text_relations(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, relation, source, target, confidence): inheritance, imports and composition by form, every
    match of each, also over several lines."""
    forms = files.sparkSession.createDataFrame([(k, a, b, c) for k, _, a, b, c in RELATION_FORMS], "relation string, a int, b int, confidence double")
    rows = _matched(files, tuple((k, p) for k, p, *_ in RELATION_FORMS)).withColumnRenamed("form", "relation").join(F.broadcast(forms), "relation")
    return rows.select("repo_id", "file_path", "line", "relation", F.get("groups", F.col("a") - 1).alias("source"), F.get("groups", F.col("b") - 1).alias("target"), "confidence")


def variables(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, name, type, value): assignments at line starts; upper-case names are constants."""
    pattern = r"^(\w+)\s*=\s*(.+)$"
    rows = _python(files).where(F.col("text").rlike(pattern) & ~F.col("text").rlike(r"^\w+\s*=\s*=")).select(
        "repo_id", "file_path", (F.col("n") + 1).alias("line"), F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("value")
    )
    rows = rows.where(~F.col("value").rlike("import|def |class "))
    upper = (F.upper("name") == F.col("name")) & F.col("name").rlike("[A-Z]")
    return rows.select("repo_id", "file_path", "line", "name", F.when(upper, "constant").otherwise("variable").alias("type"), F.substring("value", 1, PREVIEW).alias("value"))


def handlers(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, holder, key, function): of each dictionary bound to a name the last string key with a word
    for its value, one row."""
    rows = _matched(files, (("handler", HANDLER),))
    return rows.select("repo_id", "file_path", "line", F.get("groups", F.lit(0)).alias("holder"), F.get("groups", F.lit(1)).alias("key"), F.get("groups", F.lit(2)).alias("function"))


def contextual(nodes: DataFrame, files: DataFrame, before: int = 2, after: int = 3) -> DataFrame:
    """(base, name, type, confidence, tags): entities suggested by what the lines around an entity mention, or by its name."""
    from codeloom.operators.traverse import between, texts

    wanted = nodes.where("start_line is not null and end_line is not null").select("uuid", "name", "type", "repo_id", "file_path", "start_line", "end_line")
    rows = wanted.join(texts(files), ["repo_id", "file_path"]).where(F.col("start_line") <= F.size("l_"))
    rows = rows.select("uuid", "name", "type", "file_path", between(F.col("l_"), F.col("start_line") - before, F.col("end_line") + after).alias("text"))
    hits = []
    for prefix, (words, wanted_type, kind, confidence, tags) in MENTIONS.items():
        mentions = F.lit(False)
        for w in words:
            mentions = mentions | F.col("text").contains(w)
        fits = (F.col("type") == wanted_type) & mentions
        if prefix == "test_util":
            fits = fits & ~F.col("name").startswith("test_")
        hits.append(F.when(fits, _suggested(prefix, kind, confidence, tags)))
    useful = (F.col("type") == "function") & (F.lower("name").rlike("|".join(UTILITY_WORDS)) | F.lower("file_path").rlike("|".join(UTILITY_WORDS)))
    hits.append(F.when(useful, _suggested("util", "utility", 0.7, UTILITY_TAGS)))
    return rows.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).select(F.col("uuid").alias("base"), "hit.*")


def _suggested(prefix: str, kind: str, confidence: float, tags: tuple[str, ...]) -> Column:
    name = F.concat(F.lit(f"{prefix}_"), F.col("name"))
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.array(*[F.lit(t) for t in tags]).alias("tags"))


def extracted(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Entities (uuid, repo_id, file_path, type, name, start_line, end_line, tags, metadata) of all ways together: by
    pattern, suggested by context, variables and constants, handlers. The id follows from what the entity is; metadata is
    JSON of how it was found. Repeated finds of one thing are one entity."""
    spark = files.sparkSession
    tags = spark.createDataFrame([(n, list(t)) for n, *_, t in ENTITY_PATTERNS], "pattern string, tags array<string>")
    columns = ("repo_id", "file_path", "type", "name", "line", "confidence", "tags", "pattern", "value", "base", "holder", "key", "function")

    def shaped(df: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(*[F.col(c) if c in df.columns else none.alias(c) for c in columns])

    by_form = shaped(pattern_entities(files).drop("metadata").join(F.broadcast(tags), "pattern"))
    kinds = F.when(F.col("type") == "constant", F.array(F.lit("CONSTANT"), F.lit("GLOBAL"))).otherwise(F.array(F.lit("VARIABLE"), F.lit("GLOBAL")))
    bound = shaped(variables(files).withColumns({"confidence": F.lit(0.6), "tags": kinds}))
    entry = F.concat("holder", F.lit("["), "key", F.lit("]"))
    held = shaped(handlers(files).withColumns({"type": F.lit("handler"), "name": entry, "confidence": F.lit(0.8), "tags": F.array(F.lit("HANDLER"), F.lit("MAPPING"))}))
    home = nodes.select(F.col("uuid").alias("base"), "repo_id", "file_path", F.col("start_line").alias("line"))
    near = shaped(contextual(nodes, files).join(home, "base"))
    rows = by_form.unionByName(bound).unionByName(held).unionByName(near)
    uuid = F.sha2(F.concat_ws("|", "repo_id", "file_path", "type", "name", F.col("line").cast("string"), F.coalesce("pattern", "base", "holder", F.lit(""))), 256)
    said = F.to_json(F.struct("confidence", F.lit("semantic_pattern").alias("extraction_method"), "pattern", "value", F.col("base").alias("base_entity"), F.col("holder").alias("handler_dict"), F.col("key").alias("handler_key"), F.col("function").alias("handler_function")))
    rows = rows.select(uuid.alias("uuid"), "repo_id", "file_path", "type", "name", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "tags", said.alias("metadata"))
    return rows.dropDuplicates(["uuid"])


def decorated(files: DataFrame, nodes: DataFrame, within: int = 4) -> DataFrame:
    """(repo_id, file_path, decorator, function, uuid, external): each decorator with the first function defined in the
    next lines; external if no entity of that name is known in the file."""
    rows = _python(files)
    marks = rows.where(F.col("text").rlike(r"^\s*@\w+")).select("repo_id", "file_path", F.col("n").alias("at"), F.regexp_extract("text", r"^\s*@(\w+)", 1).alias("decorator"))
    heads = rows.where(F.col("text").rlike(r"^\s*(?:async\s+)?def\s+\w+")).select("repo_id", "file_path", "n", F.regexp_extract("text", r"def\s+(\w+)", 1).alias("function"))
    near = marks.withColumn("n", F.explode(F.sequence(F.col("at") + 1, F.col("at") + within))).join(heads, ["repo_id", "file_path", "n"])
    first = near.groupBy("repo_id", "file_path", "at", "decorator").agg(F.min(F.struct("n", "function"))["function"].alias("function"))
    known = nodes.where("type in ('function', 'method')").groupBy("repo_id", "file_path", F.col("name").alias("function")).agg(F.min("uuid").alias("uuid"))
    names = nodes.groupBy("repo_id", "file_path", F.col("name").alias("decorator")).agg(F.lit(True).alias("inside"))
    met = first.join(known, ["repo_id", "file_path", "function"]).join(names, ["repo_id", "file_path", "decorator"], "left")
    return met.select("repo_id", "file_path", "decorator", "function", "uuid", F.col("inside").isNull().alias("external"))


def tested(nodes: DataFrame) -> DataFrame:
    """(test, subject, confidence): tests linked to the function their name says, test_<subject>_..., in their repository."""
    tests = nodes.where("type in ('function', 'method')").where(F.col("name").startswith("test_"))
    tests = tests.select("repo_id", F.col("uuid").alias("test"), F.regexp_extract("name", "^test_([^_]*)", 1).alias("name")).where("name <> ''")
    subjects = nodes.where("type in ('function', 'method', 'class')").groupBy("repo_id", "name").agg(F.min("uuid").alias("subject"))
    return tests.join(subjects, ["repo_id", "name"]).where("test <> subject").select("test", "subject", F.lit(0.7).alias("confidence"))


def configured(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(config, uuid): entities whose lines use a configuration name (tag CONFIG or upper case) of their repository.

    Each file's distinct words meet the names; only the lines of what is met are looked at, then the tightest entity
    around each.
    """
    from codeloom.operators.traverse import entity_at, texts

    upper = (F.upper("name") == F.col("name")) & F.col("name").rlike("[A-Z]")
    names = nodes.where(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "CONFIG") | upper).groupBy("repo_id", F.col("name").alias("word")).agg(F.min("uuid").alias("config"))
    rows = texts(files)
    words = rows.select("repo_id", "file_path", F.explode(F.array_distinct(F.split(F.array_join("l_", "\n"), r"\W+"))).alias("word")).where(F.length("word") > 1)
    met = words.join(names, ["repo_id", "word"])
    whole = F.concat(F.lit(r"(?<!\w)"), F.col("word"), F.lit(r"(?!\w)"))
    used = F.filter(F.transform("l_", lambda x, i: F.when(x.contains(F.col("word")) & F.regexp_like(x, whole), i + 1)), lambda x: x.isNotNull())
    used = cut(met.join(rows, ["repo_id", "file_path"]).select("repo_id", "file_path", "config", F.explode(used).alias("line")))
    places = used.select("repo_id", "file_path", "line").distinct()
    found = used.join(entity_at(nodes, places), ["repo_id", "file_path", "line"])
    return found.where("config <> uuid").select("config", "uuid").distinct()


def _first_named(nodes: DataFrame, column: str) -> DataFrame:
    """(repo_id, file_path, column, uuid): the first entity of each name in a file."""
    return nodes.groupBy("repo_id", "file_path", F.col("name").alias(column)).agg(F.min_by("uuid", F.struct("start_line", "uuid")).alias(f"{column}_id"))


def handled(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, file_path, key, source, target, confidence): dictionaries with the entity of their file that they hold
    under a key, where both are known."""
    met = handlers(files).join(_first_named(nodes, "holder"), ["repo_id", "file_path", "holder"]).join(_first_named(nodes, "function"), ["repo_id", "file_path", "function"])
    return met.select("repo_id", "file_path", "key", F.col("holder_id").alias("source"), F.col("function_id").alias("target"), F.lit(0.8).alias("confidence")).distinct()


def served(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, file_path, endpoint, uuid, confidence): endpoints with the first function defined from two lines before
    them to four lines after."""
    marks = pattern_entities(files).where("type = 'endpoint'").select("repo_id", "file_path", "line", F.coalesce("metadata", "name").alias("endpoint"))
    heads = _python(files).where(F.col("text").rlike(r"^\s*(?:async\s+)?def\s+\w+")).select("repo_id", "file_path", (F.col("n") + 1).alias("at"), F.regexp_extract("text", r"def\s+(\w+)", 1).alias("function"))
    near = marks.withColumn("at", F.explode(F.sequence(F.greatest(F.col("line") - 2, F.lit(1)), F.col("line") + 4))).join(heads, ["repo_id", "file_path", "at"])
    known = nodes.where("type in ('function', 'method')").groupBy("repo_id", "file_path", F.col("name").alias("function")).agg(F.min("uuid").alias("uuid"))
    met = near.join(known, ["repo_id", "file_path", "function"])
    return met.groupBy("repo_id", "file_path", "line", "endpoint").agg(F.min(F.struct("at", "uuid"))["uuid"].alias("uuid")).select("repo_id", "file_path", "endpoint", "uuid", F.lit(0.9).alias("confidence"))


def tested_by_calls(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(test, subject, confidence): tests with the functions of their repository that their code calls."""
    from codeloom.operators.traverse import snippets

    tests = nodes.where("type in ('function', 'method')").where(F.col("name").startswith("test_"))
    code = snippets(tests, files, 0).select(F.col("uuid").alias("test"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(\w+)\("), F.lit(1)))).alias("name"))
    called = code.where(~F.col("name").isin(*NO_SUBJECTS)).join(tests.select(F.col("uuid").alias("test"), "repo_id"), "test")
    subjects = nodes.where("type in ('function', 'method', 'class')").groupBy("repo_id", "name").agg(F.min("uuid").alias("subject"))
    return called.join(subjects, ["repo_id", "name"]).where("test <> subject").select("test", "subject", F.lit(0.6).alias("confidence"))


def relations(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation, source, target, confidence, external): all relations the text gives, between entities of one file.

    Names without an entity in their file become external placeholders: "external:" and the name.
    """
    named = nodes.groupBy("repo_id", "file_path", "name").agg(F.max_by("uuid", "start_line").alias("uuid"))
    ids = lambda side: named.select("repo_id", "file_path", F.col("name").alias(side), F.col("uuid").alias(f"{side}_id"))
    found = text_relations(files).select("repo_id", "file_path", "relation", "source", "target", "confidence").distinct()
    met = found.join(ids("source"), ["repo_id", "file_path", "source"], "left").join(ids("target"), ["repo_id", "file_path", "target"], "left")
    place = lambda side: F.coalesce(F.col(f"{side}_id"), F.concat(F.lit("external:"), F.col(side)))
    formed = met.where("source_id is not null or target_id is not null").select("relation", place("source").alias("source"), place("target").alias("target"), "confidence", (F.col("source_id").isNull() | F.col("target_id").isNull()).alias("external"))
    row = lambda df, relation, a, b, c, ext: df.select(F.lit(relation).alias("relation"), a.alias("source"), b.alias("target"), c.alias("confidence"), ext.alias("external"))
    no = F.lit(False)
    marks = decorated(files, nodes)
    return (
        formed.unionByName(row(marks, "decorates", F.concat(F.lit("external:"), F.col("decorator")), F.col("uuid"), F.lit(0.9), F.col("external")))
        .unionByName(row(handled(files, nodes), "handles", F.col("source"), F.col("target"), F.col("confidence"), no))
        .unionByName(row(served(files, nodes), "handles", F.col("endpoint"), F.col("uuid"), F.col("confidence"), no))
        .unionByName(row(tested(nodes), "tests", F.col("test"), F.col("subject"), F.col("confidence"), no))
        .unionByName(row(tested_by_calls(nodes, files), "tests", F.col("test"), F.col("subject"), F.col("confidence"), no))
        .unionByName(row(configured(nodes, files), "configures", F.col("config"), F.col("uuid"), F.lit(0.6), no))
    ).distinct()
