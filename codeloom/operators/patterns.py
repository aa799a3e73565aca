"""Design patterns, smells and idioms found in entities' code and in whole files.

Every detector is a filter over entities with their code or over files; "first per file" ones keep the entity with the
smallest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import ending
from codeloom.operators.search import first_per_group
from codeloom.operators.traverse import between, texts

# Limits of the smells.
BLANKS = " \t\r\x0b\x0c"
LONG_CLASS, MANY_METHODS, MANY_PARAMETERS, LONG_FUNCTION, MANY_FUNCTIONS, BLOCK = 200, 20, 5, 30, 10, 5


def with_code(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Entities with lines, and `code`, their lines of the file."""
    wanted = nodes.where("type in ('class', 'function', 'method') and start_line is not null and end_line is not null")
    met = wanted.select("repo_id", "file_path", "uuid", "name", "type", "start_line", "end_line").join(texts(files), ["repo_id", "file_path"])
    return met.withColumn("code", between(F.col("l_"), F.col("start_line"), F.col("end_line"))).drop("l_")


def _any(text: Column, *words: str) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def entity_patterns(code: DataFrame) -> DataFrame:
    """(pattern, confidence, repo_id, file_path, uuid) of the detectors that look at one class or function."""
    text, low = F.col("code"), F.lower("name")
    is_class, is_function = F.col("type") == "class", F.col("type") == "function"
    params = F.regexp_extract("code", r"def\s+\w+\s*\(([^)]*)\)", 1)
    n_params = F.size(F.filter(F.split(params, ","), lambda x: F.trim(x) != ""))
    span = F.col("end_line") - F.col("start_line") + 1
    # Conditions and confidences.
    first = {
        "singleton": (is_class & _any(text, "_instance", "__new__") & _any(text, "getInstance", "get_instance"), 0.8),
        "factory": ((is_class | is_function) & text.rlike(r"return\s+\w+\s*\(") & _any(low, "factory", "create", "build", "make"), 0.7),
        "god_class": (is_class & ((span > LONG_CLASS) | (F.regexp_count("code", F.lit(r"def\s+\w+")) > MANY_METHODS)), 0.8),
    }
    every = {
        "long_parameter_list": (is_function & (n_params > MANY_PARAMETERS), 0.7),
        "extract_method": (is_function & (span > LONG_FUNCTION), 0.7),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("pattern"), F.lit(w).alias("confidence"))) for k, (c, w) in {**first, **every}.items()]))
    rows = code.withColumn("hit", F.explode(hits)).select("hit.pattern", "hit.confidence", "repo_id", "file_path", "uuid", "start_line")
    single = rows.where(F.col("pattern").isin(*first))
    kept = first_per_group(single, ["pattern", "repo_id", "file_path"], ["start_line", "uuid"])
    return kept.unionByName(rows.where(~F.col("pattern").isin(*first))).drop("start_line")


#: Patterns of which a file's entities play one role or several: confidence and roles.
# Confidences, and the words below.
ROLES = {
    "mvc": (0.7, ("model", "view", "controller")),
    "observer": (0.8, ("subject", "observer")),
    "strategy": (0.8, ("strategy", "context")),
    "decorator_pattern": (0.7, ("decorator",)),
    "repository": (0.8, ("repository",)),
    "service_layer": (0.7, ("service",)),
    "extract_class": (0.6, ("function",)),
}


def _played(nodes: DataFrame, code: DataFrame) -> DataFrame:
    """(repo_id, file_path, uuid, start_line, end_line, pattern, role) of the roles that entities could play."""
    low, text = F.lower("name"), F.col("code")
    is_class = F.col("type") == "class"
    role = lambda pattern, name, fits: F.when(fits, F.struct(F.lit(pattern).alias("pattern"), F.lit(name).alias("role")))
    model, view = _any(low, "model", "entity", "data"), _any(low, "view", "template", "ui")
    by_name = [
        role("mvc", "model", is_class & model),
        role("mvc", "view", is_class & ~model & view),
        role("mvc", "controller", is_class & ~model & ~view & _any(low, "controller", "handler", "action")),
        role("extract_class", "function", F.col("type") == "function"),
    ]
    by_code = [
        role("observer", "subject", is_class & _any(text, "observers", "listeners") & _any(text, "notify", "update")),
        role("observer", "observer", is_class & _any(text, "update", "on_notify")),
        role("strategy", "strategy", is_class & _any(low, "strategy", "algorithm", "policy") & _any(text, "execute", "apply", "perform")),
        role("strategy", "context", is_class & F.lower("code").contains("strategy") & _any(text, "set_strategy", "setStrategy")),
        role("decorator_pattern", "decorator", is_class & F.lower("code").contains("component") & _any(text, "delegate", "forward", "proxy")),
        role("repository", "repository", is_class & low.contains("repository") & _any(F.lower("code"), "find", "save", "delete", "create", "update")),
        role("service_layer", "service", is_class & low.contains("service") & _any(F.lower("code"), "process", "handle", "execute", "perform")),
    ]
    columns = ["repo_id", "file_path", "uuid", "start_line", "end_line"]
    rows = nodes.select(*columns, F.explode(F.array_compact(F.array(*by_name))).alias("r")).unionByName(code.select(*columns, F.explode(F.array_compact(F.array(*by_code))).alias("r")))
    return rows.select(*columns, "r.*")


def file_patterns(nodes: DataFrame, code: DataFrame) -> DataFrame:
    """(pattern, confidence, repo_id, file_path, start_line, end_line, entities, evidence) of the detectors that look at the
    entities of a file together: one row for a pattern whose every role is played. entities: how many roles are played in
    all; evidence: how many entities play each role."""
    roles = _played(nodes, code).groupBy("repo_id", "file_path", "pattern", "role").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("a"), F.max("end_line").alias("b"))
    said = F.concat_ws(":", "role", F.col("n").cast("string"))
    files = roles.groupBy("repo_id", "file_path", "pattern").agg(
        F.count(F.lit(1)).alias("roles"), F.max("n").alias("n"), F.min("a").alias("start_line"), F.max("b").alias("end_line"),
        F.sum("n").alias("entities"), F.array_join(F.array_sort(F.collect_list(said)), ",").alias("evidence"),
    )
    wanted = F.coalesce(*[F.when(F.col("pattern") == p, F.struct(F.lit(w).alias("confidence"), F.lit(len(r)).alias("needed"))) for p, (w, r) in ROLES.items()])
    kept = files.withColumn("w", wanted).where((F.col("roles") == F.col("w.needed")) & ((F.col("pattern") != "extract_class") | (F.col("n") > MANY_FUNCTIONS)))
    return kept.select("pattern", "w.confidence", "repo_id", "file_path", "start_line", "end_line", "entities", "evidence")


def pattern_members(nodes: DataFrame, code: DataFrame) -> DataFrame:
    """(pattern, role, repo_id, file_path, uuid): who plays a role in the patterns of file_patterns, one row each."""
    found = file_patterns(nodes, code).select("pattern", "repo_id", "file_path")
    key = ["pattern", "repo_id", "file_path"]
    return _played(nodes, code).join(found, key, "left_semi").select("pattern", "role", "repo_id", "file_path", "uuid")


def idioms(files: DataFrame) -> DataFrame:
    """(pattern, confidence, repo_id, file_path) of language idioms, at most two per file."""
    text, end = F.col("content"), ending("file_path")
    python, js = end == ".py", end.isin(".js", ".ts")
    hits = F.array_compact(
        F.array(
            F.when(python & text.contains("with "), F.struct(F.lit("context_manager").alias("pattern"), F.lit(0.9).alias("confidence"))),
            F.when(python & text.rlike(r"(?d)\[.+for\s+.+in\s+.+\]"), F.struct(F.lit("list_comprehension").alias("pattern"), F.lit(0.8).alias("confidence"))),
            F.when(js & text.contains("=>"), F.struct(F.lit("arrow_function").alias("pattern"), F.lit(0.8).alias("confidence"))),
            F.when(js & text.rlike(r"(?d)(?:const|let|var)\s*\{\s*\w+.*\}\s*="), F.struct(F.lit("destructuring").alias("pattern"), F.lit(0.8).alias("confidence"))),
        )
    )
    once = files.dropDuplicates(["repo_id", "file_path"])
    return once.withColumn("hit", F.explode(hits)).select("hit.pattern", "hit.confidence", "repo_id", "file_path")


def magic_numbers(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, number): every number of two digits or more that stands alone."""
    once = files.dropDuplicates(["repo_id", "file_path"])
    rows = once.select("repo_id", "file_path", F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").rlike(r"\b\d{2,}\b"))
    return rows.select("repo_id", "file_path", (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{2,}\b"), F.lit(0))).alias("number"))


def duplicate_blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(repo_id, file_path, line): the first block of `size` lines of each file that comes again, that many lines or more
    later. Blocks of blank lines only don't count. Files are told by hashes of their blocks, sorted within the row: no
    text and no block is shuffled for it. Null contents have none."""
    once = files.dropDuplicates(["repo_id", "file_path"])
    rows = once.select("repo_id", "file_path", F.split("content", "\n").alias("l_")).where(F.size("l_") >= 2 * size)
    # One array with all that is known of a line, used twice below: what is used once would be put in its place there, and
    # be computed anew for each block.
    rows = rows.select("repo_id", "file_path", F.transform("l_", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.btrim(x, F.lit(BLANKS)) != "").alias("full"))).alias("h_"))
    at = F.sequence(F.lit(1), F.size("h_") - size + 1)
    blocks = F.transform(at, lambda i: F.when(F.exists(F.slice("h_", i, size), lambda x: x["full"]), F.struct(F.xxhash64(F.slice("h_", i, size)).alias("h"), i.alias("n"))))
    rows = rows.select("repo_id", "file_path", F.array_sort(F.array_compact(blocks)).alias("b_"))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(None).cast("bigint").alias("h"), none.alias("first"), none.alias("best"))

    def met(state: Column, block: Column) -> Column:
        same = block["h"].eqNullSafe(state["h"])
        again = same & (block["n"] - state["first"] >= size)
        return F.struct(block["h"].alias("h"), F.when(same, state["first"]).otherwise(block["n"]).alias("first"), F.when(again, F.least(state["first"], state["best"])).otherwise(state["best"]).alias("best"))

    # Files are divided by these keys already. A filter isn't pushed below an aggregation, where it would compute all of
    # the above once more.
    found = rows.groupBy("repo_id", "file_path").agg(F.max(F.aggregate("b_", start, met)["best"]).alias("line"))
    return found.where("line is not null")
