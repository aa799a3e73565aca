"""From source files to entities, imports, calls and links.

Parsing runs in Arrow batches, one file at a time; everything after it is joins. A file that doesn't parse, or is nested
too deep to be walked, gives no rows. Each call counts once. Order, where the first candidate wins, is file path, then
position in the file.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import auto_tags, importance
from codeloom.functions.paths import ending, module_name, plain_path
from codeloom.session import cut, once

# Calls that are noise unless the name is imported.
BUILTINS = frozenset("print len str int float list dict set tuple bool range enumerate zip min max sum abs round".split())
EXTERNALS = frozenset("random os sys logging json requests flask django".split())
NO_FUNCTIONS = ("if", "for", "while", "switch", "catch")

_ENTITY = [("kind", "string"), ("ordinal", "int"), ("name", "string"), ("type", "string"), ("line", "int"), ("end_line", "int"), ("docstring", "string"), ("context", "string"), ("extra", "string"), ("details", "string")]


class _Reader(ast.NodeVisitor):
    """Rows of one Python file: (kind, name, type, line, end line, docstring, context, extra, details), in order.

    kind: entity, import (name: alias, extra: full name), call (name: callee, context: the innermost function around it,
    else the innermost class, else "module"), contains (a function and whether a class or the module holds it), base
    (class, base). details: JSON of what else is known about a function or class.
    """

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.rows: list[tuple] = []
        self.scope: list[tuple[str, str]] = []
        self.imports: dict[str, str] = {}

    def add(self, kind: str, name: str, type_: str | None = None, node: ast.AST | None = None, doc: str | None = None, extra: str | None = None, details: dict | None = None, context: str | None = None) -> None:
        context = context or ".".join(n for n, _ in self.scope) or "module"
        self.rows.append((kind, name, type_, getattr(node, "lineno", None), self.end_line(node), doc, context, extra, json.dumps(details) if details else None))

    def end_line(self, node: ast.AST | None) -> int | None:
        """Where the node ends; if the parser doesn't say, before the next line that isn't indented."""
        if node is None or getattr(node, "end_lineno", None):
            return getattr(node, "end_lineno", None)
        for n, line in enumerate(self.lines[node.lineno :], node.lineno + 1):
            if line.strip() and line[0] not in " \t":
                return n - 1
        return len(self.lines)

    def innermost(self, *types: str) -> str | None:
        return next((n for n, t in reversed(self.scope) if t in types), None)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports[a.asname or a.name] = a.name
            self.add("import", a.asname or a.name, None, node, None, a.name)
            self.add("entity", a.name, "import", node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            full = f"{node.module or ''}.{a.name}".strip(".")
            for alias in dict.fromkeys((a.asname or a.name, a.name)):
                self.imports[alias] = full
                self.add("import", alias, None, node, None, full)
            self.add("entity", full, "import", node)

    def _definition(self, node, type_: str, extra: str | None, details: dict) -> None:
        self.add("entity", node.name, type_, node, ast.get_docstring(node), extra, details)
        self.scope.append((node.name, type_))
        self.generic_visit(node)
        self.scope.pop()

    def _function(self, node, extra: str | None) -> None:
        self.add("contains", node.name, None, node, context="class" if self.innermost("class") else "module")
        self._definition(node, "function", extra, {"is_async": extra is not None, "parameters": [a.arg for a in node.args.args]})

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._function(node, None)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._function(node, "async")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for base in node.bases:
            if isinstance(base, ast.Name):
                self.add("base", node.name, None, node, None, base.id)
        self._definition(node, "class", None, {"base_classes": [ast.unparse(b) for b in node.bases]})

    def visit_Call(self, node: ast.Call) -> None:
        for name in self.callees(node):
            root = name.partition(".")[0]
            if root in self.imports or (name not in BUILTINS and root not in EXTERNALS):
                self.add("call", name, None, node, context=self.innermost("function") or self.innermost("class"))
        self.generic_visit(node)

    def callees(self, node: ast.Call) -> list[str]:
        f, out = node.func, []
        if isinstance(f, ast.Name):
            out.append(f.id)
        elif isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Name):
                out += [f"{f.value.id}.{f.attr}", f.attr]
                if f.value.id in self.imports:
                    out.append(f"{self.imports[f.value.id]}.{f.attr}")
            elif isinstance(f.value, ast.Subscript) and isinstance(f.value.slice, ast.Constant) and isinstance(f.value.slice.value, str):
                out += [f.value.slice.value, f.attr]
            else:
                out.append(f.attr)
        for arg in node.args:
            if isinstance(arg, ast.Dict):
                out += [v.id for k, v in zip(arg.keys, arg.values) if isinstance(k, ast.Constant) and isinstance(k.value, str) and isinstance(v, ast.Name)]
        return list(dict.fromkeys(out))


def read_python(content: str | None) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content or "")
        lines = (content or "").split("\n")
        reader = _Reader(lines)
        reader.visit(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [*reader.rows, ("entity", "", "module", 1, len(lines), ast.get_docstring(tree), "module", None, None)]


_JS_CLASS = re.compile(r"class\s+(\w+)\s*(?:extends\s+\w+)?\s*\{")
_JS_FUNCTIONS = (
    ("function", re.compile(r"function\s+(\w+)\s*\(")),
    ("method", re.compile(r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{")),
    ("arrow_function", re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>")),
)


def read_javascript(content: str | None) -> list[tuple]:
    """Classes and functions by their form; one name may be found by two of them. The end line is the first."""
    text = content or ""
    line = lambda m: text.count("\n", 0, m.start()) + 1
    out = [("entity", m[1], "class", line(m), line(m), None, "module", "class", None) for m in _JS_CLASS.finditer(text)]
    for kind, pattern in _JS_FUNCTIONS:
        out += [("entity", m[1], "function", line(m), line(m), None, "module", kind, None) for m in pattern.finditer(text) if m[1] not in NO_FUNCTIONS]
    return out


#: A reader of one file: text -> rows as _Reader's, by ending. parse() takes others, too.
Reader = Callable[[str], list[tuple]]
READERS: Mapping[str, Reader] = {".py": read_python, ".js": read_javascript, ".jsx": read_javascript, ".ts": read_javascript, ".tsx": read_javascript}


def parse(files: DataFrame, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """(repo_id, file_path, kind, ordinal, name, type, line, end_line, docstring, context, extra, details) of the files for
    whose endings there is a reader."""
    rows = files.where(ending("file_path").isin(*readers) & F.col("content").isNotNull()).select("repo_id", plain_path("file_path").alias("file_path"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, out = [], []
            for i, (path, text) in enumerate(zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist())):
                rows = readers["." + path.rpartition(".")[2].lower()](text.replace("\r\n", "\n"))
                took += [i] * len(rows)
                out += [(r[0], k, *r[1:]) for k, r in enumerate(rows)]
            keys = batch.select(["repo_id", "file_path"]).take(pa.array(took, pa.int64()))
            kinds = {"string": pa.string(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array([o[i] for o in out], kinds[t]) for i, (_, t) in enumerate(_ENTITY))], names=["repo_id", "file_path", *(n for n, _ in _ENTITY)])

    return once(rows, ["repo_id", "file_path"]).mapInArrow(run, "repo_id string, file_path string, " + ", ".join(f"{n} {t}" for n, t in _ENTITY))


def parsed_entities(parsed: DataFrame) -> DataFrame:
    """Entities with an id that follows from what they are, the name of modules from their path, and tags."""
    rows = parsed.where("kind = 'entity'").withColumn("name", F.when(F.col("type") == "module", module_name("file_path")).otherwise(F.col("name")))
    uuid = F.sha2(F.concat_ws("|", "repo_id", "file_path", "type", "name", F.col("line").cast("string"), F.col("ordinal").cast("string")), 256)
    tags = F.concat(auto_tags(F.col("name"), F.col("type")), F.when(F.col("extra") == "async", F.array(F.lit("ASYNC"))).otherwise(F.array().cast("array<string>")))
    return rows.select(uuid.alias("uuid"), "repo_id", "file_path", "type", "name", F.col("line").alias("start_line"), "end_line", "docstring", tags.alias("tags"), "context", "ordinal", F.col("details").alias("metadata"))


# The tag of each kind of definition.
TAGS = {"class": "definition.class", "function": "definition.function", "method": "definition.method", "arrow_function": "definition.function"}


def tags(parsed: DataFrame) -> DataFrame:
    """(repo_id, file_path, tag, name, line): definitions of classes, functions and methods, and, in Python, the names that
    are called, each place once. A JavaScript form is told by `extra`; its constructors are no methods of their own."""
    form = F.when(F.col("extra").isin(*TAGS), F.col("extra")).otherwise(F.col("type"))
    tag = F.coalesce(*[F.when(form == k, F.lit(v)) for k, v in TAGS.items()])
    found = parsed.where("kind = 'entity'").select("repo_id", "file_path", tag.alias("tag"), "name", "line")
    found = found.where(F.col("tag").isNotNull() & ~((F.col("tag") == "definition.method") & (F.col("name") == "constructor")))
    called = parsed.where("kind = 'call'").select("repo_id", "file_path", F.lit("reference.call").alias("tag"), F.element_at(F.split("name", r"\."), -1).alias("name"), "line")
    return found.unionByName(called).distinct()


def entity_keys(entities: DataFrame) -> DataFrame:
    """(repo_id, key, uuid, file_path, ordinal, name, place): the keys each entity answers to; the last one registered holds
    a key, whose place among the keys is where the first one was registered."""
    module = module_name("file_path")
    own = F.array(F.concat_ws(":", "file_path", "name"), F.col("name"))
    more = F.when(F.col("type").isin("class", "function"), F.array(F.concat_ws(".", module, "name"))).otherwise(F.array().cast("array<string>"))
    inner = F.when((F.col("type") == "function") & (F.col("context") != "module"), F.array(F.concat_ws(".", "context", "name"), F.concat_ws(".", module, "context", "name"))).otherwise(F.array().cast("array<string>"))
    rows = entities.select("repo_id", "uuid", "file_path", "ordinal", "name", F.posexplode(F.array_distinct(F.concat(own, more, inner))).alias("k", "key"))
    last = F.max_by(F.struct("uuid", "file_path", "ordinal", "name"), F.struct("file_path", "ordinal")).alias("e")
    first = F.min(F.struct("file_path", "ordinal", "k")).alias("place")
    return rows.groupBy("repo_id", "key").agg(last, first).select("repo_id", "key", "e.uuid", "e.file_path", "e.ordinal", "e.name", "place")


def local_links(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, src, dst, line): calls of an entity of the same file, by name; the first of a name, no self-links."""
    first = entities.where("type in ('function', 'class')").groupBy("repo_id", "file_path", "name").agg(F.min_by("uuid", "ordinal").alias("uuid"))
    calls = parsed.where("kind = 'call'").select("repo_id", "file_path", F.col("context").alias("caller"), F.col("name").alias("callee"), "line")
    src = first.select("repo_id", "file_path", F.col("name").alias("caller"), F.col("uuid").alias("src"))
    dst = first.select("repo_id", "file_path", F.col("name").alias("callee"), F.col("uuid").alias("dst"))
    met = calls.join(src, ["repo_id", "file_path", "caller"]).join(dst, ["repo_id", "file_path", "callee"])
    return met.where("src <> dst").groupBy("repo_id", "src", "dst").agg(F.min("line").alias("line"))


GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The distinct parts of the text of that many characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def containing_keys(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(repo_id, callee, tier, uuid): of the keys that contain a name, or whose entity's name does, the best.

    A key that ends with a name that has a dot comes first (tier 2), then (tier 3) one that ends with a dot and the name,
    an entity whose name contains it, and another key that does; of equal ones the first registered. Every text that contains a name has the name's rarest part of three characters (a
    shorter name is its own part), so parts meet in an equi-join and no name is compared with all keys.
    """
    texts = keys.select("repo_id", "uuid", "name", "key", "place", F.length("key").alias("n"))
    size = F.least(F.length("callee"), F.lit(GRAM))
    asked = names.where(F.length("callee") > 0).select("repo_id", "callee", size.alias("size"))
    sizes = asked.select("repo_id", "size").distinct()
    spread = texts.join(sizes, "repo_id").where("n >= size").select("repo_id", "uuid", "name", "key", "place", "size", F.explode(_grams(F.col("key"), F.col("size"))).alias("gram"))
    spread = cut(spread)
    weight = spread.groupBy("repo_id", "gram").agg(F.count(F.lit(1)).alias("w"))
    parts = asked.select("repo_id", "callee", F.explode(_grams(F.col("callee"), F.col("size"))).alias("gram"))
    rarest = parts.join(weight, ["repo_id", "gram"], "left").groupBy("repo_id", "callee").agg(F.min(F.struct(F.coalesce("w", F.lit(0)), "gram"))["gram"].alias("gram"))
    met = rarest.join(spread, ["repo_id", "gram"]).where(F.col("key").contains(F.col("callee")))
    score = F.when(F.col("callee").contains(".") & F.col("key").endswith(F.col("callee")), 100).when(F.col("key").endswith(F.concat(F.lit("."), F.col("callee"))), 80).when(F.col("name").contains(F.col("callee")), 60).otherwise(40)
    best = met.groupBy("repo_id", "callee").agg(F.min(F.struct((-score).alias("s"), "place", "uuid")).alias("b"))
    return best.select("repo_id", "callee", F.when(F.col("b.s") == -100, 2).otherwise(3).alias("tier"), F.col("b.uuid").alias("uuid"))


def resolve_calls(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, src, dst, line, tier) of calls that resolve to an entity anywhere in the repository.

    The caller is tried as file:context, as a key "context" that is of the file, by module.context, as the first entity of
    the file with that name, then as the file's module. The callee is tried by exact key (tier 0), then, with a dot in it,
    by its last segment (1) and by the first registered key that ends with it (2), then by the best key that contains it
    (3), then through the file's imports (4).
    """
    keys = cut(entity_keys(entities))
    calls = cut(parsed.where("kind = 'call'").select("repo_id", "file_path", "context", F.col("name").alias("callee"), "line").distinct())

    callers = calls.select("repo_id", "file_path", "context").distinct()
    module = module_name("file_path")
    tried = F.array(F.concat_ws(":", "file_path", "context"), F.col("context"), F.concat_ws(".", module, "context"), F.lit(None).cast("string"), F.concat_ws(":", "file_path", module), module)
    found = callers.select("repo_id", F.col("file_path").alias("home"), "context", F.posexplode(tried).alias("tier", "key")).where("key is not null")
    found = found.join(keys.select("repo_id", "key", "uuid", "file_path"), ["repo_id", "key"]).where("tier <> 1 or file_path = home")
    named = entities.groupBy("repo_id", F.col("file_path").alias("home"), F.col("name").alias("context")).agg(F.min_by("uuid", "ordinal").alias("uuid"))
    local = callers.withColumnRenamed("file_path", "home").join(named, ["repo_id", "home", "context"]).withColumn("tier", F.lit(3))
    columns = ["repo_id", "home", "context", "tier", "uuid"]
    src = found.select(*columns).unionByName(local.select(*columns)).groupBy("repo_id", F.col("home").alias("file_path"), "context").agg(F.min_by("uuid", "tier").alias("src"))

    names = cut(calls.select("repo_id", "callee").distinct())
    dotted = F.col("callee").contains(".")
    segment = F.when(dotted, F.element_at(F.split("callee", r"\."), -1))
    exact = names.select("repo_id", "callee", F.posexplode(F.array(F.col("callee"), segment)).alias("tier", "key")).where("key is not null").join(keys.select("repo_id", "key", "uuid"), ["repo_id", "key"])
    tiers = cut(exact.select("repo_id", "callee", "tier", "uuid"))
    part = containing_keys(names.join(tiers, ["repo_id", "callee"], "left_anti"), keys)
    tiers = tiers.unionByName(part)
    dst = tiers.groupBy("repo_id", "callee").agg(F.min(F.struct("tier", "uuid")).alias("t")).select("repo_id", "callee", "t.tier", F.col("t.uuid").alias("dst"))

    met = cut(calls.join(src, ["repo_id", "file_path", "context"]).join(dst, ["repo_id", "callee"], "left"))
    direct = met.where("dst is not null").select("repo_id", "src", "dst", "line", "tier")
    brought = parsed.where("kind = 'import'").groupBy("repo_id", "file_path", F.col("name").alias("alias")).agg(F.max_by("extra", "ordinal").alias("full"))
    rest = met.where("dst is null").select("repo_id", "file_path", "src", "callee", "line").withColumn("alias", F.element_at(F.split("callee", r"\."), 1))
    through = rest.join(brought, ["repo_id", "file_path", "alias"]).withColumn("key", F.concat(F.col("full"), F.expr("substring(callee, length(alias) + 1)")))
    late = through.join(keys.select("repo_id", "key", F.col("uuid").alias("dst")), ["repo_id", "key"]).select("repo_id", "src", "dst", "line", F.lit(4).alias("tier"))
    all_ = direct.unionByName(late).where("src <> dst")
    return all_.groupBy("repo_id", "src", "dst").agg(F.min("line").alias("line"), F.min("tier").alias("tier"))


def ranked_links(resolved: DataFrame, ranks: DataFrame) -> DataFrame:
    """(repo_id, from_uuid, to_uuid, type, properties): resolved calls as links, with line and the ranks of both ends
    (repo_id, uuid, importance); 0 for what has none."""
    side = lambda c, n: ranks.select(F.col("uuid").alias(c), F.col("importance").alias(n))
    met = resolved.join(side("src", "a"), "src", "left").join(side("dst", "b"), "dst", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    said = F.to_json(F.struct("line", F.lit(True).alias("cross_file"), zero("a").alias("caller_rank"), zero("b").alias("callee_rank")))
    return met.select("repo_id", F.col("src").alias("from_uuid"), F.col("dst").alias("to_uuid"), F.lit("calls").alias("type"), said.alias("properties"))


def inheritance_links(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, src, dst) from each class to the base of that name, in the same file if there, else the first."""
    classes = entities.where("type = 'class'").select("repo_id", "file_path", "name", "uuid")
    bases = parsed.where("kind = 'base'").select("repo_id", "file_path", "name", F.col("extra").alias("base")).distinct()
    src = bases.join(classes.select("repo_id", "file_path", "name", F.col("uuid").alias("src")), ["repo_id", "file_path", "name"])
    # Both ways are lookups of one row: the best of a name in the file, and the two best of the repository, one of which
    # isn't the class itself.
    here = classes.groupBy("repo_id", "file_path", F.col("name").alias("base")).agg(F.slice(F.array_sort(F.collect_set("uuid")), 1, 2).alias("near"))
    rank = F.row_number().over(W.partitionBy("repo_id", "name").orderBy("file_path", "uuid"))
    first = classes.withColumn("r_", rank).where("r_ <= 2").groupBy("repo_id", F.col("name").alias("base")).agg(F.array_sort(F.collect_list(F.struct("r_", "uuid")))["uuid"].alias("far"))
    met = src.join(here, ["repo_id", "file_path", "base"], "left").join(first, ["repo_id", "base"], "left")
    other = lambda c: F.get(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != F.col("src")), F.lit(0))
    return met.select("repo_id", "src", F.coalesce(other("near"), other("far")).alias("dst")).where("dst is not null")


def call_counts(parsed: DataFrame) -> DataFrame:
    """(repo_id, name, calls) by the callee's name."""
    return parsed.where("kind = 'call'").groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("calls"))


def ranked(entities: DataFrame, links: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo_id, uuid, name, importance): the heuristic rank, divided by the largest of the repository."""
    incoming = links.groupBy(F.col("dst").alias("uuid")).agg(F.count(F.lit(1)).alias("n_in"))
    rows = entities.join(incoming, "uuid", "left").join(calls, ["repo_id", "name"], "left")
    raw = importance(F.col("name"), F.col("type"), F.col("file_path"), F.coalesce("calls", F.lit(0)), F.coalesce("n_in", F.lit(0)))
    rows = rows.select("repo_id", "uuid", "name", raw.alias("raw"))
    top = rows.groupBy("repo_id").agg(F.max("raw").alias("top"))
    return rows.join(top, "repo_id").select("repo_id", "uuid", "name", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.col("raw")).alias("importance"))


def counters(parsed: DataFrame, files: DataFrame, links: DataFrame | None = None, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """(repo_id, files, entities, imports, calls, edges, errors) of an ingest.

    Files that failed to parse count as files and as errors; a file without content that has a reader for its ending can't
    fail. links: (repo_id, ...) of the ingest, for edges.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    per = parsed.groupBy("repo_id").agg(kind("entity").alias("entities"), kind("import").alias("imports"), kind("call").alias("calls"))
    modules = parsed.where("type = 'module'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("good"))
    python = F.count_if((ending("file_path") == ".py") & F.col("content").isNotNull()).alias("python")
    once = files.where(ending("file_path").isin(*readers)).select("repo_id", plain_path("file_path").alias("file_path"), "content").dropDuplicates(["repo_id", "file_path"])
    rows = once.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), python).join(per, "repo_id", "left").join(modules, "repo_id", "left")
    if links is not None:
        rows = rows.join(links.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges")), "repo_id", "left")
    else:
        rows = rows.withColumn("edges", F.lit(0).cast("bigint"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    errors = F.greatest(F.col("python") - F.coalesce("good", F.lit(0)), F.lit(0)).alias("errors")
    return rows.select("repo_id", "files", zero("entities"), zero("imports"), zero("calls"), zero("edges"), errors)
