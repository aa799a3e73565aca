"""Language detection by ending, content and mentions, and per-language figures, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import DETECTED_ENDINGS, ending, lookup

# Patterns (multi-line, regardless of case) and weights by language; each pattern counts five times at most.
CONTENT = {
    "python": ((r"^\s*def\s+\w+\s*\(.*\):", 0.8), (r"^\s*class\s+\w+.*:", 0.8), (r"^\s*import\s+\w+", 0.7), (r"^\s*from\s+\w+\s+import", 0.7), (r"^\s*if\s+__name__\s*==\s*[\"']__main__[\"']:", 0.9), (r"print\s*\(", 0.6), (r"^\s*#.*", 0.3)),
    "javascript": ((r"function\s+\w+\s*\(", 0.8), (r"const\s+\w+\s*=", 0.7), (r"let\s+\w+\s*=", 0.7), (r"var\s+\w+\s*=", 0.6), (r"require\s*\(", 0.8), (r"module\.exports", 0.8), (r"console\.log\s*\(", 0.7), (r"=>", 0.6)),
    "typescript": ((r"interface\s+\w+", 0.9), (r"type\s+\w+\s*=", 0.8), (r":\s*\w+(\[\])?(\s*\|\s*\w+)*\s*[=;]", 0.8), (r"function\s+\w+\s*\([^)]*:\s*\w+", 0.8), (r"import.*from\s+[\"']", 0.7), (r"export\s+(default\s+)?", 0.7)),
    "java": ((r"public\s+class\s+\w+", 0.9), (r"public\s+static\s+void\s+main", 0.9), (r"import\s+[\w.]+;", 0.8), (r"package\s+[\w.]+;", 0.8), (r"@\w+", 0.7), (r"System\.out\.println", 0.7)),
    "go": ((r"package\s+\w+", 0.9), (r"func\s+\w+\s*\(", 0.8), (r"import\s*\(", 0.8), (r"fmt\.Print", 0.8), (r"go\s+\w+\s*\(", 0.7), (r"defer\s+", 0.7)),
}
# Mentions (regardless of case) and weights; presence counts.
MENTIONS = {
    "python": ((r"__init__\.py", 0.9), (r"requirements\.txt", 0.8), (r"setup\.py", 0.8), ("pytest", 0.7), ("django|flask|fastapi", 0.6)),
    "javascript": ((r"package\.json", 0.9), ("node_modules", 0.8), ("npm|yarn", 0.7), ("react|vue|angular", 0.6)),
    "typescript": ((r"tsconfig\.json", 0.9), (r"\.d\.ts", 0.8), ("@types/", 0.7)),
    "java": ((r"pom\.xml", 0.9), (r"build\.gradle", 0.8), (r"\.jar", 0.7), ("maven|gradle", 0.6)),
}
# Weights of the ways of detection, confidence of an ending, scores that count as certain.
BY_ENDING, BY_CONTENT, BY_MENTION = 1.0, 1.2, 0.8
ENDING_CONFIDENCE, SURE_CONTENT, SURE_MENTION = 0.9, 10.0, 5.0


def content_score(content: Column, language: str) -> Column:
    total = F.lit(0.0)
    for pattern, weight in CONTENT[language]:
        total = total + F.least(F.regexp_count(content, F.lit(f"(?imd){pattern}")), F.lit(5)) * weight
    return total


def mention_score(content: Column, language: str) -> Column:
    total = F.lit(0.0)
    for pattern, weight in MENTIONS[language]:
        total = total + F.when(content.rlike(f"(?i){pattern}"), weight).otherwise(0.0)
    return total


def _best(scores: dict[str, Column]) -> Column:
    """(score, language) of the highest score above 0; the first of equal ones; null if there is none."""
    structs = [F.struct(F.round(s, 6).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("language")) for i, (k, s) in enumerate(scores.items())]
    top = F.array_max(F.array(*structs))
    return F.when(top["score"] > 0, top)


def detect(files: DataFrame) -> DataFrame:
    """files with language, confidence and method; null contents count as empty."""
    text = F.coalesce("content", F.lit(""))
    rows = files.withColumn("e_", lookup(DETECTED_ENDINGS, ending("file_path"), F.lit(None).cast("string")))
    rows = rows.withColumn("c_", _best({k: content_score(text, k) for k in CONTENT})).withColumn("m_", _best({k: mention_score(text, k) for k in MENTIONS}))
    votes = F.array_compact(
        F.array(
            F.when(F.col("e_").isNotNull(), F.struct(F.col("e_").alias("language"), F.lit(ENDING_CONFIDENCE * BY_ENDING).alias("w"), F.lit("extension").alias("way"))),
            F.when(F.col("c_").isNotNull(), F.struct(F.col("c_.language").alias("language"), (F.least(F.col("c_.score") / SURE_CONTENT, F.lit(1.0)) * BY_CONTENT).alias("w"), F.lit("content").alias("way"))),
            F.when(F.col("m_").isNotNull(), F.struct(F.col("m_.language").alias("language"), (F.least(F.col("m_.score") / SURE_MENTION, F.lit(1.0)) * BY_MENTION).alias("w"), F.lit("heuristic").alias("way"))),
        )
    )
    rows = rows.withColumn("v_", votes)
    sums = F.transform(
        "v_",
        lambda v, i: F.struct(
            F.round(F.aggregate("v_", F.lit(0.0), lambda a, x: a + F.when(x["language"] == v["language"], x["w"]).otherwise(0.0)), 6).alias("score"), (-i).alias("order"), v["language"].alias("language")
        ),
    )
    rows = rows.withColumn("b_", F.array_max(sums))
    return rows.select(
        *files.columns,
        F.coalesce("b_.language", F.lit("unknown")).alias("language"),
        F.when(F.size("v_") > 0, F.least(F.col("b_.score") / F.size("v_"), F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.when(F.size("v_") > 0, F.array_join(F.transform("v_", lambda v: v["way"]), "+")).otherwise("none").alias("method"),
    )


# Figures of Python and of JavaScript text, each a count of a pattern.
PYTHON_FIGURES = {
    "imports": r"import\s+(\w+(?:\.\w+)*)",
    "from_imports": r"from\s+(\w+(?:\.\w+)*)\s+import\s+(.+)",
    "aliased_imports": r"import\s+(\w+(?:\.\w+)*)\s+as\s+(\w+)",
    "decorators": r"@(\w+(?:\.\w+)*)",
    "async_functions": r"async\s+def\s+(\w+)",
    "awaits": r"await\s+(\w+)",
    "list_comprehensions": r"\[.+\s+for\s+.+\s+in\s+.+\]",
    "dict_comprehensions": r"\{.+:\s*.+\s+for\s+.+\s+in\s+.+\}",
    "set_comprehensions": r"\{.+\s+for\s+.+\s+in\s+.+\}",
    "context_managers": r"with\s+(\w+(?:\.\w+)*)",
    "double_quoted_docs": r"(?s)\"\"\".*?\"\"\"",
    "single_quoted_docs": r"(?s)'''.*?'''",
}
JAVASCRIPT_FIGURES = {
    "es6_imports": r"import\s+.+\s+from\s+['\"](.+)['\"]",
    "requires": r"require\s*\(\s*['\"](.+)['\"]\s*\)",
    "exports": r"export\s+(?:default\s+)?(.+)",
    "arrow_functions": r"=>\s*\{|=>\s*\w+",
    "classes": r"class\s+\w+",
    "array_destructuring": r"\[\s*\w+",
    "object_destructuring": r"\{\s*\w+",
    "template_literals": r"`[^`]*\$\{[^}]*\}[^`]*`",
}
# What a text uses if it has a match of every pattern.
PYTHON_FLAGS = {"uses_asyncio": (r"asyncio\.",), "has_type_hints": (r":\s*\w+",), "has_return_annotations": (r"->\s*\w+",), "uses_typing": (r"from\s+typing\s+import",)}
JAVASCRIPT_FLAGS = {"uses_promises": ("Promise",), "uses_async_await": ("async", "await"), "uses_then_catch": (r"\.then\(|\.catch\(",)}
# Names that are listed: pattern and group.
PYTHON_NAMES = {"decorator_names": (r"@(\w+(?:\.\w+)*)", 1), "async_names": (r"async\s+def\s+(\w+)", 1), "await_names": (r"await\s+(\w+)", 1), "context_names": (r"with\s+(\w+(?:\.\w+)*)", 1)}
JAVASCRIPT_NAMES = {"import_names": (r"import\s+.+\s+from\s+['\"](.+)['\"]", 1), "require_names": (r"require\s*\(\s*['\"](.+)['\"]\s*\)", 1), "export_names": (r"export\s+(?:default\s+)?(.+)", 1)}
# What a framework's name or calls look like; each is looked for as it is.
FRAMEWORKS = {
    "python": {"Django": ("django", "models.Model", "HttpResponse"), "Flask": ("flask", "@app.route", "request", "Response"), "FastAPI": ("fastapi", "@app.get", "@app.post", "Depends"), "NumPy": ("numpy", "np.array", "np."), "Pandas": ("pandas", "pd.DataFrame", "pd.")},
    "javascript": {"React": ("React", "useState", "useEffect", "jsx"), "Vue": ("Vue", "v-if", "v-for", "@click"), "Angular": ("@Component", "@Injectable", "ngOnInit"), "Express": ("express", "app.get", "app.post"), "Node.js": ("require", "module.exports", "process.")},
}
# What is known of a language.
FEATURES = {
    "python": ("object-oriented, functional, procedural", "dynamic", True, "Django, Flask, FastAPI, NumPy", "pip, conda, poetry", ".py, .pyw, .pyx", "pytest, unittest, nose"),
    "javascript": ("functional, object-oriented, event-driven", "dynamic", False, "React, Vue, Angular, Express, Node.js", "npm, yarn, pnpm", ".js, .jsx, .mjs", "Jest, Mocha, Jasmine"),
    "typescript": ("object-oriented, functional", "static", False, "Angular, React, Vue, NestJS", "npm, yarn, pnpm", ".ts, .tsx, .d.ts", "Jest, Mocha, Vitest"),
    "java": ("object-oriented", "static", False, "Spring, Hibernate, Struts", "Maven, Gradle", ".java", "JUnit, TestNG"),
    "go": ("procedural, concurrent", "static", False, "Gin, Echo, Fiber", "go mod", ".go", "testing"),
}


@dataclass(frozen=True)
class Analyzer:
    """What is measured in a language's texts: counts, flags and names of patterns, frameworks by their words."""

    counts: Mapping[str, str]
    flags: Mapping[str, Sequence[str]]
    names: Mapping[str, tuple[str, int]]
    frameworks: Mapping[str, Sequence[str]]


#: By language; figures() and capabilities() take others, too.
ANALYZERS: Mapping[str, Analyzer] = {
    "python": Analyzer(PYTHON_FIGURES, PYTHON_FLAGS, PYTHON_NAMES, FRAMEWORKS["python"]),
    "javascript": Analyzer(JAVASCRIPT_FIGURES, JAVASCRIPT_FLAGS, JAVASCRIPT_NAMES, FRAMEWORKS["javascript"]),
}


def figures(files: DataFrame, language: str, analyzers: Mapping[str, Analyzer] = ANALYZERS) -> DataFrame:
    """(repo_id, file_path, counts, flags, names, frameworks) of the files of the language; names in the order they come,
    joined, and repeated as often as they come."""
    endings = [e for e, k in DETECTED_ENDINGS.items() if k == language]
    own = analyzers[language]
    rows = files.where(ending("file_path").isin(*endings) & F.col("content").isNotNull())
    text = F.col("content")

    def mentions(words: Sequence[str]) -> Column:
        out = text.contains(words[0])
        for w in words[1:]:
            out = out | text.contains(w)
        return out

    def uses(patterns: Sequence[str]) -> Column:
        out = text.rlike(f"(?d){patterns[0]}")
        for p in patterns[1:]:
            out = out & text.rlike(f"(?d){p}")
        return out

    known = F.array_compact(F.array(*[F.when(mentions(w), F.lit(n)) for n, w in own.frameworks.items()]))
    return rows.select(
        "repo_id",
        "file_path",
        *[F.regexp_count("content", F.lit(f"(?d){p}")).alias(n) for n, p in own.counts.items()],
        *[uses(p).alias(n) for n, p in own.flags.items()],
        *[F.array_join(F.regexp_extract_all("content", F.lit(f"(?d){p}"), F.lit(g)), ",").alias(n) for n, (p, g) in own.names.items()],
        F.array_join(known, ",").alias("frameworks"),
    )


def capabilities(spark: SparkSession, parsed: Sequence[str] = ("python", "javascript"), analyzers: Mapping[str, Analyzer] = ANALYZERS) -> DataFrame:
    """(language, paradigms, typing, indentation_matters, frameworks, package_managers, endings, test_frameworks,
    has_analyzer, has_parser, depth): what is known and can be done of each language that is detected."""
    names = "language string, paradigms string, typing string, indentation_matters boolean, frameworks string, package_managers string, endings string, test_frameworks string, has_analyzer boolean, has_parser boolean, depth string"
    languages = sorted(set(DETECTED_ENDINGS.values()))
    rows = [(k, *FEATURES.get(k, (None,) * 7), k in analyzers, k in parsed, "full" if k in analyzers else "basic") for k in languages]
    return spark.createDataFrame(rows, names)
