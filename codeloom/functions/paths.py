"""File paths and the languages their endings stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each ending in language statistics.
LANGUAGE_OF_ENDING = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php",
    ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r", ".html": "html", ".css": "css",
    ".scss": "scss", ".json": "json", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml", ".md": "markdown", ".sql": "sql", ".sh": "shell",
}
# Language of each ending in language detection.
DETECTED_ENDINGS = {
    ".py": "python", ".pyw": "python", ".pyx": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp",
    ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".phtml": "php", ".rb": "ruby", ".rbw": "ruby",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sc": "scala",
}


def plain_path(path: Column | str) -> Column:
    """With forward slashes and without a leading ./"""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def relative_path(path: Column | str, root: str) -> Column:
    """Relative to root, with forward slashes."""
    path = F.col(path) if isinstance(path, str) else path
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file:(?://)?", "")
    prefix = root.rstrip("/") + "/"
    return F.when(plain.startswith(prefix), plain.substr(F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column | str) -> Column:
    """How many separators the path has."""
    return F.size(F.split(path, "/")) - 1


def ending(path: Column | str) -> Column:
    """The lower-case ending with its dot; empty if there is none. A leading dot starts no ending."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def lookup(values: dict[str, str], key: Column, default: Column) -> Column:
    """A literal map's value, for tables of a few dozen entries."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def module_name(path: Column | str) -> Column:
    """Dotted; every ".py" is taken out."""
    path = F.col(path) if isinstance(path, str) else path
    return F.replace(F.replace(path, F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))


def language(path: Column | str) -> Column:
    return lookup(LANGUAGE_OF_ENDING, ending(path), F.lit("other"))
