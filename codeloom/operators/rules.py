"""Rules over source text: a dimension of patterns, plus callables for what a pattern can't say.

The JVM finds which patterns occur in which files; Arrow batches then locate every match of those, and run the callables.
A rule applies to its languages ("*": all), unless rules are named explicitly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import DETECTED_ENDINGS, ending, lookup
from codeloom.session import once

Matcher = Callable[[str], list[tuple[int, str, str, str | None]]]


@dataclass(frozen=True)
class Rule:
    """matcher: content -> (offset, matched text, message, suggestion) of each match.

    jvm: a pattern for the JVM that occurs in every text in which the rule matches; by default the pattern itself.
    """

    id: str
    kind: str
    severity: str
    languages: tuple[str, ...]
    message: str
    pattern: str | None = None
    matcher: Matcher | None = None
    jvm: str | None = None
    enabled: bool = True


def missing_docstrings(content: str) -> list[tuple[int, str, str, str | None]]:
    """Functions without a string among the next five lines; names that begin with _ are left alone."""
    lines, out = content.split("\n"), []
    # Fixed values, as in the two matchers below: the forms looked for.
    for m in re.finditer(r"^\s*def\s+(\w+)\s*\(", content, re.M):
        n = content.count("\n", 0, m.start()) + 1
        for line in map(str.strip, lines[n : n + 5]):
            if line.startswith(('"""', "'''")):
                break
            if line and not line.endswith(":"):
                line = ""
                break
        else:
            line = ""
        if not line.startswith(('"""', "'''")) and not m[1].startswith("_"):
            out.append((m.start(), m[0], f"function {m[1]} has no docstring", "document the function"))
    return out


def list_comprehensions(content: str) -> list[tuple[int, str, str, str | None]]:
    found = re.finditer(r"(\w+)\s*=\s*\[\]\s*\n\s*for\s+(\w+)\s+in\s+(.+):\s*\n\s*\1\.append\((.+)\)", content)
    return [(m.start(), m[0], "the loop builds a list", f"{m[1]} = [{m[4]} for {m[2]} in {m[3]}]") for m in found]


# What adds to a function's complexity, and from where on it is high.
BRANCHES = ("if ", "elif ", "else:", "for ", "while ", "try:", "except", "with ", "and ", "or ", "not ")
MOST_BRANCHES = 10


def complex_functions(content: str) -> list[tuple[int, str, str, str | None]]:
    out = []
    for m in re.finditer(r"def\s+(\w+)\s*\(.*?\):(.+?)(?=\ndef|\nclass|\Z)", content, re.S):
        n = sum(map(m[2].count, BRANCHES))
        if n > MOST_BRANCHES:
            out.append((m.start(), f"def {m[1]}", f"function {m[1]} has complexity {n}", "split the function"))
    return out


# The rules.
RULES = (
    Rule("python_bare_except", "anti_pattern", "warning", ("python",), "bare except", r"except\s*:"),
    Rule("python_missing_docstring", "code_quality", "info", ("python",), "function without docstring", r"def\s+[a-zA-Z_]\w*\s*\([^)]*\):\s*\n(?!\s*\"\"\"|\s*''')"),
    Rule("python_list_comprehension", "code_quality", "info", ("python",), "loop that builds a list", r"\w+\s*=\s*\[\]\s*\n\s*for\s+\w+\s+in\s+.+:\s*\n\s*\w+\.append\("),
    Rule("js_var_usage", "anti_pattern", "warning", ("javascript", "typescript"), "var declaration", r"\bvar\s+\w+"),
    Rule("js_missing_semicolon", "code_quality", "info", ("javascript", "typescript"), "line without semicolon", r"[^;\s]\s*\n\s*[^\/\*\s]"),
    Rule("long_lines", "code_quality", "info", ("*",), "line of more than 120 characters", r".{121,}"),
    Rule("todo_comments", "code_quality", "info", ("*",), "open task", r"(?:#|//|/\*)\s*TODO\s*:?\s*(.+)"),
    Rule("complex_function", "code_quality", "warning", ("*",), "long function", r"def\s+\w+\([^)]*\):[^}]{200,}"),
    Rule("hardcoded_secret", "security", "error", ("*",), "secret in the source", r"(?:password|secret|key|token)\s*[=:]\s*['\"][^'\"]{8,}['\"]"),
    Rule("semantic_missing_docstring", "semantic", "info", ("python",), "", matcher=missing_docstrings, jvm=r"\bdef\s"),
    Rule("semantic_list_comprehension", "semantic", "info", ("python",), "", matcher=list_comprehensions, jvm=r"\.append\("),
    Rule("semantic_complexity", "semantic", "warning", ("python",), "", matcher=complex_functions, jvm=r"def\s+\w+"),
)


def with_enabled(rules: Sequence[Rule], ids: Sequence[str], enabled: bool) -> tuple[Rule, ...]:
    return tuple(replace(r, enabled=enabled) if r.id in ids else r for r in rules)


def chosen(rules: Sequence[Rule], ids: Sequence[str] | None = None, kind: str | None = None, severity: str | None = None) -> tuple[Rule, ...]:
    """Enabled rules, of a kind or severity; or those with the ids, whatever their languages."""
    if ids is not None:
        return tuple(replace(r, languages=("*",)) for r in rules if r.id in ids)
    return tuple(r for r in rules if r.enabled and kind in (None, r.kind) and severity in (None, r.severity))


def _occurs(rule: Rule) -> Column:
    """Whether the rule can match in content at all."""
    fits = F.lit(True) if "*" in rule.languages else F.col("language").isin(*rule.languages)
    pattern = rule.jvm or rule.pattern
    # (?U): letters and digits of all scripts, as Arrow's side has them; (?d): only \n ends a line.
    return fits & F.col("content").rlike(f"(?mUd){pattern}") if pattern else fits


def matches(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule_id, severity, repo_id, file_path, line, column, matched, context, message, suggestion): every match of every
    rule over whole texts, each file once. A matcher that fails has no matches; null contents have none."""
    rules = tuple(r for r in rules if r.enabled)
    language = lookup(DETECTED_ENDINGS, ending("file_path"), F.lit("unknown"))
    rows = files.where("content is not null").select("repo_id", "file_path", language.alias("language"), "content")
    # The numbers of the rules to run on a file; files without any go no further.
    due = F.array_compact(F.array(*[F.when(_occurs(r), F.lit(i)) for i, r in enumerate(rules)]))
    rows = rows.withColumn("due", due).where(F.size("due") > 0).select("repo_id", "file_path", "due", "content")
    names = ["rule_id", "severity", "repo_id", "file_path", "line", "column", "matched", "context", "message", "suggestion"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern, re.M) if r.pattern else None) for r in rules]
        for batch in batches:
            out: list[tuple] = []
            for repo, path, due, text in zip(*(c.to_pylist() for c in batch.columns)):
                for r, pattern in (compiled[i] for i in due):
                    try:
                        found = [(m.start(), m[0], r.message, None) for m in pattern.finditer(text)] if pattern else r.matcher(text)
                    except Exception:  # noqa: BLE001
                        found = []
                    line, seen = 1, 0
                    for at, matched, message, suggestion in sorted(found, key=lambda f: f[0]):
                        line, seen = line + text.count("\n", seen, at), at
                        start = text.rfind("\n", 0, at) + 1
                        end = text.find("\n", at)
                        context = text[start : end if end >= 0 else len(text)].strip()
                        out.append((r.id, r.severity, repo, path, line, at - start + 1, matched, context, message, suggestion))
            kinds = [pa.int32() if n in ("line", "column") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return once(rows, ["repo_id", "file_path"]).mapInArrow(run, ", ".join(f"`{n}` {'int' if n in ('line', 'column') else 'string'}" for n in names))
