"""Scores and tags derived from names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.paths import base_name, depth

#: A name less similar than this is no match.
SIMILAR = 0.6


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lower-cased names; pairs whose lengths rule out a match are not compared."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = x.lower(), y.lower()
        if 2.0 * min(len(x), len(y)) < SIMILAR * (len(x) + len(y)):
            return 0.0
        return SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def can_be_similar(a: Column, b: Column) -> Column:
    """Whether two names could be SIMILAR: twice the letters they share, each as often as in both, are no less than that
    part of all. A bound for the JVM, so that few pairs need the sequences compared; null for null names."""
    a, b = F.lower(a), F.lower(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(b, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    whole = F.length(a) + F.length(b)
    return (2 * F.least(F.length(a), F.length(b)) >= SIMILAR * whole) & (2 * shared >= SIMILAR * whole)


def exact_score(name: Column, wanted: str) -> Column:
    """1 for the name itself, .9 for a prefix, .7 for a part, null beyond that; regardless of case."""
    n, w = F.lower(name), wanted.lower()
    return F.when(n == w, 1.0).when(n.startswith(w), 0.9).when(n.contains(w), 0.7)


# Weights of relevance.
TYPE_WEIGHT = {"function": 1.0, "async_function": 1.0, "class": 0.9, "import": 0.3, "variable": 0.5}
USEFUL_TAGS = ("API", "SERVICE", "DATABASE", "UTILITY")
# Words that earn a name a tag.
TAG_WORDS = {
    "API": ("api", "endpoint", "route", "handler", "view"),
    "DATABASE": ("db", "database", "model", "table", "sql", "query"),
    "UTILITY": ("util", "helper", "common", "shared"),
    "CONFIG": ("config", "setting", "env", "constant"),
    "TEST": ("test", "mock", "fixture"),
    "SERVICE": ("service", "client", "manager"),
    "EXCEPTION": ("error", "exception", "raise"),
    "ASYNC": ("async", "await", "coroutine"),
}
# Importance of types, of words in file names and of words in names.
IMPORTANCE_OF_TYPE = {"function": 0.3, "class": 0.4, "module": 0.2, "import": 0.1}
FILE_WORDS = ((0.3, "main|app|core|manager"), (0.2, "api|server|client"), (0.1, "util|helper|common"))
STARTING_WORDS = "main|init|setup|start|run"
# Weights of link types.
LINK_WEIGHT = {"calls": 1.0, "imports": 0.8, "inherits": 1.2, "defines": 0.6, "uses": 0.4}
# Priorities of file names.
PRIORITY_WORDS = ((100, "main|app|core|base|manager"), (80, "api|client|server|handler|controller"), (70, "model|schema|entity|data"), (60, "service|logic|processor|engine"), (40, "util|helper|common|shared"))


def _cases(values: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def relevance(type_: Column, docstring: Column, tags: Column, path: Column) -> Column:
    """Type weight, .2 for documentation, .3 for a useful tag, and .1 for each level the path is less than five deep."""
    documented = F.when(F.coalesce(F.length(docstring) > 0, F.lit(False)), 0.2).otherwise(0.0)
    useful = F.when(F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in USEFUL_TAGS])), F.lit(False)), 0.3).otherwise(0.0)
    return _cases(TYPE_WEIGHT, type_, 0.5) + documented + useful + F.greatest(F.lit(0.0), (F.lit(5) - depth(path)) * 0.1)


def auto_tags(name: Column, type_: Column) -> Column:
    """The type in upper case, a tag per group of words the name has one of, and those of its form; tags may repeat."""
    low = F.lower(name)
    by_word = [F.when(low.rlike("|".join(words)), F.lit(tag)) for tag, words in TAG_WORDS.items()]
    form = F.when(type_ == "function", F.when(name.startswith("test_"), F.lit("TEST")).when(name.startswith("_"), F.lit("PRIVATE"))).when(
        type_ == "class", F.when(name.rlike("(?:Error|Exception)$"), F.lit("EXCEPTION")).when(name.endswith("Test"), F.lit("TEST"))
    )
    return F.array_compact(F.array(F.upper(type_), *by_word, form))


def link_weight(type_: Column) -> Column:
    return _cases(LINK_WEIGHT, type_, 1.0)


def importance(name: Column, type_: Column, path: Column, calls: Column, incoming: Column) -> Column:
    """.1 and what calls, type, file name, name and incoming links add."""
    file = F.lower(base_name(path))
    by_file = F.coalesce(*[F.when(file.rlike(words), F.lit(w)) for w, words in FILE_WORDS], F.lit(0.0))
    by_name = (
        F.when(F.lower(name).rlike(STARTING_WORDS), 0.2).when(name.startswith("_") & ~name.startswith("__"), -0.1).when(name.startswith("test_"), -0.2).otherwise(0.0)
    )
    return F.lit(0.1) + 0.2 * calls + _cases(IMPORTANCE_OF_TYPE, type_, 0.1) + by_file + by_name + F.least(0.1 * incoming, F.lit(0.5))


def priority(path: Column, n_bytes: Column) -> Column:
    """How early a file is analysed: words in its name, few levels, and up to 20 for its kilobytes."""
    file = F.lower(base_name(path))
    words = [F.when(file.rlike(w), F.lit(p)).otherwise(F.lit(0)) for p, w in PRIORITY_WORDS]
    levels = F.when(depth(path) <= 2, 30).when(depth(path) > 5, -20).otherwise(0)
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total + levels + F.least(F.lit(20), F.floor(n_bytes / 1000).cast("int"))
