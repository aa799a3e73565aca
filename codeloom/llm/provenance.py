"""Generated, minified, vendored and data-only source files.

One pass over the contents gives each file its features, the notices and paths that say where it comes from and a
fingerprint. A random forest learns from head notices what files look like: a licence or copyright notice of the file's
own people stands for hand-written code, a notice of a tool for its output, the one-line banner that minifiers keep
(`/*! name version | licence */`) for minified code. Its features are taken with comments hidden: compression ratio, token
entropy, identifier lengths, comment density and the shape of lines. Files without a notice, which most minified files
are, get the forest's votes. A file is not hand-written if

* a notice in a comment, or its path or name, says a tool made it,
* it lies in a directory kept for other people's packages, or its fingerprint is that of a reference file,
* the forest's votes say it is minified, or
* it is nothing but one large data literal: data has no notices to learn from, so its code is parsed for that.

The fingerprint leaves out head comments, line ends and blanks at line ends. Null and empty contents have only their
path; empty reference files match nothing. Repeated rows count once. Where no head has a banner there is nothing to learn
from and only names like x.min.js tell minified files.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.pairs import _LITERALS, LANGUAGES
from codeloom.session import cut, spread

#: Rows of each label the forest is fitted on, at most about so many.
SAMPLE = 2000
TREES, DEPTH = 20, 6
#: Share of the forest's votes from which a file is minified.
VOTES = 0.5
#: One in so many labelled rows is held out by accuracy().
HELD_OUT = 4

# Endings in question; directories, names and notices of tools; directories of other people's packages.
ENDINGS = (".py", ".js", ".ts", ".java", ".go")
TOOL_PATH = re.compile(
    r"(?:^|/)(?:__generated__|_?generated|auto-?gen(?:erated)?|gen|generated[-_]sources?|gen[-_]src|dist)/"
    r"|(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.go|_grpc\.pb\.go|\.(?:generated|gen|g|autogen)\.\w+|[_-](?:generated|autogen)\.\w+|\.designer\.\w+)$|(?:^|/)zz_generated",
    re.I,
)
OTHERS_PATH = re.compile(r"(?:^|/)(?:node_modules|_?vendor|vendored|third[-_]?party|3rd[-_]?party|bower_components|jspm_packages|site-packages|dist-packages|\.?v?env|\.venv|virtualenv|external[-_]libs?|godeps|carthage|pods)/", re.I)
MINIFIED_NAME = re.compile(r"\.min\.\w+$", re.I)
NOTICE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated(?: file| code| by| from|;|,|\.| -)|\bauto(?:matically)?[- ]generated\b(?! (?:files|code) (?:is|are))"
    r"|\bcode generated by\b|\bgenerated by\b.*(?:do not|don'?t|not be) (?:modify|edit|change)|\b(?:this|the) (?:file|code|module|class) (?:was|is|has been) (?:auto\w*[- ])?(?:generated|produced|created|emitted|built|written) (?:by|from|with|using)\b"
    r"|\bgenerated (?:by|with|from|using)\b.*\b(?:v?\d+\.\d|compiler|codegen|protoc|generator|swagger|openapi|thrift|antlr|yacc|bison|flex)|\bchanges (?:made here )?will be (?:lost|overwritten)\b|\bedits? (?:are|will be) (?:lost|overwritten)\b"
    r"|\bregenerate instead of editing\b|\bwritten by .+\bregenerate\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bg[ée]n[ée]r[ée]e? automatiquement\b|\bfichier g[ée]n[ée]r[ée]\b|\bgenerado autom[áa]ticamente\b|\bc[óo]digo generado\b"
    r"|\bgerado automaticamente\b|自动生成|自動生成|автоматически сгенерирован|generato automaticamente|#\s*sourceMappingURL=",
    re.I,
)
#: Comments that only deal with such things.
NO_NOTICE = re.compile(r"once generated|kept by hand|template for|%s|\bgenerates\b|hand[- ]?(?:written|edited|maintained)|no longer generated|not (?:auto)?generated|\{\w*\}", re.I)
ANNOTATION = re.compile(r"^\s*@(?:[\w.]+\.)?(?:Generated|GeneratedValue|AutoGenerated|CompilerGenerated)\b\s*\(\s*[\"\w{]", re.M)
#: The line that minifiers keep, and the notice of people on their own file.
BANNER = re.compile(r"\s*/\*![^\n]*\*/")
OWN_NOTICE = re.compile(r"\bcopyright\b|\(c\)|©|\blicen[cs]ed?\b|\ball rights reserved\b|\bspdx-", re.I)

_TOKEN = re.compile(r"[^\W\d]\w*|\d+|[^\w\s]")
FEATURES = ("compression", "entropy", "identifier", "short", "comments", "mean_line", "max_line", "blank", "digits", "marks")


def head_end(text: str, language: str) -> int:
    """Where the comments at the head of the text end."""
    pattern = _LITERALS[language]
    at = 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if text.startswith(("//", "/*", "#"), at) and (m := pattern.match(text, at)) or text.startswith("#!", at) and (m := re.compile(r"[^\n]*").match(text, at)):
            at = m.end()
            continue
        if text.startswith("/*", at) and (close := text.find("*/", at)) >= 0:
            # In a language that has no such comments, as an upstream banner may be put before any code.
            at = close + 2
            continue
        return at


def fingerprint(text: str | None, language: str) -> str | None:
    """Of the text without head comments, line ends and blanks at line ends; None if nothing is left."""
    if not text:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
    body = "\n".join(line.rstrip() for line in text[head_end(text, language) :].split("\n")).strip()
    return hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest() if body else None


def comments(text: str, language: str) -> list[str]:
    return [m[0] for m in _LITERALS[language].finditer(text) if m[0][0] in "#/" and (m[0][0] == "#" or m[0][1:2] in ("/", "*"))]


def noticed(notes: list[str], text: str) -> bool:
    """Whether a comment or an annotation says that a tool made the file."""
    for note in notes:
        if NOTICE.search(note):
            for line in note.split("\n"):
                if NOTICE.search(line) and not NO_NOTICE.search(line):
                    return True
    return bool(ANNOTATION.search(text))


_DATA_NAME = re.compile(r"\s*(?:(?:package|import|from)\b[^\n]*\n\s*|\"\"\s*;?\s*)*+(?:[\w$.\[\]<>:,|\s]|\{(?=\s*(?:public|private|protected|static|final)\b))*+")
_DATA_TYPE = re.compile(r"\s*(?:new\s+)?(?:map\[\w+\])?(?:\[[\d.]*\])*\*?(?:[A-Za-z_][\w.]*)?(?:\[\])*(?=\s*[\[{(\"])")
_DATA_BODY = re.compile(r"(?:[\s\d.,:;\[\]{}()+\-\"]++|0x[\da-fA-F]++|(?:true|false|null|None|nil|True|False)\b|[eE][+\-]?\d++|[A-Za-z_$][\w$]*+\s*:)*+")
#: A literal with fewer items is no large one.
MANY_LITERALS = 40


_OPENING = re.compile(r"=(?![=>])|\b(?:export\s+default)\b|^(?=\s*[\[{])")


def one_literal(code: str) -> bool:
    """code: comments removed, strings emptied. Whether it's nothing but one large data literal."""
    opening = _OPENING.search(code)
    if not opening or not _DATA_NAME.fullmatch(code, 0, opening.start()):
        return False
    kind = _DATA_TYPE.match(code, opening.end())
    at = kind.end() if kind else opening.end()
    literals = code.count('"', at) // 2 + len(re.findall(r"\d+(?:\.\d+)?", code[at:]))
    return literals >= MANY_LITERALS and bool(_DATA_BODY.fullmatch(code, at))


#: What the forest learns: hand-written, made by a tool, minified.
HAND, TOOL, MINIFIED = 0, 1, 2


def label_of(head: str, text: str) -> int | None:
    """What a notice at the head says; None without one."""
    if BANNER.match(text):
        return MINIFIED
    if noticed([head], ""):
        return TOOL
    return HAND if OWN_NOTICE.search(head) else None


def look(path: str, text: str | None, language: str) -> tuple[str | None, int | None, bool, list[float], str | None]:
    """(mark, label, data, features, fingerprint) of a file. mark: tool, others or minified (by its name); data: whether it
    is nothing but one large literal."""
    mark = "others" if OTHERS_PATH.search(path) else "tool" if TOOL_PATH.search(path) else "minified" if MINIFIED_NAME.search(path) else None
    if not text or not text.strip():
        return mark, None, False, [0.0] * len(FEATURES), None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if mark in (None, "minified") and noticed(comments(text, language), text):
        mark = "tool"
    end = head_end(text, language)
    body = text[end:]
    hidden = _LITERALS[language].sub(lambda m: "" if m[0][0] in "#/" and (m[0][0] == "#" or m[0][1:2] in ("/", "*")) else m[0], body)
    code = _LITERALS[language].sub(lambda m: '""' if m[0][-1:] in "\"'`" else "" if m[0][0] in "#/" else m[0], body)
    return mark, label_of(text[:end], text), one_literal(code.strip() + "\n"), measure(body, hidden, language), fingerprint(text, language)


def measure(body: str, code: str, language: str) -> list[float]:
    raw = body.encode("utf-8", "surrogatepass")
    counts = Counter(map(itemgetter(0), _TOKEN.finditer(code)))
    n = counts.total() or 1
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    names = [(t, c) for t, c in counts.items() if t[0].isalpha() or t[0] == "_"]
    m = sum(c for _, c in names) or 1
    lines = body.split("\n")
    size = len(body) or 1
    return [
        len(zlib.compress(raw, 1)) / (len(raw) or 1),
        entropy,
        sum(len(t) * c for t, c in names) / m,
        sum(c for t, c in names if len(t) <= 2) / m,
        1 - len(code) / size,
        math.log1p(size / len(lines)),
        math.log1p(max(map(len, lines))),
        sum(map(body.count, " \t\n")) / size,
        sum(c * len(t) for t, c in counts.items() if t[0].isdigit()) / size,
        sum(c for t, c in counts.items() if not t[0].isalnum()) / n,
    ]


def examine(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, mark, label, data, features, print) of every file with an ending in question."""
    rows = files.select("repo_id", "file_path", "content").where(F.lower("file_path").rlike(r"\.(?:py|js|ts|java|go)$"))
    kinds = {"mark": pa.string(), "label": pa.int32(), "data": pa.bool_(), "features": pa.list_(pa.float64()), "print": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [
                look(p.replace("\\", "/"), t, LANGUAGES["." + p.rpartition(".")[2].lower()])
                for p, t in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist())
            ]
            new = [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("file_path"), *new], names=["repo_id", "file_path", *kinds])

    return spread(rows).mapInArrow(run, "repo_id string, file_path string, mark string, label int, data boolean, features array<double>, print string")


def reference_prints(reference: DataFrame) -> DataFrame:
    """(print) of the reference files (file_name, content), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for name, text in zip(batch.column("file_name").to_pylist(), batch.column("content").to_pylist()):
                language = LANGUAGES.get("." + (name or "").rpartition(".")[2].lower())
                if language in _LITERALS:
                    got.append(fingerprint(text, language))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["print"])

    return reference.select("file_name", "content").mapInArrow(run, "print string").where("print is not null").distinct()


def _sampled(examined: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of each label at most, chosen by hash where they are; these few brought into one partition and
    order, so that the forest is the same however the rows were divided."""
    counts = {r.label: r.n for r in examined.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, sample / n))) for k, n in counts.items()], F.lit(0.0))
    chosen = F.pmod(F.xxhash64("repo_id", "file_path"), F.lit(1 << 30)) < share * (1 << 30)
    return examined.where(chosen).select("repo_id", "file_path", "features", F.col("label").cast("double").alias("label")).repartition(1).sortWithinPartitions("repo_id", "file_path", "label")


def forest(sampled: DataFrame):
    """The fitted random forest over rows (features, label), or None where no row is labelled minified or none is not."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = cut(sampled.select(array_to_vector("features").alias("x"), "label"))
    seen = {r.label for r in rows.select("label").distinct().collect()}
    if MINIFIED not in seen or len(seen) < 2:
        return None
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=32).fit(rows)


def votes(model, examined: DataFrame) -> DataFrame:
    """examined with votes: the share of the forest's votes for minified; null without a model."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model is None:
        return examined.withColumn("votes", F.lit(None).cast("double"))
    scored = model.transform(examined.withColumn("x", array_to_vector("features")))
    return scored.withColumn("votes", vector_to_array("probability")[MINIFIED]).drop("x", "rawPrediction", "probability", "prediction")


def classify(files: DataFrame, reference: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(repo_id, file_path, kind, votes): kind is tool, others, copy, data, minified or, hand-written, null."""
    examined = cut(examine(files))
    scored = votes(forest(_sampled(examined, sample)), examined)
    copies = reference_prints(reference).withColumn("copy", F.lit(True))
    met = scored.join(copies, "print", "left")
    kind = (
        F.when(F.col("mark").isin("tool", "others"), F.col("mark"))
        .when(F.col("copy"), F.lit("copy"))
        .when(F.col("data"), F.lit("data"))
        .when((F.col("mark") == "minified") | (F.col("votes") >= VOTES), F.lit("minified"))
    )
    return met.select("repo_id", "file_path", kind.alias("kind"), "votes")


def accuracy(files: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Precision and recall of the votes on labelled rows that were kept out of the fit."""
    examined = cut(examine(files))
    out = F.pmod(F.xxhash64(F.lit("held out"), "repo_id", "file_path"), F.lit(HELD_OUT)) == 0
    scored = votes(forest(_sampled(examined.where(~out), sample)), examined.where(out & F.col("label").isNotNull()))
    hit, true = F.col("votes") >= VOTES, F.col("label") == MINIFIED
    row = scored.agg(F.count_if(hit & true).alias("both"), F.count_if(hit).alias("found"), F.count_if(true).alias("true")).first()
    return {"rows": row.true, "precision": row.both / max(row.found, 1), "recall": row.both / max(row.true, 1)}
