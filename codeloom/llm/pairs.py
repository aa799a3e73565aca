"""Functions and methods paired with their documentation.

A state machine of strings and comments blanks both out of the source (lengths and lines stay), so definitions are
recognised in code only and braces match to delimit their bodies; Python bodies end where the indentation does. The
documentation of a definition is the string that opens its body (Python), the /** */ comment directly above it with
only annotations between (JavaScript, TypeScript, Java), or the // lines directly above it (Go).

Documentation says something if, without comment marks and the parts on parameters, results and errors, it has three
words or more, goes beyond the words of the entity's own name, articles, "function" and "method", and is no placeholder.

Each file is read once, whatever the number of its entities; entities meet the definitions in a join on file and line.
Null contents have no definitions, a null start line is matched by name (the first definition of that name), an entity
without file in the table has no pair, repeated rows count once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import lexing
from codeloom.operators.skew import lookup
from codeloom.session import spread

LANGUAGES = lexing.ENDINGS | {".jsx": "javascript", ".tsx": "typescript", ".mjs": "javascript"}

_LITERALS = {
    "python": re.compile(lexing._PY_STRING + r"|#[^\n]*", re.S),
    "javascript": re.compile(lexing._JS_STRING + r"|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|(?<=[(,=:\[!&|?{};\n]) ?/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S),
    "java": re.compile(r"\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", re.S),
    "go": re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"),
}
_LITERALS["typescript"] = _LITERALS["javascript"]

_ARGS = r"\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*\)"
_JS_NOT = r"(?!(?:if|for|while|switch|catch|function|return|with|else|do|new|typeof|await|super)\b)"
_JS_DEF = re.compile(
    rf"\bfunction\s*\*?\s*([\w$]+)\s*(?:<[^>\n]*>)?\s*\("
    rf"|\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>\n]*>)?{_ARGS}\s*(?::[^=\n{{]+)?=>|[\w$]+\s*=>)"
    rf"|^[ \t]*(?:(?:export|default|public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*{_JS_NOT}(#?[\w$]+)\s*(?:<[^>\n]*>)?{_ARGS}\s*(?::\s*[^{{}};=\n]+)?\{{"
    rf"|^[ \t]*([\w$]+)\s*[:=]\s*(?:async\s*)?(?:function\b|{_ARGS}\s*(?::[^=\n{{]+)?=>)",
    re.M,
)
_DEFINITIONS = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M),
    "javascript": _JS_DEF,
    "typescript": _JS_DEF,
    "java": re.compile(
        rf"^[ \t]*(?:@\w[\w.]*(?:\([^()\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>\n]+>\s*)?"
        rf"(?!(?:return|throw|new|else|if|for|while|switch|catch|do|try)\b)(?:[\w$.]+(?:<[^;{{}}()\n]*>)?(?:\[\])*\s+)?(?!(?:if|for|while|switch|catch|try|synchronized|super|this|return)\b)([\w$]+)\s*{_ARGS}\s*(?:throws\s+[\w$.,\s]+)?[{{;]",
        re.M,
    ),
    "go": re.compile(r"^func\s*(?:\([^)]*\)\s*)?(\w+)", re.M),
}


@dataclass(frozen=True)
class Definition:
    line: int  # of the name, from 1
    name: str | None
    doc: str | None
    first: int  # lines of the code, documentation comment excluded
    last: int


def blank(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with strings and comments blanked, and the spans of the comments and strings."""
    out, at, spans = [], 0, []
    for m in _LITERALS[language].finditer(text):
        a, b = m.span()
        inner = m[0]
        spans.append((a, b))
        out.append(text[at:a])
        out.append(" " * (b - a) if "\n" not in inner else "\n".join(" " * len(x) for x in inner.split("\n")))
        at = b
    out.append(text[at:])
    return "".join(out), spans


def definitions(text: str | None, language: str) -> list[Definition]:
    """The definitions of a file; also, without name, the code lines a documentation comment is attached to."""
    if not text:
        return []
    text = text.replace("\r\n", "\n")
    code, spans = blank(text, language)
    starts = [0]
    starts += [m.end() for m in re.finditer("\n", text)]
    lines = text.split("\n")

    def line_of(i: int) -> int:
        return bisect_right(starts, i)

    docs = {} if language == "python" else _docs_above(text, code, spans, lines, line_of, language)
    closers = _closers(code) if language != "python" else {}
    out, seen = [], set()
    for m in _DEFINITIONS[language].finditer(code):
        group = m.lastindex
        line = line_of(m.start(group))
        first = line_of(m.start() + len(m[0]) - len(m[0].lstrip()))
        if line in seen:
            continue
        seen.add(line)
        if language == "python":
            doc, last = _python_body(text, code, m.end(), lines, line, line_of)
            out.append(Definition(line, m[group], doc, first, last))
        else:
            if language == "java" and m[0][-1] == ";" and not re.match(r"\s*(?:public|private|protected|static|abstract|@|<|[\w$.<>\[\]]+\s+[\w$]+\s*\()", m[0]):
                continue
            last = line
            brace = code.find("{", m.end() - 1)
            if brace >= 0 and not (language == "java" and m[0][-1] == ";"):
                last = line_of(closers.get(brace, brace))
            out.append(Definition(line, m[group], docs.get(first) or docs.get(line), first, max(last, line)))
    out += [Definition(n, None, d, n, n) for n, d in docs.items() if n not in seen]
    return out


def _closers(code: str) -> dict[int, int]:
    stack, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


_ANNOTATION = re.compile(r"^\s*@[\w.$]+\s*(?:\(.*\))?\s*$")


def _docs_above(text: str, code: str, spans, lines, line_of, language: str) -> dict[int, str]:
    """The documentation comment directly above each code line that has one."""
    blanked = code.split("\n")
    docs: dict[int, str] = {}
    if language == "go":
        block: list[str] = []
        for n, line in enumerate(lines, 1):
            stripped = line.lstrip()
            if stripped.startswith("//") and not blanked[n - 1].strip():
                block.append(stripped)
                continue
            if block and stripped:
                docs[n] = "\n".join(block)
            block = []
        return docs
    for a, b in spans:
        if not text.startswith("/**", a) or b - a < 5:
            continue
        end = line_of(b - 1)
        if blanked[end - 1][b - 1 - text.rfind("\n", 0, b - 1) :].strip():
            docs[end] = text[a:b]
            continue
        n = end + 1
        depth = 0
        while n <= len(lines) and (depth or _ANNOTATION.match(blanked[n - 1]) or blanked[n - 1].lstrip().startswith("@") and "(" in blanked[n - 1] and ")" not in blanked[n - 1]):
            depth += blanked[n - 1].count("(") - blanked[n - 1].count(")")
            n += 1
        if n <= len(lines) and blanked[n - 1].strip():
            docs[n] = text[a:b]
    return docs


_HEADER = re.compile(r"[()\[\]{}:]")
_REMARK = re.compile(r"\s*#[^\n]*")
#: After a string that is only the beginning of an expression.
_GOES_ON = re.compile(r"[ \t]*(?:[.%+\[*,]|if |in )")
_OPENING = re.compile(r"\s*(?:[rRuU]?)(\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S)


def _python_body(text: str, code: str, at: int, lines: list[str], line: int, line_of) -> tuple[str | None, int]:
    depth = 0
    colon = -1
    for m in _HEADER.finditer(code, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif not depth:
            colon = m.start()
            break
    if colon < 0:
        return None, line
    # Comments between the colon and the body are blank here; the body's first token must be a string.
    body = colon + 1
    while m := _REMARK.match(text, body):
        body = m.end()
    opening = _OPENING.match(text, body)
    doc = None
    if opening and not _GOES_ON.match(text, opening.end()):
        doc = opening[1]
    head = line_of(colon)
    indent = len(lines[line - 1]) - len(lines[line - 1].lstrip())
    last = head
    start = code.find("\n", colon)
    n = head
    while start >= 0:
        end = code.find("\n", start + 1)
        row = code[start + 1 : end if end >= 0 else len(code)]
        n += 1
        if row.strip():
            if len(row) - len(row.lstrip()) <= indent:
                break
            last = n
        elif n <= len(lines) and lines[n - 1].strip() and (len(lines[n - 1]) - len(lines[n - 1].lstrip()) > indent):
            last = n
        start = end
    return doc, last


# ------------------------------------------------------------------------------------------ what documentation says

_MARKS = re.compile(r"^[ \t]*(?:/\*\*?|\*/|\*(?!\*)|//+|#+)[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_QUOTES = re.compile(r"^\s*[rRuU]?(\"\"\"|'''|\"|')(.*)\1\s*$", re.S)
#: A section or tag on parameters, results and errors.
_TAG = re.compile(
    r"^[ \t]*(?:[@\\](?:param|arg|argument|return|returns|throws|exception|raises|type|typeparam|template|yields?|prop|property|see|since|author|version|deprecated|override|inheritdoc)\b"
    r"|:(?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raise|raises|except|exception|yields?|ytype|var|ivar|cvar)\b[^:\n]*:).*$",
    re.I,
)
_SECTION = re.compile(
    r"^[ \t]*(?:args|arguments|params|parameters|other parameters|keyword args|keyword arguments|returns?|return values?|yields?|raises?|throws|exceptions?|errors?|attributes)[ \t]*:?[ \t]*$", re.I
)
_INLINE = re.compile(r"^[ \t]*(?:args|arguments|params|parameters|returns?|yields?|raises|throws)[ \t]*:[ \t]*\S", re.I)
_INLINE_TAG = re.compile(r"\{@\w+[^}]*\}|<[^<>\n]{1,60}>")
#: Documentation still to be written.
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip|hack|tk)\b.*|(?:n/?a|none|null|undocumented|deprecated|docstring|documentation|docs?|missing|pending|no)(?:\W*(?:docs?|docstring|documentation|description|comment)s?)?\W*"
    r"|(?:please )?(?:add|write|insert|put|fill(?: me)?(?: in)?|describe|document|needs?|missing|lacks?|no|enter|provide)\b[\w\s,'’]{0,20}\b(?:docs?|docstring|documentation|description|comments?|here|in|me|this|it|later|text)\b\W*(?:here|later|please|yet|available|in|for this(?: \w+)?|this(?: \w+)?)?\W*"
    r"|(?:description|documentation|docs?|docstring|comment|summary|text)s?(?: \w+)? (?:goes? here|here|to (?:be )?(?:done|written|follow|come|added)|missing|pending|needed|follows|coming soon|is missing)\W*"
    r"|to be (?:documented|written|done|described|added|defined|determined)\b[\w\s]{0,20}\W*|(?:will|to) (?:be )?document(?:ed)?\b[\w\s]{0,20}\W*|lorem ipsum.*|auto-?generated (?:method )?stub\W*|not (?:yet )?documented(?: yet)?\W*|coming soon\W*)$",
    re.I | re.S,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]|[가-힯]")
# Words that say nothing about a function.
EMPTY_WORDS = frozenset("a an the function method".split())
_HUMP = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+|\d+")


def name_words(name: str | None) -> set[str]:
    return {w.lower() for w in _HUMP.findall(name or "")}


def prose(doc: str) -> str:
    """The documentation without marks and without its parts on parameters, results and errors."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    if m := _QUOTES.match(doc):
        doc = m[2]
    doc = _MARKS.sub("", doc)
    kept: list[str] = []
    section: int | None = None
    tag = False
    lines = doc.split("\n")
    for i, line in enumerate(lines):
        if _TAG.match(line):
            tag, section = True, None
            continue
        indent = len(line) - len(line.lstrip())
        underlined = i + 1 < len(lines) and re.fullmatch(r"[ \t]*-{3,}[ \t]*", lines[i + 1])
        if _SECTION.match(line) and (line.rstrip().endswith(":") or underlined):
            section, tag = indent, False
            continue
        if _INLINE.match(line):
            tag, section = True, None
            continue
        if section is not None:
            # A section lasts while its lines are indented deeper, or, underlined, until the next heading.
            if not line.strip() or indent > section or re.fullmatch(r"[ \t]*-{3,}[ \t]*", line):
                continue
            if i and not lines[i - 1].strip():
                section = None
            elif indent <= section and not re.match(r"[ \t]*[\w*]+[ \t]*:", line):
                section = None
            else:
                continue
        if tag:
            # A tag goes on over indented lines.
            if line.strip() and indent > 1:
                continue
            tag = False
        kept.append(line)
    return "\n".join(kept).strip()


def words(doc: str | None) -> tuple[int, list[str]]:
    """How many words the documentation has, and which of them count beyond articles; (0, []) for a placeholder."""
    if not doc or not doc.strip():
        return 0, []
    text = _INLINE_TAG.sub(" ", prose(doc))
    lines = [x for x in text.split("\n") if not re.match(r"\s*(?:todo|fixme|xxx|tbd)\b", x, re.I)]
    text = "\n".join(lines).strip()
    if _PLACEHOLDER.match(text):
        return 0, []
    found = [w.lower() for w in _WORD.findall(_CJK.sub(" ", text))] + _CJK.findall(text)
    return len(found), sorted(set(found) - EMPTY_WORDS)


def says_something(doc: str | None, name: str | None) -> bool:
    n, rest = words(doc)
    return n >= 3 and bool(set(rest) - name_words(name))


# ------------------------------------------------------------------------------------------------------ on tables


def plain_path(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.replace(column, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def _name_words(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|[\p{Lo}\p{Lm}]+|[0-9]+"), F.lit(0)), F.lower)


def definition_table(files: DataFrame, code: bool = False) -> DataFrame:
    """(repo_id, path, line, name, doc, n, words[, code]): a row for each definition, delimited in any case; code: with its
    lines and its documentation as it stands."""
    rows = spread(files.select("repo_id", plain_path("file_path").alias("path"), "content"))
    names = ["repo_id", "path", "line", "name", "doc", "n", "words", "code"][: 8 if code else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took: list[int] = []
            out: list[tuple] = []
            for i, (path, text) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())):
                language = LANGUAGES.get("." + (path or "").rpartition(".")[2].lower())
                if language in (None, "json"):
                    continue
                lines = text.replace("\r\n", "\n").split("\n") if code and text else []
                for d in definitions(text, language):
                    n, rest = words(d.doc)
                    took.append(i)
                    out.append((d.line, d.name, d.doc if code else None, n, rest, "\n".join(lines[d.first - 1 : d.last]) if code else None))
            keys = batch.select(["repo_id", "path"]).take(pa.array(took, pa.int64()))
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
            columns = [pa.array([row[k] for row in out], kinds[k]) for k in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*keys.columns, *columns], names=names)

    schema = "repo_id string, path string, line int, name string, doc string, n int, words array<string>" + (", code string" if code else "")
    return rows.mapInArrow(run, schema)


def docstring_words(nodes: DataFrame) -> DataFrame:
    """nodes with n_ and words_ of their docstring; null ones stay null."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("n_", T.IntegerType()), T.StructField("words_", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [words(d) if d is not None else (None, None) for d in batch.column("docstring").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in got], pa.int32()), pa.array([w for _, w in got], pa.list_(pa.string()))],
                names=[*batch.schema.names, "n_", "words_"],
            )

    return nodes.mapInArrow(run, schema)


def paired(nodes: DataFrame, files: DataFrame, code: bool = False) -> DataFrame:
    """(uuid, repo_id, path, name, type, line, doc, code) of the entities whose documentation says something."""
    wanted = nodes.where(F.lower(F.trim("type")).isin("function", "method")).select(
        "uuid", "repo_id", plain_path("file_path").alias("path"), "name", F.lower(F.trim("type")).alias("type"), F.col("start_line").alias("line"), "docstring"
    )
    wanted = wanted.dropDuplicates(["uuid"])
    key = lambda *parts: F.concat_ws("\x00", *parts)
    # Without its file in the table an entity has no pair; the names of the files alone are read for that.
    present = files.select(key("repo_id", plain_path("file_path")).alias("file"), F.lit(True).alias("present")).distinct()
    wanted = lookup(wanted.withColumn("file", key("repo_id", "path")), present, "file", ["present"]).where("present").drop("file", "present")
    blank_doc = F.coalesce(F.col("docstring").rlike(r"^[\s\x{A0}]*$"), F.lit(True))
    place = key("repo_id", "path", F.coalesce(F.col("line").cast("string"), key(F.lit("name"), "name")))
    wanted = docstring_words(wanted.withColumn("key", place).withColumn("docstring", F.when(~blank_doc, F.col("docstring"))))

    # One reading of the files serves both ways of looking up: the best documentation of a line, the first of a name.
    extra = ["doc", "code"] if code else []
    table = definition_table(files, code)
    by_line = F.struct(key("repo_id", "path", F.col("line").cast("string")).alias("key"), (-F.col("n")).alias("order"))
    by_name = F.when(F.col("name").isNotNull(), F.struct(key("repo_id", "path", F.lit("name"), "name").alias("key"), F.col("line").alias("order")))
    keyed = table.select("n", "words", *extra, F.explode(F.array_compact(F.array(by_line, by_name))).alias("k"))
    index = keyed.groupBy(F.col("k.key").alias("key")).agg(F.min_by(F.struct("n", "words", *extra), F.col("k.order")).alias("found"))

    # Every entity meets its function; one with a docstring of its own stands even where the function is damaged.
    met = lookup(wanted, index, "key", ["found"]).where("found is not null or n_ is not null")
    n = F.coalesce(F.col("n_"), F.col("found.n"))
    said = F.array_except(F.coalesce(F.col("words_"), F.col("found.words")), _name_words(F.coalesce(F.col("name"), F.lit(""))))
    met = met.where((n >= 3) & (F.size(said) > 0))
    columns = ["uuid", "repo_id", "path", "name", "type", "line"]
    if not code:
        return met.select(*columns)
    doc = F.when(F.col("n_").isNotNull(), F.col("docstring")).otherwise(F.col("found.doc"))
    return met.select(*columns, doc.alias("doc"), F.col("found.code").alias("code"))
