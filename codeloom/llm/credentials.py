"""Credentials embedded in source code, configuration and JSON metadata, and their redaction.

The whole text is tokenized into comments, names, operators and literals, over line ends; a literal counts when it isn't a
placeholder and

* is assigned or passed to a name that stands for a credential (in code, in a comment, as a configuration value), also
  put together from pieces or on a later line than its name, or
* is itself of a format that only credentials have: provider tokens, signed web tokens, private keys, a login within
  a URL, an authorization header, a command-line option, or an encoding of one of these.

Redaction replaces the characters of the literal's content with asterisks and leaves delimiters, escapes and everything
around them as they are, so lengths, lines and syntax stay. Null and empty texts have no credentials.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

# Words that make a name stand for a credential.
_ALONE = r"passwords?|passwd|passphrase|passwort|kennwort|contrasena|contraseña|motdepasse|mdp|senha|pwd|pass|pw|secrets?|tokens?|credentials?|creds|bearer"
_PAIRS = r"(?:api|access|secret|private|signing|encryption|master|auth|client|account|service|shared|session|license|storage) ?(?:key|token|secret|pass|password)|mot de passe|apikey|accesskey|secretkey|authtoken"
NAME = re.compile(rf"(?:^| )(?:{_ALONE}|{_PAIRS})(?: |$)")
#: Names that look like credentials and hold something else.
OTHER_NAME = re.compile(r"^(?:label|primary key|pub(?:lic)?|sha ?\d*|md5|checksum|pinned|request id|foreign key|sort key|partition key|cache key|etag|csrf header|docs)(?: |$)| (?:hash|checksum|sha256|fingerprint|public)$")
#: Calls whose argument "key" is a credential.
SIGNING = re.compile(r"(?:^| )(?:sign|signs|signed|signing|signer|encrypt|encrypts|encrypted|encryption|decrypt|decrypts|decrypted|hmac|jwt|cipher)$")
_CAMEL = re.compile(r"(?<=[a-z\d])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-zÀ-ÿ]+")

PLACEHOLDER = re.compile(
    r"^$|^[*x•#.\-_X]+$|\{\w[^{}]*\}|\$\{|\$\(|\{\{|^\{\w*\}$|^<[^>]*>$|%\(|^%\w$|^\$\w+$|^\[.*\]$|\*{3,}"
    r"|^(?:vault|env|ssm|arn|file|secret|ref|kms|op|keyring)s?:|^/|^\.{1,2}/|^https?://[^@]*$"
    r"|(?:^|[^a-z])(?:your|my)[-_ ]|[-_ ](?:here|goes here)$|change[-_ ]?me|replace[-_ ]|place[-_ ]?holder|example|dummy|redacted|masked|not[-_ ]?set|set[-_ ]me|todo|sample|fake|insert[-_ ]",
    re.I,
)
UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
_WORDS = re.compile(r"^[A-Za-z]+(?:[-_./: ][A-Za-z]+)*\d{0,2}$")

# Formats of credentials.
FORMATS = re.compile(
    r"(?<![\w.])(?:gh[opsur]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w\-]{14,}|xox[abeoprs]-[\w\-]{10,}|[sr]k_(?:live|prod)_[A-Za-z0-9]{12,}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{12,20}|eyJ[\w\-]{6,}\.[\w\-]{6,}\.[\w\-]{6,}|AIza[\w\-]{30,}|npm_[A-Za-z0-9]{30,}|(?!www\.)[A-Za-z]{2,4}\.[\w\-]{20,24}\.[\w\-]{38,})(?![\w])"
)
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----END)[^\"'`])*(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?")
LOGIN_URL = re.compile(r"[a-z][a-z0-9+.\-]*://[^\s:/@\"'`?#<>]*:([^\s/\"'`<>]+)@[\w\[]", re.I)
HEADER = re.compile(r"\b(?:Bearer|Token)[^\S\n]+([\w\-.~+/]{8,}=*)|\bBasic[^\S\n]+([A-Za-z0-9+/]{8,}={0,2})(?![\w])")
OPTION = re.compile(r"--?(?:password|passwd|pwd|pass|token|secret|api-?key|access-?key|auth-?token)(?:=|[^\S\n]+)[\"']?([^\s\"'`]+)|(?<![\w-])(?:-u|--user)[ =]?[\"']?[\w.@\-]+:([^\s\"'`]+)", re.I)
PROSE = re.compile(rf"\b(?:{_ALONE}|api[ _-]?key|access[ _-]?key|signing[ _-]?key)\b[\"'*/]*[\s,;:=/]*(?:(?:is|was|now|to|of|for)\b[\s,:]*)?(?:(?:is|now|still)\b\s*)?[\"'`]?([^\s\"'`,;<>()]{{8,}})", re.I)
ENCODED = re.compile(r"(?<![\w+/])((?:[A-Za-z0-9+/]{4}){4,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)(?![\w+/=])")
INSIDE = re.compile(r"(?:^|[^a-z])(?:password|passwd|pwd|pass|secret|token|api_?(?:key|token)|access_?key|credential)s?\w*[\"']?\s*[=:]\s*[\"']?([^\s\"']{6,})", re.I)

_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`"
_LONG = r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|`(?:[^`\\]|\\.)*`|"
_TAIL = r"(?P<n>[^\W\d][\w$\-.]*(?:(?<=[\w$])))|(?P<o>:=|==|!=|=>|[=:(,+|?\[{)}\]])|(?P<x>[^\s])"
_PREFIX = r"(?:[rRbBuUfF]{1,2}(?=[\"']))?"
# The forms of comments by family of languages.
_COMMENTS = {"hash": r"#[^\n]*", "slash": r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", "none": r"/\*(?:[^*\n]|\*(?!/))*\*/"}
#: Names, literals and the operators between them; a comment in the middle of a call may name the argument.
LEX = {k: re.compile(rf"(?P<c>{c})|(?P<s>{_PREFIX}(?:{_LONG}{_STRING}))|{_TAIL}", re.S) for k, c in _COMMENTS.items()}
#: Of a single line, in which comments are marked by how it begins.
LINE = re.compile(rf"(?P<s>{_PREFIX}(?:{_STRING}))|(?P<c>/\*.*?\*/)|{_TAIL}")
# The family of each ending; others have no comments but short ones within a line.
FAMILY = dict.fromkeys(("py", "pyw", "rb", "sh", "yaml", "yml", "toml", "env", "properties", "ini", "cfg", "conf"), "hash") | dict.fromkeys(
    ("js", "jsx", "mjs", "ts", "tsx", "java", "go", "c", "h", "cpp", "cc", "hpp", "cs", "rs", "php", "swift", "kt", "kts", "scala"), "slash"
)
CONFIG = re.compile(r"^\s*(?:export\s+|set\s+|-\s+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*[=:]\s*(.*?)\s*,?\s*$")
CONFIGURATION = (".env", ".properties", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".conf")


def _words(name: str) -> str:
    return " ".join(w for w in _CAMEL.split(name) if w).lower()


@lru_cache(maxsize=1 << 16)
def names_credential(name: str) -> bool:
    words = _words(name)
    return bool(NAME.search(words)) and not OTHER_NAME.search(words)


@lru_cache(maxsize=1 << 16)
def signs(callee: str, argument: str) -> bool:
    """Whether the argument of the call is the key of something signed or encrypted."""
    return argument.lower() == "key" and bool(SIGNING.search(_words(callee)))


def looks_secret(value: str) -> bool:
    """Whether the value of a credential-named name is one: not a placeholder, a reference, words or an id."""
    if len(value) < 6 or any(c.isspace() for c in value):
        return False
    if PLACEHOLDER.search(value) or UUID.match(value) or _WORDS.match(value) and not _mixed(value):
        return False
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if not letters:
        return digits >= 6 and not value.isdigit()
    return digits >= 1 and len(value) >= 8 or _mixed(value)


def _mixed(value: str) -> bool:
    """No digits, but with the case mixed as no name is written, or with signs between."""
    changes = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
    if changes >= 2 and len(value) >= 8 and any(c in "+!#%^&*=~@$" for c in value):
        return True
    return len(value) >= 12 and (changes * 2 >= len(value) or changes >= 4 and bool(re.search("[A-Z]{2}", value)))


def decoded(value: str) -> str | None:
    """The text a base64 value stands for, if it is text."""
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
        text = raw.decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return text if all(c.isprintable() or c in "\r\n\t" for c in text) else None


def _by_format(text: str) -> Iterator[tuple[int, int]]:
    for m in FORMATS.finditer(text):
        yield m.span()
    if "://" in text:
        for m in LOGIN_URL.finditer(text):
            if not PLACEHOLDER.search(m[1]) and m[1].lower() not in ("password", "pass", "pwd", "secret"):
                yield m.span(1)
    for m in HEADER.finditer(text):
        if m[1] and looks_secret(m[1]) and len(m[1]) >= 12:
            yield m.span(1)
        elif m[2] and (inner := decoded(m[2])) and ":" in inner and not PLACEHOLDER.search(inner.partition(":")[2]):
            yield m.span(2)
    if "-" in text:
        for m in OPTION.finditer(text):
            i = 1 if m[1] else 2
            if looks_secret(m[i]):
                yield m.span(i)


def _encoded(text: str) -> Iterator[tuple[int, int]]:
    """Base64 of any length, under any name, that stands for a credential."""
    for m in ENCODED.finditer(text):
        inner = decoded(m[1])
        if inner and ((found := INSIDE.search(inner)) and not PLACEHOLDER.search(found[1]) or FORMATS.search(inner)):
            yield m.span(1)


def _content(token: str) -> tuple[int, int]:
    """Where the content of a literal begins and ends within its token."""
    start = next(i for i, c in enumerate(token) if c in "\"'`") + 1
    return start, len(token) - 1


#: Tokens taken at a time.
STRETCH = 50_000
#: After these a statement goes on in the next line.
_GOES_ON = ("=", "(", "+", ":", ":=", "=>")
_COMMENT = ("#", "//", "*", "/*", "--", ";")


def _by_name(text: str, lex: re.Pattern) -> Iterator[tuple[int, int]]:
    """Literals assigned or passed to a credential-named name; pieces joined by + or side by side count as one literal.

    What comments and literals over several lines hold is searched line by line. Tokens are taken in stretches, so a long
    text isn't held as tokens as a whole.
    """
    found = lex.finditer(text)
    tokens: list[tuple[str, str, int]] = []

    def has(k: int) -> bool:
        """Whether there is a token k, taken if need be."""
        while k >= len(tokens):
            more = [(m.lastgroup, m[0], m.start()) for m in islice(found, STRETCH)]
            if not more:
                return False
            tokens.extend(more)
        return True

    name, bound = "", False  # the last name, and whether an operator binds what follows to it
    calls: list[str] = []  # what each open parenthesis calls
    last, end = "", 0
    i = 0
    while i < len(tokens) or has(i):
        if i > STRETCH:
            del tokens[:i]
            i = 0
        kind, token, at = tokens[i]
        if bound and last not in _GOES_ON and text.find("\n", end, at) >= 0:
            bound = False
        if kind == "n":
            # "token: string = ..." keeps the variable's name over its type.
            if not (bound and last == ":" and has(i + 1) and tokens[i + 1][1] == "="):
                name, bound = token, False
        elif kind == "c":
            if lex is not LINE:
                for low, line in _lines(token):
                    yield from ((at + low + a, at + low + b) for a, b in _in_comment(line))
            if token.startswith("/*") and "\n" not in token:
                name, bound = token.strip("/* ").split("=")[0], True
            elif bound:
                # A comment between a name and its literal changes nothing.
                i, end = i + 1, at + len(token)
                continue
        elif kind == "o":
            if token == "(":
                calls.append(name if last == name else "")
                bound = True
            elif token in ("=", ":", ":=", "=>"):
                bound = True
            elif token not in ("+", "[", "]", "|", "?"):
                if token == ")" and calls:
                    calls.pop()
                bound = bound and token == "{"
        elif kind == "s":
            pieces = [(token, at)]
            j = i
            while has(j + 1):
                step = 2 if tokens[j + 1][1] in ("+", ".") and has(j + 2) and tokens[j + 2][0] == "s" else 1
                if tokens[j + step][0] != "s":
                    break
                j += step
                pieces.append(tokens[j][1:])
            value = "".join(p[slice(*_content(p))] for p, _ in pieces)
            token, at = pieces[-1]
            if j == i and has(j + 1) and tokens[j + 1][1] in (":", "=>", "="):
                name, bound, last = value, True, ":"
                end = tokens[j + 1][2] + len(tokens[j + 1][1])
                i = j + 2
                continue
            called = bound or len(pieces) > 1
            named = called and (names_credential(name) or bool(calls) and signs(calls[-1], name))
            if named and looks_secret(value) or len(pieces) > 1 and FORMATS.search(value):
                for p, start in pieces:
                    low, high = _content(p)
                    yield start + low, start + high
            else:
                for p, start in pieces:
                    if "\n" in p:
                        for low, line in _lines(p):
                            yield from ((start + low + a, start + low + b) for a, b in _in_line(line))
            i = j
        last, end = token, at + len(token)
        i += 1


def _lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def _in_comment(line: str) -> list[tuple[int, int]]:
    """Credentials that a line of a comment assigns or tells."""
    found = list(_by_name(line, LINE))
    return found or [m.span(1) for m in PROSE.finditer(line) if looks_secret(m[1]) and not m[1].startswith("--")]


def _in_line(line: str, configuration: bool = False) -> list[tuple[int, int]]:
    """Credentials of a line by itself, of a configuration file or within a literal."""
    if line.lstrip().startswith(_COMMENT):
        return _in_comment(line)
    found = list(_by_name(line, LINE))
    if configuration and (m := CONFIG.match(line)):
        value, at = m[2], m.start(2)
        if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
            value, at = value[1:-1], at + 1
        if names_credential(m[1]) and looks_secret(value):
            found.append((at, at + len(value)))
    return found


def find(text: str | None, configuration: bool = False, family: str | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of credentials in the text, in order, without overlaps.

    configuration: a text of names and values line by line. family: the form of its comments, one of those of FAMILY;
    where it isn't known, lines that begin like a comment of any language are one.
    """
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        spans += [m.span() for m in PRIVATE_KEY.finditer(text) if "**" not in m[0]]
    spans += _encoded(text)
    spans += _by_format(text)
    if configuration:
        for start, line in _lines(text):
            spans += [(start + a, start + b) for a, b in _in_line(line, True)]
        return merge(spans)
    spans += _by_name(text, LEX[family or "none"])
    if family is None:
        for start, line in _lines(text):
            if line.lstrip().startswith(_COMMENT):
                spans += [(start + a, start + b) for a, b in _in_comment(line)]
    return merge(spans)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


_KEEP = re.compile(r"\\(?:u[\da-fA-F]{4}|x[\da-fA-F]{2}|.)|\r?\n|-----(?:BEGIN|END) [A-Z0-9 ]*-----|(.)", re.S)


def mask(secret: str) -> str:
    """Asterisks for every character but escapes, line ends and the frame of a key."""
    return _KEEP.sub(lambda m: "*" if m[1] else m[0], secret)


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mask(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


_JSON_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"")
_COLON = re.compile(r"\s*:")


def find_in_json(raw: str | None, name: str | None = None) -> list[tuple[int, int]]:
    """Spans within the raw text of a JSON value. name: what a key "value" belongs to.

    Works on the string tokens, so text that isn't JSON is searched as far as it has such tokens.
    """
    if not raw or '"' not in raw:
        return []
    spans: list[tuple[int, int]] = []
    key = ""
    for m in _JSON_STRING.finditer(raw):
        if _COLON.match(raw, m.end()):
            key = m[0][1:-1]
            continue
        token = m[0][1:-1]
        if len(token) < 6:
            continue
        try:
            value = json.loads(m[0], strict=False)
        except ValueError:
            value = token
        owner = name if key == "value" and name else key
        if names_credential(owner) and looks_secret(value):
            spans.append((m.start() + 1, m.end() - 1))
            continue
        found = find(value)
        if not found:
            found = merge([s.span(1) for s in PROSE.finditer(value) if looks_secret(s[1]) and not _REFERENCE.search(s[1])])
        if found:
            place = _raw_places(token, len(value))
            spans += [(m.start() + 1 + place[a], m.start() + 1 + place[b]) for a, b in found]
    return merge(spans)


_REFERENCE = re.compile(r"environ|getenv|process\.env|\[|\(")


def _raw_places(token: str, n: int) -> list[int]:
    """Where each character of the value begins in the raw token."""
    places = [m.start() for m in re.finditer(r"\\ud[89ab][\da-f]{2}\\ud[c-f][\da-f]{2}|\\u[\da-fA-F]{4}|\\.|.", token, re.S | re.I)]
    return [*places, len(token)] if len(places) == n else [*range(n), len(token)]


def scan_files(files: DataFrame, redacted: bool = False) -> DataFrame:
    """(repo_id, file_path, line_no) of every line on which a credential begins; with redacted, one row per file that
    has any: (repo_id, file_path, lines, content) with the credentials masked."""
    rows = spread(files.select("repo_id", "file_path", "content"))
    kind = "lines array<int>, content string" if redacted else "line_no int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, lines, texts = [], [], []
            for i, (path, text) in enumerate(zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist())):
                low = (path or "").lower()
                spans = find(text, low.endswith(CONFIGURATION), FAMILY.get(low.rpartition(".")[2], "none"))
                numbers = sorted({text.count("\n", 0, a) + 1 for a, _ in spans})
                if redacted and numbers:
                    took.append(i)
                    lines.append(numbers)
                    texts.append(redact(text, spans))
                elif numbers:
                    took += [i] * len(numbers)
                    lines += numbers
            keys = batch.select(["repo_id", "file_path"]).take(pa.array(took, pa.int64()))
            if redacted:
                new = [pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            else:
                new = [pa.array(lines, pa.int32())]
            yield pa.RecordBatch.from_arrays([*keys.columns, *new], names=["repo_id", "file_path", *(["lines", "content"] if redacted else ["line_no"])])

    return rows.mapInArrow(run, f"repo_id string, file_path string, {kind}")


def scan_metadata(nodes: DataFrame, redacted: bool = False) -> DataFrame:
    """(uuid) of nodes whose metadata hold a credential; with redacted also the masked metadata."""
    rows = nodes.select("uuid", "name", "metadata").where(F.col("metadata").rlike(r'"\s*[,}\]]'))
    rows = spread(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, texts = [], []
            for i, (name, raw) in enumerate(zip(batch.column("name").to_pylist(), batch.column("metadata").to_pylist())):
                if spans := find_in_json(raw, name):
                    took.append(i)
                    texts.append(redact(raw, spans))
            keys = batch.column("uuid").take(pa.array(took, pa.int64()))
            columns = {"uuid": keys} | ({"metadata": pa.array(texts, pa.string())} if redacted else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, "uuid string, metadata string" if redacted else "uuid string")


def found(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_table, record_key, line_no), once per line of a file and once per node."""
    lines = scan_files(files).select(
        F.lit("source_files").alias("source_table"), F.concat_ws(":", "repo_id", "file_path").alias("record_key"), "line_no"
    )
    marked = scan_metadata(nodes).select(F.lit("nodes").alias("source_table"), F.col("uuid").alias("record_key"), F.lit(0).alias("line_no"))
    return lines.unionByName(marked).distinct()
