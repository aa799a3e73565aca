"""Language-specific lexers with a pushdown stack: is a text a syntactically valid file of its language?

A lexer turns a text into a string of one-character token classes (an unterminated literal or a character that no
token starts with has a class of its own). A pushdown stack matches the brackets; each group is checked against the
forms its kind of bracket may hold in the language and folded to one class, until the top level is left. The forms are
regular over classes, so they run in the regex engine, and groups that were met before are looked up.

problem(language, text) names the first thing wrong, or gives None. Lines may end in LF or CRLF.
"""

from __future__ import annotations

import re

# The languages and the endings that promise them.
ENDINGS = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".json": "json"}

UNTERMINATED, UNKNOWN = "\x01", "\x02"


class Classes(dict):
    """Class of each token text, found once for short texts; at most MOST are kept."""

    MOST = 200_000

    def __init__(self, words: dict[str, str], kind):
        super().__init__(words)
        self.words, self.kind = dict(words), kind

    def __missing__(self, token: str) -> str:
        c = self.kind(token)
        if len(token) < 24:
            # All that was learned goes at once, so that a full table costs nothing per token.
            if len(self) >= self.MOST:
                self.clear()
                self.update(self.words)
            self[token] = c
        return c


def _words(**classes: str) -> dict[str, str]:
    return {w: c for c, words in classes.items() for w in words.split()}


class Group:
    """Checks of bracket contents, remembered."""

    def __init__(self, forms: list[re.Pattern]):
        self.forms = forms
        self.known: dict[str, bool] = {}

    def ok(self, content: str) -> bool:
        found = self.known.get(content)
        if found is None:
            found = any(f.fullmatch(content) for f in self.forms)
            if len(content) < 200:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[content] = found
        return found


OPEN = {"(": ")", "[": "]", "{": "}"}
FOLDED = {"(": "P", "[": "B", "{": "K"}
BRACKET = re.compile(r"[()\[\]{}]")


def fold(classes: str, groups: dict[str, Group], prepare=None) -> tuple[str, str | None]:
    """The top level with each bracket group as one class, and what is wrong with the brackets or in them."""
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    at = 0
    for m in BRACKET.finditer(classes):
        i = m.start()
        if i > at:
            parts.append(classes[at:i])
        at = i + 1
        c = classes[i]
        if c in OPEN:
            stack.append((c, parts))
            parts = []
            continue
        if not stack:
            return "", f"unmatched {c}"
        opened, outer = stack.pop()
        if OPEN[opened] != c:
            return "", f"{opened} closed by {c}"
        content = "".join(parts)
        if prepare:
            content = prepare(content, opened)
        if not groups[opened].ok(content):
            return "", f"malformed {opened}{c}"
        parts = outer
        parts.append(FOLDED[opened])
    if stack:
        return "", f"{stack[-1][0]} never closed"
    parts.append(classes[at:])
    return "".join(parts), None


CONFLICT = re.compile(r"^(?:<<<<<<< |>>>>>>> |\|\|\|\|\|\|\| |=======$)", re.M)


# ---------------------------------------------------------------------------------------------------- Python

_PY_STRING = (
    r"(?:[rRbBuUfFtT]{1,2}(?=[\"']))?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''"
    r"|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')"
)
PY_TOKEN = re.compile(
    _PY_STRING + r"|#[^\n]*|\n[ \t\f]*|\\\n|[^\W\d]\w*"
    r"|0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?"
    r"|->|:=|\*\*=?|//=?|>>=?|<<=?|[<>=!+\-*/%&|^@]=|\.\.\.|[^\s]",
    re.S,
)

# Classes: n name, d number, s string, o binary operator, - sign, ~ prefix, * star, = assignment, u augmented assignment.
_PY_WORDS = _words(
    D="def", C="class", I="if", E="elif", L="else", F="for", W="while", T="try", X="except", Y="finally", Z="with",
    R="return", A="async", M="import", G="from", U="raise", J="pass break continue", Q="del assert", V="global nonlocal",
    N="not", b="and or", i="in", S="is", l="lambda", y="yield", w="await", a="as", k="match case type",
) | {"True": "c", "False": "c", "None": "c", "...": "c", "->": "r", ":=": "o", "!=": "o"} | {
    t: "u" for t in "+= -= *= /= //= %= &= |= ^= >>= <<= **= @=".split()
} | {t: "o" for t in "/ // % & | ^ << >> < > <= >= ==".split()} | {
    "+": "-", "-": "-", "~": "~", "*": "*", "**": "*", "@": "@", "=": "=", ",": ",", ":": ":", ".": ".", ";": ";",
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "\\\n": " ",
}


def _py_kind(token: str) -> str:
    c = token[0]
    if c == "#":
        return " "
    if c == "\n":
        return "\n"
    if token[-1] in "\"'":
        return "s" if len(token) > 1 else UNTERMINATED
    if c.isdigit() or c == "." and len(token) > 1:
        return "d"
    if c.isalpha() or c == "_" or token.isidentifier():
        return "n"
    return UNKNOWN


_PY_CLASS = Classes(_PY_WORDS, _py_kind)

_PY_OPERAND = r"(?:[-~Nw]|y(?:G)?|\*)*+(?:l[nk,=*]*+(?:=[ncds])?[^:\n;]*?:(?:[-~Nw])*+)*+(?:s++|[ndckPBK])(?:[PB]|\.[nk])*+"
_PY_BINARY = r"(?:[-o*@bS]N?|N?i|SN|[IL]|A?Fi?|:?o)"
_PY_EXPR = rf"{_PY_OPERAND}(?:{_PY_BINARY}{_PY_OPERAND})*+"
_PY_LIST = rf"{_PY_EXPR}(?:,{_PY_EXPR})*+,?"
_PY_YIELD = rf"(?:y(?:G{_PY_EXPR}|(?:{_PY_LIST})?)|{_PY_LIST})"
_PY_SIMPLE = (
    rf"(?:R(?:{_PY_LIST})?|U(?:{_PY_EXPR}(?:G{_PY_EXPR})?)?|J|Q{_PY_LIST}|V[nk](?:,[nk])*+"
    r"|M[nk](?:\.[nk])*+(?:a[nk])?(?:,[nk](?:\.[nk])*+(?:a[nk])?)*+"
    r"|G[.c]*(?:[nk](?:\.[nk])*+)?M(?:\*|P|[nk](?:a[nk])?(?:,[nk](?:a[nk])?)*+)"
    rf"|k[nk]B?={_PY_EXPR}|{_PY_OPERAND}:{_PY_EXPR}(?:={_PY_YIELD})?|{_PY_LIST}u{_PY_YIELD}|{_PY_YIELD}(?:={_PY_YIELD})*+)"
)
_PY_SIMPLES = rf"{_PY_SIMPLE}(?:;{_PY_SIMPLE})*+;?"
_PY_HEAD = (
    rf"(?:A?D[nk]B?P(?:r{_PY_EXPR})?|C[nk]B?P?|[IEW]{_PY_EXPR}|L|T|Y|X\*?(?:{_PY_LIST}(?:a[nk])?)?"
    rf"|A?Z(?:{_PY_EXPR}(?:a{_PY_OPERAND})?(?:,{_PY_EXPR}(?:a{_PY_OPERAND})?)*+|P),?|A?F{_PY_LIST}i{_PY_LIST}|A?F[^:]*i{_PY_LIST}|k{_PY_LIST}(?:a[nk])?(?:I{_PY_EXPR})?)"
)
PY_HEAD = re.compile(rf"{_PY_HEAD}:")
PY_BLOCK = re.compile(rf"{_PY_HEAD}:(?P<body>{_PY_SIMPLES})?")
PY_STATEMENT = re.compile(_PY_SIMPLES)
PY_DECORATOR = re.compile(rf"@{_PY_EXPR}")
_PY_ITEM = rf"(?:\*?(?:[nk](?::{_PY_EXPR})?(?:={_PY_EXPR})?|{_PY_EXPR})|[*o])"
_PY_SLICE = rf"(?:{_PY_EXPR})?(?::(?:{_PY_EXPR})?(?::(?:{_PY_EXPR})?)?)?"
_PY_PAIR = rf"(?:{_PY_EXPR}:{_PY_EXPR}|{_PY_EXPR})"
PY_GROUPS = {
    "(": Group([re.compile(rf"(?:{_PY_ITEM}(?:,{_PY_ITEM})*+,?)?"), re.compile(rf"y(?:G?{_PY_LIST})?"), re.compile(r"[nk](?:a[nk])?(?:,[nk](?:a[nk])?)*+,?"), re.compile(rf"{_PY_EXPR}a{_PY_OPERAND}(?:,{_PY_EXPR}a{_PY_OPERAND})*+,?")]),
    "[": Group([re.compile(rf"(?:{_PY_SLICE}(?:,{_PY_SLICE})*+,?)?")]),
    "{": Group([re.compile(rf"(?:{_PY_PAIR}(?:,{_PY_PAIR})*+,?)?")]),
}


def python_problem(text: str) -> str | None:
    classes = "".join(map(_PY_CLASS.__getitem__, tokens := PY_TOKEN.findall("\n" + text)))
    if UNTERMINATED in classes:
        return "unterminated literal"
    if UNKNOWN in classes:
        return "stray character"
    top, wrong = fold(classes.replace(" ", ""), PY_GROUPS, lambda c, _: c.replace("\n", ""))
    if wrong:
        return wrong
    # Indentation of the logical lines: newline tokens outside brackets that a statement follows.
    indents = _py_indents(tokens)
    lines = [x for x in top.split("\n") if x]
    if len(indents) != len(lines):
        return "inconsistent lines"
    return _py_blocks(lines, indents)


def _py_indents(tokens: list[str]) -> list[int]:
    out, depth, width, fresh = [], 0, 0, True
    for t in tokens:
        c = t[0]
        if c == "\n":
            if not depth:
                width = len(t[1:].expandtabs(8)) if "\t" in t else len(t) - 1
                fresh = True
            continue
        if c == "#" or t == "\\\n":
            continue
        if fresh:
            out.append(width)
            fresh = False
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
    return out


_PY_OPENERS = {"L": "IEFWTXA", "E": "IE", "X": "TX", "Y": "TXL"}


def _py_blocks(lines: list[str], indents: list[int]) -> str | None:
    stack = [0]
    heads: list[str] = [""]
    opened = decorated = False
    for line, width in zip(lines, indents):
        if opened:
            if width <= stack[-1]:
                return "block without a body"
            stack.append(width)
            heads.append("")
            opened = False
        elif width > stack[-1]:
            return "unexpected indent"
        else:
            while width < stack[-1]:
                if heads[-1] == "T":
                    return "try without except"
                stack.pop()
                heads.pop()
            if width != stack[-1]:
                return "unindent to no outer level"
        c = line[0]
        if c in _PY_OPENERS:
            if not heads[-1] or heads[-1] not in _PY_OPENERS[c]:
                return "clause without its statement"
        elif heads[-1] in ("T", "t"):
            return "try without except"
        if decorated and not (c in "DC@" or line[:2] == "AD"):
            return "decorator without a definition"
        decorated = c == "@"
        if decorated:
            if not PY_DECORATOR.fullmatch(line):
                return "malformed decorator"
            heads[-1] = "@"
        elif m := PY_BLOCK.fullmatch(line):
            opened = not m["body"]
            heads[-1] = c
        elif PY_STATEMENT.fullmatch(line):
            heads[-1] = ""
        else:
            return "malformed statement"
    if opened:
        return "premature end: block without a body"
    if decorated:
        return "premature end: decorator without a definition"
    if "T" in heads:
        return "premature end: try without except"
    return None


# ---------------------------------------------------------------------------------------------------- JSON

JSON_TOKEN = re.compile(r"\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[\da-fA-F]{4})*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|[^ \t\r\n]")
_JSON_CLASS = Classes(
    {"true": "v", "false": "v", "null": "v"} | {c: c for c in "()[]{},:"},
    lambda t: "s" if t[0] == '"' and len(t) > 1 else "v" if t[-1].isdigit() and t[0] in "-0123456789" else UNTERMINATED if t == '"' else UNKNOWN,
)
_JSON_VALUE = r"[svBK]"
JSON_GROUPS = {
    "(": Group([]),
    "[": Group([re.compile(rf"(?:{_JSON_VALUE}(?:,{_JSON_VALUE})*+)?")]),
    "{": Group([re.compile(rf"(?:s:{_JSON_VALUE}(?:,s:{_JSON_VALUE})*+)?")]),
}


def json_problem(text: str) -> str | None:
    classes = "".join(map(_JSON_CLASS.__getitem__, JSON_TOKEN.findall(text)))
    if UNTERMINATED in classes:
        return "unterminated literal"
    if UNKNOWN in classes:
        return "stray character"
    top, wrong = fold(classes, JSON_GROUPS)
    return wrong or (None if len(top) == 1 and top in "svBK" else "not one value")


# ---------------------------------------------------------------------------------------------------- JavaScript, TypeScript

_JS_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
JS_TOKEN = re.compile(
    _JS_STRING + r"|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\n|#?[^\W\d][\w$]*|#?\$[\w$]*|(?<=[\w)\]$]) ?/(?![/*])=?"
    r"|/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    r"|0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?"
    r"|=>|\.\.\.|\?\.(?!\d)|\?\?=?|\*\*=?|===?|!==?|&&=?|\|\|=?|\+\+|--|<<=?|>>>=?|>>=|[<>+\-*%&|^]=|[^\s]",
    re.S,
)

# n name, d number, s literal, o binary operator, - sign, ! prefix, p ++ --, = assignment, a arrow, . member, e spread,
# < > angle brackets, | & of types; the rest are keywords, see below.
_JS_WORDS = _words(
    V="var let const", F="function", C="class", X="extends", R="return", T="throw", W="new", O="typeof void delete await yield",
    I="if", L="else", Q="for", H="while", U="do", Y="try", c="catch", Z="finally", S="switch", A="case", G="default",
    t="break continue debugger", i="import", x="export", j="in instanceof", M="async static get set of from as",
    n="this super null true false", E="enum",
) | {"=>": "a", "...": "e", "?.": ".", ".": ".", "++": "p", "--": "p", "!": "!", "~": "!", "+": "-", "-": "-", "*": "*", "<": "<", ">": ">", "|": "|", "&": "&"} | {
    t: "=" for t in "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()
} | {t: "o" for t in "/ % ** << >>> <= >= == != === !== && || ?? ^".split()} | {" /": "o", " /=": "=", "\n": "\n"} | {c: c for c in "()[]{},:;?@"}
_TS_WORDS = _JS_WORDS | _words(m="public private protected readonly abstract declare override", f="interface namespace module", k="type", X="extends implements", M="async static get set of from is keyof infer asserts", z="as satisfies")


def _js_kind(token: str) -> str:
    c = token[0]
    if c == "/":
        return " " if token[1:2] in ("/", "*") else "s" if len(token) > 1 else "o"
    if c in "\"'`":
        return "s" if len(token) > 1 else UNTERMINATED
    if c.isdigit() or c == "." and len(token) > 1:
        return "d"
    if c.isalpha() or c in "_$" or c == "#" and len(token) > 1 or token.isidentifier():
        return "n"
    return UNKNOWN


_JS_CLASS, _TS_CLASS = Classes(_JS_WORDS, _js_kind), Classes(_TS_WORDS, _js_kind)

_JS_NAME = "[nMz]"
_JS_ANY = "[nMVFCXRTWOIUQHLYcZSAGtixjEmfkz]"
_JS_POSTFIX = rf"(?:[PBs]|\.(?:{_JS_ANY}|B|P)|p)*+"
_JS_OPERAND = rf"(?:[-!pe]|O\*?|W(?=[nMzPDW]))*+(?:[nMzsdPBKD]|W\.n|i(?=[P.])){_JS_POSTFIX}"
_JS_BINARY = r"(?:[-o*<>|&=aj?:]|\?)"
_JS_EXPR = rf"{_JS_OPERAND}(?:{_JS_BINARY}{_JS_OPERAND})*+"
_JS_EXPRS = rf"{_JS_EXPR}(?:,{_JS_EXPR})*+"
_JS_TARGET = rf"(?:{_JS_NAME}|[BK])"
_JS_DECLARE = rf"V(?:{_JS_TARGET}(?:={_JS_EXPR})?)(?:,{_JS_TARGET}(?:={_JS_EXPR})?)*+"
_JS_END = r"(?:;|\n|$)"
_JS_SIMPLE = (
    rf"(?:{_JS_DECLARE}|R(?:{_JS_EXPRS})?|T{_JS_EXPRS}|t{_JS_NAME}?|{_JS_EXPRS}"
    rf"|i(?:s|(?:{_JS_NAME}(?:,(?:K|\*[Mz]n))?|K|\*[Mz]{_JS_NAME})Ms)|x(?:K(?:Ms)?|\*(?:[Mz]{_JS_NAME})?Ms|G{_JS_EXPR}|{_JS_DECLARE}))"
)
_JS_STATEMENT = (
    rf"(?:(?:I\n*P|Q[MO]?\n*P|H\n*P|{_JS_NAME}:)\n*)*+(?:L\n*(?:(?:I\n*P|Q[MO]?\n*P|H\n*P)\n*)*+)?"
    rf"(?:[;\n]|(?:xG?)?D(?!P?[.o=a?])|K(?![.o=?])|YK\n*(?:c(?:P)?K\n*(?:ZK)?|ZK)|SPK|U\n*(?:K|{_JS_SIMPLE};?)\n*H\n*P;?|{_JS_SIMPLE}{_JS_END})"
)
_JS_CASE = rf"(?:(?:A{_JS_OPERAND}(?:[-o*<>|&=aj]{_JS_OPERAND})*+|G):|{_JS_STATEMENT})"
_JS_KEY = rf"(?:{_JS_ANY}|[sdB])"
_JS_MEMBER = rf"(?:M*\*?{_JS_KEY}PK|{_JS_KEY}(?::{_JS_EXPR}|={_JS_EXPR})?|e{_JS_EXPR})"
_JS_FIELD = rf"(?:[;\n]|@{_JS_NAME}(?:\.{_JS_NAME})*+P?\n?|[Mm]*\*?{_JS_KEY}PK|[Mm]*{_JS_KEY}(?:={_JS_EXPR})?{_JS_END}|MK)"
JS_TOP = re.compile(rf"(?:{_JS_STATEMENT})*+")


def _js_groups() -> dict[str, Group]:
    comma = rf"(?:{_JS_EXPR})"
    return {
        "(": Group([re.compile(rf"(?:{comma}(?:,{comma})*+,?)?"), re.compile(rf"(?:{_JS_DECLARE}|{_JS_EXPRS})?;(?:{_JS_EXPRS})?;(?:{_JS_EXPRS})?"), re.compile(rf"V?{_JS_TARGET}(?:M|j){_JS_EXPRS}")]),
        "[": Group([re.compile(rf",*(?:{comma}(?:,+{comma})*+,*)?")]),
        "{": Group([
            re.compile(rf"(?:{_JS_MEMBER}(?:,{_JS_MEMBER})*+,?)?"),
            re.compile(rf"(?:{_JS_NAME}|G)(?:[Mz]{_JS_ANY})?(?:,(?:{_JS_NAME}|G)(?:[Mz]{_JS_ANY})?)*+,?"),
            JS_TOP,
            re.compile(rf"(?:{_JS_FIELD})*+"),
            re.compile(rf"(?:{_JS_CASE})*+"),
        ]),
    }


JS_GROUPS, TS_GROUPS = _js_groups(), _js_groups()
# The body of an interface or of an object type, its types taken out.
TS_GROUPS["{"].forms.append(re.compile(rf"(?:\n|[mM]*(?:{_JS_KEY}\??P?|P|WP)(?:[;,\n]|$))*+"))

_JS_JOIN = re.compile(r"(?<=[-o*<>|&=aj?:,.!WOeXRTi@(])\n+|\n+(?=[-o*<>|&=j?:,.aX)])|(?<=[^;\n])\n+(?=[.?])")
_JS_JOIN_NOT_R = re.compile(r"(?<=[o*<>|&=aj?:,.!WOeX(])\n+|\n+(?=[o*<>|&=j?:,.aX)])|(?<=-)\n+|\n+(?=-)")
_JS_DEFINE = re.compile(rf"M?F\*?{_JS_NAME}?PK|C(?:{_JS_NAME}(?=[XK\n]))?(?:X(?:{_JS_NAME}|P)(?:\.{_JS_NAME}|P)*+)?\n*K")
_JS_REDEFINE = re.compile(r"\n+(?=K)")


def _js_prepare(content: str, bracket: str) -> str:
    if bracket != "{":
        content = content.replace("\n", "")
    elif "\n" in content:
        content = _JS_JOIN_NOT_R.sub("", content)
        if content[:1] == "\n":
            content = content.lstrip("\n")
    if "F" in content or "C" in content:
        content = _JS_DEFINE.sub("D", content)
    return content


def _javascript_prepare(content: str, bracket: str) -> str:
    # Outside braces a colon only ever ends a condition's second part.
    if bracket != "{" and content.count(":") > content.count("?"):
        return UNKNOWN
    return _js_prepare(content, bracket)


_TS_ATOM = r"(?:W?P(?:a)?|[nMOk]+(?:\.n)*+|s|d|-d|K|B)"
_TS_TYPE = rf"[|&]?(?:{_TS_ATOM}B*(?:[|&]|X|\?|:(?=[nK])|a|M(?=n))?)+?"
_TS_GENERIC = re.compile(r"(?<=[nMPFk.C])<(?:[nMOXs,|&.BKPa=dk?:]|\n)*>")
_TS_RETURN = re.compile(rf"(?<=P):{_TS_TYPE}(?=[K;a\n=]|$)")
_TS_VARIABLE = re.compile(rf"(?<=V)([nMBK])!?:{_TS_TYPE}(?=[=;,\nMj]|$)")
_TS_PARAM = re.compile(rf"((?:^|,)[mM@]*e?[nMBKk])\??:{_TS_TYPE}(?=[,=]|$)")
_TS_FIELD = re.compile(rf"((?:^|[;\n,K])[mM]*(?:{_JS_KEY}))[?!]?:{_TS_TYPE}(?=[;\n=]|$)")
_TS_DECLARE = re.compile(rf"m*(?:f|E|VE)(?:{_JS_NAME}|s)(?:\.n)*(?:X[nM.,]+)?\n*K|m*k{_JS_NAME}={_TS_TYPE}(?=[;\n]|$)")
_TS_AS = re.compile(rf"(?<=[nPBKsd])z(?:{_TS_ATOM})B*(?=[;,)\n.o=\-?:|&]|$)")
_TS_SIGNATURE = re.compile(r"(?:^|(?<=[;\n,K]))[mM]*(?:[nMW]?\??P|B)(?:)(?=[;,\n]|$)")


_TS_SURE = re.compile(r"(?<=[nPBK])!(?=[;,.)\n=\[PB]|$)")
_TS_PLAIN = re.compile(r"[fk](?![nMsz])")


def _ts_prepare(content: str, bracket: str) -> str:
    if "f" in content or "k" in content:
        content = _TS_PLAIN.sub("n", content)
    if "<" in content:
        for _ in range(4):
            new = _TS_GENERIC.sub("", content)
            if new == content:
                break
            content = new
    if ":" in content:
        content = _TS_RETURN.sub("", content)
        content = _TS_VARIABLE.sub(r"\1", content)
        if bracket == "(":
            content = _TS_PARAM.sub(r"\1", content)
        elif bracket == "{" and "V" not in content and "A" not in content:
            content = _TS_FIELD.sub(r"\1", content)
    if "!" in content:
        content = _TS_SURE.sub("", content)
    if "z" in content:
        # In a list of names only braces can hold, "as" renames.
        content = _TS_AS.sub("", content) if bracket != "{" or ";" in content or "\n" in content else content
    if "f" in content or "k" in content or "E" in content:
        content = _TS_DECLARE.sub("D", content)
        content = content.replace("k", "n").replace("f", "n")
    if "m" in content:
        content = re.sub(r"m+(?=[CD])", "", content) if bracket == "{" else re.sub(r"(^|,)m+", r"\1", content)
    return _js_prepare(content, bracket)


def _js_problem(text: str, classes: Classes, groups: dict[str, Group], prepare) -> str | None:
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    got = "".join(map(classes.__getitem__, JS_TOKEN.findall(text)))
    if UNTERMINATED in got:
        return "unterminated literal"
    if UNKNOWN in got:
        return "stray character"
    top, wrong = fold(got.replace(" ", ""), groups, prepare)
    if wrong:
        return wrong
    top = prepare(top, "{")
    if "R" in top and re.search(r"(?:^|[;\n}KD])R", top):
        return "return outside a function"
    if re.search(rf"V{_JS_TARGET}(?:[;\n]|$)", top) and re.search(r"\bconst\s+[\w$]+\s*(?:;|\n|$)", text):
        return "const without a value"
    return None if JS_TOP.fullmatch(top) else "malformed statement"


def javascript_problem(text: str) -> str | None:
    return _js_problem(text, _JS_CLASS, JS_GROUPS, _javascript_prepare)


def typescript_problem(text: str) -> str | None:
    return _js_problem(text, _TS_CLASS, TS_GROUPS, _ts_prepare)


# ---------------------------------------------------------------------------------------------------- Java

JAVA_TOKEN = re.compile(
    r"\"\"\"[ \t]*\n(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|\"\"(?!\")|'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'"
    r"|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|[^\W\d][\w$]*|\$[\w$]*"
    r"|0[xXbB][\da-fA-F_.pP]+[lLfFdD]?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?"
    r"|->|::|\.\.\.|@interface\b|&&|\|\||\+\+|--|[<>=!+\-*/%&|^]=|<<=?|>>>?=|[^\s]",
    re.S,
)
_JAVA_WORDS = _words(
    m="public private protected static final abstract synchronized native transient volatile strictfp sealed default",
    C="class interface enum @interface", X="extends implements throws permits", R="return", T="throw", W="new", I="if", L="else",
    Q="for", H="while", U="do", Y="try", c="catch", Z="finally", S="switch", A="case", t="break continue", k="package", i="import",
    j="instanceof", w="assert", n="this super null true false int long short byte char float double boolean void", g="goto const",
) | {"->": "a", "::": ".", ".": ".", "...": "e", "++": "p", "--": "p", "!": "!", "~": "!", "+": "-", "-": "-", "*": "*", "<": "<", ">": ">", "&": "&", "|": "o", "?": "?", "@": "@"} | {
    t: "=" for t in "= += -= *= /= %= &= |= ^= <<= >>= >>>=".split()
} | {t: "o" for t in "/ % ^ && || == != <= >= <<".split()} | {c: c for c in "()[]{},:;"}


def _java_kind(token: str) -> str:
    c = token[0]
    if c == "/":
        return " "
    if c in "\"'":
        return "s" if len(token) > 1 else UNTERMINATED
    if c.isdigit() or c == "." and len(token) > 1:
        return "d"
    if c.isalpha() or c in "_$" or token.isidentifier():
        return "n"
    return UNKNOWN


_JAVA_CLASS = Classes(_JAVA_WORDS, _java_kind)
_JAVA_GENERIC = re.compile(r"(?<=[n.mW])<(?:[n,.?XB&@])*>|(?<=m)<(?:[n,.?XB&])*>|^<(?:[n,.?XB&])*>")
_JV_TYPE = r"n(?:\.n)*+B*+"
_JV_PRIMARY = rf"(?:n|s|d|P|B|SPK|W{_JV_TYPE}(?:PK?|B*+K)?)(?:\.(?:[nCW]|Wn)|P|B|p)*+"
_JV_OPERAND = rf"(?:[-!p]|P(?=[nsdPW!S]))*(?:{_JV_PRIMARY})"
_JV_BINARY = r"(?:[-o*<>&=?:]|>>|>>>)"
_JV_EXPR = rf"(?:(?:[nP])aK|(?:[nP]a)?{_JV_OPERAND})(?:{_JV_BINARY}(?:(?:[nP])aK|(?:[nP]a)?{_JV_OPERAND})|jm?{_JV_TYPE}(?:n|P)?)*+"
_JV_EXPRS = rf"{_JV_EXPR}(?:,{_JV_EXPR})*+"
_JV_NOTE = r"(?:@n(?:\.n)*+P?)"
_JV_MOD = rf"(?:m|{_JV_NOTE})*+"
_JV_VAR = rf"nB*+(?:=(?:{_JV_EXPR}|K))?"
_JV_LOCAL = rf"{_JV_MOD}{_JV_TYPE}{_JV_VAR}(?:,{_JV_VAR})*+"
_JV_TYPES = rf"{_JV_TYPE}(?:[,&]{_JV_TYPE})*+"
_JV_CLASS = rf"{_JV_MOD}(?:Cn|nn(?=P))P?(?:X{_JV_TYPES})*+K"
_JV_SIMPLE = rf"(?:{_JV_LOCAL}|R(?:{_JV_EXPR})?|T{_JV_EXPR}|tn?|w{_JV_EXPR}|n{_JV_EXPR}|{_JV_EXPRS})"
_JV_STATEMENT = (
    rf"(?:IP|QP|HP|L|n:)*+(?:;|K|{_JV_CLASS}|YP?K(?:cPK)*+(?:ZK)?|SPK|mPK|U(?:K|{_JV_SIMPLE};)HP;|{_JV_SIMPLE};)"
)
_JV_CASE = rf"(?:(?:A(?:{_JV_EXPRS}|{_JV_TYPE}n|m)|m)(?::|a)|{_JV_STATEMENT})"
_JV_MEMBER = (
    rf"(?:;|{_JV_CLASS}|m?K|{_JV_MOD}(?:{_JV_TYPE})?nPB*+(?:X{_JV_TYPES})?(?:K|(?:m(?:{_JV_EXPR}|K))?;)|{_JV_LOCAL};)"
)
_JV_ENUM = rf"(?:{_JV_NOTE}*+nP?K?(?:,{_JV_NOTE}*+nP?K?)*+,?)?(?:;(?:{_JV_MEMBER})*+)?"
_JV_PARAM = rf"{_JV_MOD}{_JV_TYPE}(?:e?n(?:\.n)?B*+)"
JAVA_GROUPS = {
    "(": Group([
        re.compile(rf"(?:{_JV_PARAM}(?:,{_JV_PARAM})*+)?"), re.compile(_JV_EXPRS), re.compile(rf"(?:{_JV_LOCAL}|{_JV_EXPRS})?;(?:{_JV_EXPR})?;(?:{_JV_EXPRS})?"),
        re.compile(rf"{_JV_MOD}{_JV_TYPE}n:{_JV_EXPR}"), re.compile(rf"{_JV_MOD}{_JV_TYPE}(?:o{_JV_TYPE})*+n"), re.compile(rf"(?:{_JV_LOCAL}|{_JV_EXPR})(?:;(?:{_JV_LOCAL}|{_JV_EXPR}))*+;?"),
        re.compile(_JV_TYPES), re.compile(rf"n=(?:{_JV_EXPR}|K)(?:,n=(?:{_JV_EXPR}|K))*+"), re.compile(r"K"),
    ]),
    "[": Group([re.compile(rf"(?:{_JV_EXPR})?")]),
    "{": Group([
        re.compile(rf"(?:{_JV_STATEMENT})*+"), re.compile(rf"(?:{_JV_MEMBER})*+"), re.compile(rf"(?:(?:{_JV_EXPR}|K|{_JV_NOTE})(?:,(?:{_JV_EXPR}|K|{_JV_NOTE}))*+,?)?"),
        re.compile(_JV_ENUM), re.compile(rf"(?:{_JV_CASE})*+"),
    ]),
}
JAVA_TOP = re.compile(rf"(?:{_JV_NOTE}*+kn(?:\.n)*+;)?;*(?:im?n(?:\.n)*+(?:\.\*)?;+)*+(?:;|{_JV_CLASS})*+")


def _java_prepare(content: str, bracket: str) -> str:
    if "<" in content:
        for _ in range(4):
            new = _JAVA_GENERIC.sub("", content)
            if new == content:
                break
            content = new
    return content


def java_problem(text: str) -> str | None:
    got = "".join(map(_JAVA_CLASS.__getitem__, JAVA_TOKEN.findall(text)))
    if UNTERMINATED in got:
        return "unterminated literal"
    if UNKNOWN in got:
        return "stray character"
    top, wrong = fold(got.replace(" ", ""), JAVA_GROUPS, _java_prepare)
    if wrong:
        return wrong
    return None if JAVA_TOP.fullmatch(_java_prepare(top, "{")) else "malformed declaration"


# ---------------------------------------------------------------------------------------------------- Go

GO_TOKEN = re.compile(
    r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][\da-fA-F]*)'|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\n|[^\W\d]\w*"
    r"|0[xXbBoO][\da-fA-F_.pP]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?"
    r"|:=|\.\.\.|<-|&\^=?|&&|\|\||\+\+|--|<<=?|>>=?|[<>=!+\-*/%&|^]=|[^\s]"
)
_GO_WORDS = _words(
    k="package", i="import", F="func", V="var const", y="type", s_="", S="struct interface", M="map", H="chan", R="return", t="break continue goto",
    f="fallthrough", D="defer go", I="if", L="else", Q="for", r="range", W="switch", Z="select", A="case", G="default",
) | {":=": ":=", "...": "e", "<-": "h", "++": "p", "--": "p", "!": "!", "~": "!", "^": "-", "+": "-", "-": "-", "*": "*", "&": "&", ".": ".", "\n": "\n"} | {
    t: "=" for t in "= += -= *= /= %= &= |= ^= <<= >>= &^=".split()
} | {t: "o" for t in "/ % | << >> &^ && || == != < <= > >=".split()} | {c: c for c in "()[]{},:;"}
_GO_WORDS[":="] = "a"


def _go_kind(token: str) -> str:
    c = token[0]
    if c == "/":
        return "\n" if token[1] == "*" and "\n" in token else " "
    if c in "\"'`":
        return "s" if len(token) > 1 else UNTERMINATED
    if c.isdigit() or c == "." and len(token) > 1:
        return "d"
    if c.isalpha() or c == "_":
        return "n"
    return UNKNOWN


_GO_CLASS = Classes({k: v for k, v in _GO_WORDS.items() if k}, _go_kind)
_GO_SEMI = re.compile(r"(?<=[nds)\]}RtfpPBK])\n+")
_GO_TYPE = r"(?:(?:\*|B|MB|h?Hh?|e)*+(?:n(?:\.n)?B?|S(?:K)|FP(?:P|n(?:\.n)?)?|P))"
_GO_LITERAL = r"(?:(?:B(?:\*)*+|MB(?:\*|B)*+)(?:n(?:\.n)?|SK|FP|MBn)K?|(?:n(?:\.n)*+B?|SK|MBn|MBSK)K|MB(?:MB)*+(?:B|\*)*+n(?:\.n)?|HK?n)"
_GO_FUNC = rf"FP(?:P|{_GO_TYPE})?K"
_GO_OPERAND = rf"(?:[-!*&h])*+(?:{_GO_FUNC}|{_GO_LITERAL}|[ndsPSM]|B{_GO_TYPE}|Hn)(?:[PB]|\.(?:n|P|yP))*+K?e?"
_GO_OPERAND_NK = rf"(?:[-!*&h])*+(?:{_GO_FUNC}|(?:B(?:\*)*+n(?:\.n)?|MBB*+n)K|[ndsP])(?:[PB]|\.(?:n|P))*+"
_GO_EXPR = rf"{_GO_OPERAND}(?:[-o*&]{_GO_OPERAND})*+"
_GO_EXPR_NK = rf"{_GO_OPERAND_NK}(?:[-o*&]{_GO_OPERAND_NK})*+"
_GO_EXPRS = rf"{_GO_EXPR}(?:,{_GO_EXPR})*+"
_GO_EXPRS_NK = rf"{_GO_EXPR_NK}(?:,{_GO_EXPR_NK})*+"
_GO_SIMPLE = rf"(?:{_GO_EXPRS}(?:[=a]{_GO_EXPRS}|p|h{_GO_EXPR})?)"
_GO_SIMPLE_NK = rf"(?:{_GO_EXPRS_NK}(?:[=a]{_GO_EXPRS_NK}|p)?)"
_GO_SPEC = rf"n(?:,n)*+(?:{_GO_TYPE})?(?:={_GO_EXPRS})?"
_GO_DECL = rf"(?:V(?:{_GO_SPEC}|P)|y(?:nB?=?{_GO_TYPE}|P))"
_GO_IF = rf"I(?:{_GO_SIMPLE_NK};)?{_GO_EXPR_NK}K"
_GO_STATEMENT = (
    rf"(?:n:)?(?:{_GO_IF}(?:L{_GO_IF})*+(?:LK)?|Q(?:(?:{_GO_EXPRS_NK}[=a])?r{_GO_EXPR_NK}|(?:{_GO_SIMPLE_NK})?;(?:{_GO_EXPR_NK})?;(?:{_GO_SIMPLE_NK})?|{_GO_EXPR_NK})?K"
    rf"|W(?:{_GO_SIMPLE_NK};)?(?:{_GO_SIMPLE_NK})?K|ZK|D{_GO_EXPR}|R(?:{_GO_EXPRS})?|tn?|f|{_GO_DECL}|K|{_GO_SIMPLE})?"
)
_GO_BODY = rf"(?:{_GO_STATEMENT};)*+(?:{_GO_STATEMENT})"
_GO_CASE = rf"(?:(?:A(?:{_GO_EXPRS}|{_GO_SIMPLE}|{_GO_TYPE}(?:,{_GO_TYPE})*+)|G):;*(?:{_GO_STATEMENT};)*+)*+(?:{_GO_STATEMENT})"
_GO_ELEMENT = rf"(?:{_GO_EXPR}|K)(?::(?:{_GO_EXPR}|K))?"
_GO_FIELD = rf"(?:n(?:,n)*+{_GO_TYPE}s?|\*?n(?:\.n)?s?|nP(?:P|{_GO_TYPE})?|{_GO_TYPE}(?:o{_GO_TYPE})*+)?"
_GO_PARAM = rf"(?:n(?:,n)*+)?{_GO_TYPE}"
GO_GROUPS = {
    "(": Group([
        re.compile(rf"(?:(?:{_GO_PARAM}|n)(?:,(?:{_GO_PARAM}|n))*+,?)?"), re.compile(rf"(?:(?:{_GO_EXPRS}|{_GO_TYPE}(?:,{_GO_EXPRS})?),?)?"),
        re.compile(r"(?:(?:[n.]?s)?;)*+(?:[n.]?s)?"), re.compile(rf"(?:(?:{_GO_SPEC})?;)*+(?:{_GO_SPEC})?"), re.compile(rf"(?:(?:nB?=?{_GO_TYPE})?;)*+(?:nB?=?{_GO_TYPE})?"), re.compile("y"),
    ]),
    "[": Group([re.compile(rf"(?:{_GO_EXPR})?(?::(?:{_GO_EXPR})?(?::{_GO_EXPR})?)?|e"), re.compile(rf"{_GO_TYPE}(?:,{_GO_TYPE})*+"), re.compile(rf"n(?:,n)*+{_GO_TYPE}(?:o{_GO_TYPE})*+")]),
    "{": Group([
        re.compile(_GO_BODY), re.compile(rf"(?:{_GO_ELEMENT}(?:,{_GO_ELEMENT})*+,?)?"), re.compile(rf"(?:{_GO_FIELD};)*+{_GO_FIELD}"), re.compile(_GO_CASE),
    ]),
}
GO_TOP = re.compile(rf";*kn;(?:;|i(?:P|[n.]?s);)*+(?:(?:F(?:P)?nB?P(?:P|{_GO_TYPE})?K?|{_GO_DECL})?;)*+")


def go_problem(text: str) -> str | None:
    got = "".join(map(_GO_CLASS.__getitem__, GO_TOKEN.findall(text)))
    if UNTERMINATED in got:
        return "unterminated literal"
    if UNKNOWN in got:
        return "stray character"
    # A line that may end a statement ends in a semicolon; the last line counts as ended.
    got = _GO_SEMI.sub(";", got.replace(" ", "") + "\n").replace("\n", "")
    top, wrong = fold(got, GO_GROUPS)
    if wrong:
        return wrong
    return None if GO_TOP.fullmatch(top) else "malformed declaration"


CHECKS = {
    "python": python_problem,
    "javascript": javascript_problem,
    "typescript": typescript_problem,
    "java": java_problem,
    "go": go_problem,
    "json": json_problem,
}
#: Languages of which a file without any token is valid.
MAY_BE_EMPTY = {"python", "javascript", "typescript", "java"}


def problem(language: str, text: str | None) -> str | None:
    """What is wrong with the text as a file of the language; null texts count as empty."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if language != "json":
        text = text.removeprefix("﻿")
    if not text.strip():
        return None if language in MAY_BE_EMPTY else "empty"
    found = CHECKS[language](text)
    if found and language != "json" and CONFLICT.search(text):
        return "merge conflict"
    return found
