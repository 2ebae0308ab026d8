"""Parsing of source files with bundled grammars: one entry for all languages."""

from __future__ import annotations

import bisect
import re
import sys
from dataclasses import dataclass, field
from functools import lru_cache

from ...syntax import elixir, lalr, normal
from ...syntax import tables as core_tables
from ...syntax.lalr import SyntaxFault
from . import erlang, javascript, json_lang, python_lang

#: Endings of paths and their languages.
ENDINGS = {".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".js": "javascript", ".py": "python", ".json": "json"}
_GRAMMARS = {"erlang": erlang, "javascript": javascript, "python": python_lang, "json": json_lang}


def language_of(path: str | None) -> str | None:
    """Language that the ending of a path stands for; None for others and for a null path."""
    m = re.search(r"\.[A-Za-z]+$", path or "")
    return ENDINGS.get(m.group().lower()) if m else None


@lru_cache(maxsize=None)
def tables(lang: str) -> lalr.Tables:
    """The parse tables of a language, generated once per process from its grammar."""
    return core_tables(lang) if lang == "elixir" else lalr.Tables(_GRAMMARS[lang].GRAMMAR)


@dataclass
class Parsed:
    """What one parse yields.  ``fault`` is the first unrecoverable error, else None and ``tree`` holds the whole file.

    ``tokens``: (terminal, text, line, start); ``comments``: (start, text, line); ``strings``: (start, text, line, kind).
    """

    lang: str
    fault: SyntaxFault | None = None
    tree: object = None
    tokens: list = field(default_factory=list)
    comments: list = field(default_factory=list)
    strings: list = field(default_factory=list)


def parse_source(lang: str, text: str) -> Parsed:
    """Parse normalised text.  Lexer results found before a fault are kept where the lexer came that far.

    Texts within texts are lexed by recursion; where one nests beyond the interpreter's limit, the limit is raised for it to what its length allows.
    """
    try:
        return _parsed(lang, text)
    except RecursionError:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(limit + 4 * len(text))
        try:
            return _parsed(lang, text)
        finally:
            sys.setrecursionlimit(limit)


def _parsed(lang: str, text: str) -> Parsed:
    p = Parsed(lang)
    t = tables(lang)
    try:
        if lang == "elixir":
            x = elixir.lex(text)
            p.tokens, p.comments, p.strings = x.tokens, x.comments, x.texts
            p.tree = elixir.read(t, text, x)
        elif lang == "erlang":
            p.tokens, p.comments = erlang.lex(text)
            p.strings = [(k[3], k[1].strip('"'), k[2], "string") for k in p.tokens if k[0] == "STR"]
            p.tree = lalr.parse(t, p.tokens)
            erlang.check(p.tree, p.tokens)
        elif lang == "javascript":
            x = javascript.Lexed()
            p.tokens, p.comments, p.strings = x.tokens, x.comments, x.strings
            p.tree = javascript.read(t, text, x)
            p.strings = [(*s, "string") for s in p.strings]
        elif lang == "python":
            x = python_lang.lex(text)
            p.tokens, p.comments = x[0], x[1]
            p.strings = [(a, b, c, "string") for a, b, c, _ in x[2]]
            p.tree = python_lang.read(t, text, x)
        else:
            p.tokens = json_lang.lex(text)
            p.tree = lalr.parse(t, p.tokens)
    except SyntaxFault as e:
        p.fault = e
    return p


def fault_of(lang: str, text: str) -> SyntaxFault | None:
    """The first unrecoverable error; an empty code file is valid, an empty JSON file is not."""
    return parse_source(lang, text).fault


@dataclass
class Function:
    """A function with the documentation attached to it (None without any) and its source range: offsets in the normalised text, and lines.

    ``module`` is the place of the module that an Elixir clause stands in; clauses of one function agree in it.
    """

    name: str
    arity: int
    doc: str | None
    hidden: bool
    line: int
    kind: str = "function"
    start: int = 0
    end: int = 0
    end_line: int = 0
    module: int | None = None


def _range(tokens: list, text: str, first: int, past: int) -> tuple[int, int, int]:
    """Start, end and last line of the tokens [first, past), without line ends and layout tokens at the end."""
    while past - 1 > first and tokens[past - 1][0] in ("NEWLINE", "INDENT", "DEDENT", "ASI", "sep"):
        past -= 1
    start, last = tokens[first][3], tokens[past - 1]
    end = last[4] if len(last) > 4 else last[3] + len(last[1])
    return start, end, tokens[first][2] + text.count("\n", start, end)


def functions(p: Parsed, text: str) -> list[Function]:
    """Functions of a valid file, one per clause, with their documentation by the convention of the language."""
    if p.fault is not None or p.lang == "json":
        return []
    return {"elixir": _elixir, "erlang": _erlang, "javascript": _javascript, "python": _python}[p.lang](p, text)


_DEFS = frozenset(["def", "defp", "defmacro", "defmacrop", "defguard", "defguardp", "defdelegate"])


def _head(x) -> tuple[str, int] | None:
    """Name and arity of a definition's head."""
    while type(x) is tuple and x[0] == "bin" and x[1][1] == "when":
        x = x[1][0]
    if type(x) is str:
        return (x, 0) if re.fullmatch(r"[a-z_]\w*[?!]?", x) else None
    if type(x) is not tuple:
        return None
    label, kids = x
    if label == "call" and type(kids[0]) is str:
        if kids[0] == "unquote":
            return None
        args = next((k for k in kids[1:] if type(k) is list), [])
        return kids[0], len(args)
    if label == "bin" and type(kids[1]) is str:
        return kids[1], 2
    if label == "un":
        return kids[0], 1
    return None


def _elixir(p: Parsed, text: str) -> list[Function]:
    out: list[Function] = []
    tokens = p.tokens

    def strip2(x):
        return (x[0], x[1]) if type(x) is tuple else x

    def body(items, module: int) -> None:
        doc, hidden = None, False
        for it in items:
            if type(it) is not tuple:
                continue
            label, kids, start = it[:3]
            if label == "at":
                inner = kids[1]
                if type(inner) is tuple and inner[0] in ("call",) and kids_name(inner) == "doc":
                    arg = next((k for k in inner[1][1:] if type(k) is list), [])
                    if not arg:
                        continue
                    a = arg[0]
                    if type(a) is list or type(a) is tuple and a[0] == "kw":
                        continue
                    if a in ("false",) and type(a) is str and tokens[inner[2] + 1][0] in ("LIT", "("):
                        doc, hidden = None, True
                    elif type(a) is str:
                        k = tokens[a_index(inner)]
                        doc, hidden = (a, False) if k[0] in ("STR", "SIGIL", "CHARS") else (None, False)
                    elif type(a) is tuple:
                        doc, hidden = " ".join(strings_in(a)), False
                continue
            name = kids_name(it)
            if label in ("call", "call_do") and name in _DEFS:
                args = next((k for k in kids[1:] if type(k) is list), [])
                h = _head3(args[0]) if args else None
                if h:
                    public = name in ("def", "defmacro", "defguard", "defdelegate")
                    out.append(Function(h[0], h[1], doc if public else None, hidden or not public, tokens[start][2], name, *_range(tokens, text, start, it[3]), module))
                doc, hidden = None, False
                continue
            if label == "call_do" and name in ("defmodule", "defprotocol", "defimpl"):
                walk_block(kids[-1], start)
                doc, hidden = None, False

    def kids_name(x) -> str | None:
        k = x[1]
        return k[0] if k and type(k[0]) is str else None

    def a_index(call) -> int:
        i = call[2] + 1
        return i + 1 if tokens[i][0] == "(" else i

    def strings_in(x) -> list[str]:
        got, todo = [], [x]
        while todo:
            y = todo.pop(0)
            if type(y) is tuple:
                todo = list(y[1]) + todo
            elif type(y) is list:
                todo = y + todo
            elif type(y) is str and not re.fullmatch(r"<>|\W{1,3}", y):
                got.append(y)
        return got

    def _head3(x):
        while type(x) is tuple and x[0] == "bin" and x[1][1] == "when":
            x = x[1][0]
        return _head(strip2(x)) if type(x) is tuple else _head(x)

    def walk_block(b, module: int) -> None:
        if type(b) is tuple and b[0] == "do":
            for part in b[1]:
                if type(part) is list:
                    body([y for y in part], module)

    def top(items) -> None:
        for it in items:
            if type(it) is tuple and it[0] == "call_do" and kids_name(it) in ("defmodule", "defprotocol", "defimpl"):
                walk_block(it[1][-1], it[2])

    top(p.tree)
    return out


_EDOC_TAG = re.compile(r"^@([a-z]+)\b", re.I)


def _erlang(p: Parsed, text: str) -> list[Function]:
    """Comments right before a function, with attributes of the function allowed between, are its documentation."""
    out: list[Function] = []
    tokens = p.tokens
    comments = sorted(p.comments)
    own_line = [c for c in comments if not text[text.rfind("\n", 0, c[0]) + 1:c[0]].strip()]
    ci = 0
    pending: list[str] = []
    for form in p.tree:
        if type(form) is not tuple and type(form) is not list:
            continue
        clauses = form if type(form) is list else None
        if clauses is not None and not (clauses and type(clauses[0]) is tuple and clauses[0][0].startswith("fclause")):
            continue
        start = clauses[0][2] if clauses else form[2]
        at, line = tokens[start][3], tokens[start][2]
        block: list[tuple] = []
        while ci < len(own_line) and own_line[ci][0] < at:
            block.append(own_line[ci])
            ci += 1
        # comments since the last form that is no attribute of a function; a gap of blank lines does not detach them
        pending = pending + [c[1] for c in block]
        if clauses:
            doc, hidden = edoc(pending)
            name = clauses[0][1][0]
            args = clauses[0][1][2] if clauses[0][0] == "fclause" else []
            out.append(Function(name.strip("'"), len(args), doc, hidden, line, "function", *_range(tokens, text, start, clauses[-1][3] + 1)))
            pending = []
        elif form[0] not in ("spec", "typedef"):
            if not (form[0] == "attr" and len(form[1]) > 1 and form[1][1] in ("deprecated", "dialyzer", "compile")):
                pending = []
    return out


def edoc(lines: list[str]) -> tuple[str | None, bool]:
    """Text of the @doc tag of a comment block, and whether the block hides the function."""
    doc: list[str] | None = None
    hidden = False
    collecting = False
    for raw in lines:
        s = raw.lstrip("%").strip()
        m = _EDOC_TAG.match(s)
        if m:
            tag = m.group(1).lower()
            collecting = tag == "doc"
            if tag in ("hidden", "private"):
                hidden = True
            if collecting:
                doc = [s[m.end():].strip()]
            continue
        if collecting and doc is not None:
            doc.append(s)
    return ("\n".join(doc).strip() if doc is not None else None), hidden


_HIDE = re.compile(r"^@(?:private|ignore|hidden|internal)\b", re.M)


def jsdoc(comment: str) -> tuple[str, bool]:
    """Description of a ``/** */`` comment, and whether it hides its function."""
    lines = [re.sub(r"^[ \t]*\*[ \t]?", "", x).strip() for x in comment[3:-2].split("\n")]
    desc, on = [], True
    for x in lines:
        if x.startswith("@"):
            m = re.match(r"@(?:description|desc|summary)\b\s*(.*)", x)
            on = bool(m)
            if m:
                desc.append(m.group(1))
            elif re.match(r"@(?:todo)\b", x, re.I):
                desc.append(x)
            continue
        if on:
            desc.append(x)
    return "\n".join(desc).strip(), bool(_HIDE.search("\n".join(lines)))


def _javascript(p: Parsed, text: str) -> list[Function]:
    out: list[Function] = []
    tokens = p.tokens
    docs: dict[int, str] = {}  # start of the next token -> comment
    ends = [(c[0] + len(c[1]), c[1]) for c in p.comments]
    starts = [t[3] for t in tokens]
    for end, c in ends:
        i = bisect.bisect_left(starts, end)
        while i < len(starts) and tokens[i][0] == "ASI":
            i += 1
        if i < len(starts):
            if c.startswith("/**") and len(c) > 4:
                docs[i] = c

    def count(params) -> int:
        for k in params[1]:
            if type(k) is list:
                return len(k)
        return 0

    def doc_at(i: int):
        c = docs.get(i)
        return jsdoc(c) if c is not None else (None, False)

    def add(name, params, start, end, kind="function"):
        d, h = doc_at(start)
        out.append(Function(name, params if type(params) is int else count(params), d, h, tokens[start][2], kind, *_range(tokens, text, start, end)))

    def value(name, v, start) -> None:
        """A variable, field or property that holds a function."""
        if type(v) is not tuple:
            return
        end = v[3]
        while type(v) is tuple and v[0] == "paren":
            v = v[1][1]
        if type(v) is not tuple:
            return
        label, kids = v[0], v[1]
        if label == "arrow1":
            add(name, 1, start, end)
        elif label == "arrow":
            add(name, len(next((k for k in kids if type(k) is list), [])), start, end)
        elif label in ("fun0", "fun", "gen0", "gen", "afun0", "afun", "agen0", "agen"):
            add(name, next(k for k in kids if type(k) is tuple and k[0] == "params"), start, end)

    def visit(x, start=None) -> None:
        todo = [(x, start)]
        while todo:
            y, at = todo.pop()
            if type(y) is list:
                todo.extend((z, None) for z in reversed(y))
                continue
            if type(y) is not tuple:
                continue
            label, kids, i = y[:3]
            at = i if at is None else at
            if label == "export":
                todo.extend((k, i) if type(k) is tuple else (k, None) for k in reversed(kids))
                decls = next((k for k in kids if type(k) is list), None)
                if decls:
                    todo = [t for t in todo if t[0] is not decls]
                    for d in decls:
                        value(d[1][0], d[1][-1] if len(d[1]) == 3 else None, i)
                        todo.append((d[1][-1], None))
                continue
            if label == "var":
                for n, d in enumerate(kids[1]):
                    if len(d[1]) == 3 and type(d[1][0]) is str:
                        value(d[1][0], d[1][2], i if n == 0 else d[2])
            elif label in ("fun", "gen", "afun", "agen"):
                k = [z for z in kids if type(z) is str and z not in ("function", "function_x", "async", "*")]
                if tokens[i][0] in ("function", "async") and k:
                    add(k[0], next(z for z in kids if type(z) is tuple and z[0] == "params"), at, y[3])
            elif label in ("method", "getter", "setter", "mgen", "amethod", "amgen"):
                k = [z for z in kids if type(z) is str and z not in ("get", "set", "*", "async")] or [z for z in kids if type(z) is str]
                if k:
                    first = i - 1 if i and tokens[i - 1][0] == "static" else i
                    add(k[0], next(z for z in kids if type(z) is tuple and z[0] == "params"), first, y[3], "method")
            elif label == "field" and len(kids) == 3 and type(kids[0]) is str:
                value(kids[0], kids[2], i - 1 if i and tokens[i - 1][0] == "static" else i)
            todo.extend((z, None) for z in reversed(kids) if type(z) in (tuple, list))

    visit(p.tree)
    return out


def _python(p: Parsed, text: str) -> list[Function]:
    out: list[Function] = []
    todo = [p.tree]
    while todo:
        y = todo.pop()
        if type(y) is list:
            todo.extend(y)
            continue
        if type(y) is not tuple:
            continue
        label, kids, i, end = y
        if label in ("def", "adef"):
            name = next(k for k in kids if type(k) is str and k not in ("def", "async"))
            params = next((k for k in kids if type(k) is list), [])
            n = sum(q[0] in ("p", "pd", "pkw") or q[0] == "pstar" and len(q[1]) > 1 for q in params)
            out.append(Function(name, n, docstring(kids[-1]), False, p.tokens[i][2], "function", *_range(p.tokens, text, i, end)))
        todo.extend(k for k in kids if type(k) in (tuple, list))
    return sorted(out, key=lambda f: f.line)


def docstring(suite) -> str | None:
    """Text of the string that is a suite's first statement, without quotes and escapes of line ends."""
    label, kids = suite[0], suite[1]
    stmts = kids[0] if label == "suite1" else kids[2]
    first = stmts[0] if stmts else None
    if type(first) is list:
        first = first[0] if first else None
    if type(first) is not tuple or first[0] != "expr":
        return None
    x = first[1][0]
    if type(x) is not tuple or x[0] != "str":
        return None
    parts = []
    for s in x[1][0]:
        m = re.match(r"([A-Za-z]*)('''|\"\"\"|'|\")", s)
        if set(m.group(1).lower()) & set("bft"):
            return None
        parts.append(s[m.end():-len(m.group(2))])
    return "".join(parts)
