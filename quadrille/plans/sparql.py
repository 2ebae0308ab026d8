"""SPARQL text to DataFrame plans.

``run(graph, text)`` parses a query and compiles its algebra to DataFrame operations, so Catalyst orders joins, pushes filters into the scan of
each triple pattern and prunes columns.  Triple patterns that share a subject are given to the graph as one star, which a mapped graph answers from
a single table scan.  A variable is a column holding a term, ``struct<kind, value, dt, lang>``; an unbound variable is null.

Forms: SELECT (DISTINCT, expressions, *), ASK, CONSTRUCT, DESCRIBE.  Patterns: triples with ``;`` ``,`` ``a`` and blank nodes, paths of ``/`` ``^`` and
``|``, ``+`` and ``*`` of one predicate, FILTER, [NOT] EXISTS, OPTIONAL, UNION, MINUS, BIND, VALUES and sub-SELECT.  Modifiers: GROUP BY, HAVING,
ORDER BY, LIMIT, OFFSET.  A type error in a FILTER removes the row.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)"""
    r"""|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<bnode>_:\w[\w.-]*)|(?P<pname>(?:[A-Za-z][\w.-]*)?:(?:[\w%](?:[\w.%:-]*[\w%-])?)?)|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*/+^|-])""",
    re.X | re.S,
)
_AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


class QueryError(ValueError):
    """The text is no query this compiler accepts."""


@dataclass
class Group:
    """A group graph pattern: parts in order."""

    parts: list = field(default_factory=list)


@dataclass
class Query:
    form: str
    select: list = field(default_factory=list)  # (variable, expression or None)
    distinct: bool = False
    where: Group = field(default_factory=Group)
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    """Recursive descent over the tokens of a query."""

    def __init__(self, text: str, prefixes: dict[str, str]):
        self.prefixes = dict(prefixes)
        self.base = ""
        self.toks: list[tuple[str, str]] = []
        self.fresh = itertools.count()
        pos = 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise QueryError(f"cannot read {text[pos:pos + 30]!r}")
            pos = m.end()
            if m.lastgroup:
                self.toks.append((m.lastgroup, m.group()))
        self.i = 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.toks[self.i + n] if self.i + n < len(self.toks) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def word(self, *names: str) -> bool:
        k, v = self.peek()
        return k == "word" and v.upper() in names

    def take(self, *names: str) -> bool:
        if self.word(*names) or self.peek()[0] == "op" and self.peek()[1] in names:
            self.i += 1
            return True
        return False

    def need(self, name: str) -> None:
        if not self.take(name):
            raise QueryError(f"expected {name} before {self.peek()[1]!r}")

    def query(self) -> Query:
        while self.word("PREFIX", "BASE"):
            if self.next()[1].upper() == "BASE":
                self.base = self.next()[1][1:-1]
            else:
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1][1:-1]
        q = self.body()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return q

    def body(self) -> Query:
        k, v = self.next()
        form = v.upper()
        q = Query(form)
        if form == "SELECT":
            q.distinct = self.take("DISTINCT") or self.take("REDUCED") and False
            if self.take("*"):
                q.select = []
            else:
                while self.peek()[0] == "var" or self.peek()[1] == "(":
                    if self.take("("):
                        e = self.expr()
                        self.need("AS")
                        q.select.append((self.next()[1][1:], e))
                        self.need(")")
                    else:
                        q.select.append((self.next()[1][1:], None))
                if not q.select:
                    raise QueryError("SELECT needs variables")
            self.take("WHERE")
            q.where = self.group()
        elif form == "ASK":
            self.take("WHERE")
            q.where = self.group()
        elif form == "CONSTRUCT":
            if self.word("WHERE"):
                self.next()
                q.where = self.group()
                q.template = [t for p in q.where.parts if p[0] == "bgp" for t in p[1]]
            else:
                q.template = [t for p in self.group().parts if p[0] == "bgp" for t in p[1]]
                self.take("WHERE")
                q.where = self.group()
        elif form == "DESCRIBE":
            while self.peek()[0] in ("var", "iri", "pname"):
                q.describe.append(self.term())
            if self.word("WHERE") or self.peek()[1] == "{":
                self.take("WHERE")
                q.where = self.group()
        else:
            raise QueryError(f"unknown query form {v!r}")
        self.modifiers(q)
        return q

    def modifiers(self, q: Query) -> None:
        if self.take("GROUP"):
            self.need("BY")
            while self.peek()[0] == "var" or self.peek()[1] == "(":
                if self.take("("):
                    e = self.expr()
                    name = None
                    if self.take("AS"):
                        name = self.next()[1][1:]
                    self.need(")")
                    q.group.append((name or f"_g{next(self.fresh)}", e))
                else:
                    q.group.append((self.next()[1][1:], None))
        if self.take("HAVING"):
            while self.peek()[1] == "(":
                self.need("(")
                q.having.append(self.expr())
                self.need(")")
        if self.take("ORDER"):
            self.need("BY")
            while self.peek()[0] == "var" or self.peek()[1] == "(" or self.word("ASC", "DESC"):
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                if self.peek()[0] == "var":
                    e = ("var", self.next()[1][1:])
                else:
                    self.need("(")
                    e = self.expr()
                    self.need(")")
                q.order.append((e, down))
        while self.word("LIMIT", "OFFSET"):
            if self.next()[1].upper() == "LIMIT":
                q.limit = int(self.next()[1])
            else:
                q.offset = int(self.next()[1])

    def group(self) -> Group:
        self.need("{")
        g = Group()
        triples: list = []

        def flush():
            nonlocal triples
            if triples:
                g.parts.append(("bgp", triples))
                triples = []

        if self.word("SELECT"):
            g.parts.append(("sub", self.body()))
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                negated = self.take("NOT")
                if self.take("EXISTS"):
                    g.parts.append(("notexists" if negated else "exists", self.group()))
                elif self.peek()[1] == "(":
                    self.need("(")
                    g.parts.append(("filter", self.expr()))
                    self.need(")")
                else:
                    g.parts.append(("filter", self.primary()))
            elif self.take("OPTIONAL"):
                flush()
                g.parts.append(("optional", self.group()))
            elif self.take("MINUS"):
                flush()
                g.parts.append(("minus", self.group()))
            elif self.take("BIND"):
                flush()
                self.need("(")
                e = self.expr()
                self.need("AS")
                g.parts.append(("bind", self.next()[1][1:], e))
                self.need(")")
            elif self.take("VALUES"):
                flush()
                g.parts.append(self.values())
            elif self.peek()[1] == "{":
                flush()
                branches = [self.group()]
                while self.take("UNION"):
                    branches.append(self.group())
                g.parts.append(("union", branches) if len(branches) > 1 else ("join", branches[0]))
            elif self.peek()[0] == "end":
                raise QueryError("missing }")
            else:
                self.triples(triples)
        flush()
        return g

    def values(self) -> tuple:
        if self.peek()[0] == "var":
            names, rows = [self.next()[1][1:]], []
            self.need("{")
            while not self.take("}"):
                rows.append([None if self.take("UNDEF") else self.term()])
            return ("values", names, rows)
        names, rows = [], []
        self.need("(")
        while not self.take(")"):
            names.append(self.next()[1][1:])
        self.need("{")
        while not self.take("}"):
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(None if self.take("UNDEF") else self.term())
            rows.append(row)
        return ("values", names, rows)

    def triples(self, out: list) -> None:
        s = self.node(out)
        if self.peek()[1] in (".", "}") and s[0] == "var" and s[1].startswith("_b"):
            return
        self.predicates(s, out)

    def predicates(self, s, out: list) -> None:
        while True:
            p = self.path()
            while True:
                self.connect(s, p, self.node(out), out)
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "}", "]"):
                return

    def connect(self, s, p, o, out: list) -> None:
        """A path becomes plain patterns where it can."""
        if p[0] == "inv":
            self.connect(o, p[1], s, out)
        elif p[0] == "seq":
            mid = ("var", f"_b{next(self.fresh)}")
            self.connect(s, p[1], mid, out)
            self.connect(mid, p[2], o, out)
        else:
            out.append((s, p, o))

    def path(self):
        left = self.path_seq()
        while self.peek()[1] == "|":
            self.next()
            right = self.path_seq()
            left = ("alt", left, right)
        return left

    def path_seq(self):
        left = self.path_unit()
        while self.peek()[1] == "/":
            self.next()
            left = ("seq", left, self.path_unit())
        return left

    def path_unit(self):
        if self.take("^"):
            return ("inv", self.path_unit())
        if self.take("("):
            p = self.path()
            self.need(")")
        elif self.peek() == ("word", "a"):
            self.next()
            p = ("iri", T.RDF_TYPE)
        else:
            p = self.term()
        if self.peek()[1] in ("*", "+") and self.peek()[0] == "op":
            p = ("closure", p, self.next()[1])
        return p

    def node(self, out: list):
        if self.take("["):
            b = ("var", f"_b{next(self.fresh)}")
            if not self.take("]"):
                self.predicates(b, out)
                self.need("]")
            return b
        return self.term()

    def iri(self, v: str) -> str:
        if v.startswith("<"):
            v = v[1:-1]
            return v if re.match(r"[A-Za-z][\w+.-]*:", v) else self.base + v
        name, _, local = v.partition(":")
        if name not in self.prefixes:
            raise QueryError(f"unknown prefix {name!r}")
        return self.prefixes[name] + local

    def term(self):
        k, v = self.next()
        if k == "var":
            return ("var", v[1:])
        if k in ("iri", "pname"):
            return ("iri", self.iri(v))
        if k == "bnode":
            return ("var", "_b" + v[2:])
        if k == "str":
            text = _unquote(v)
            if self.peek()[0] == "lang":
                return ("lit", text, T.LANG_STRING, self.next()[1][1:])
            if self.take("^^"):
                return ("lit", text, self.iri(self.next()[1]), "")
            return ("lit", text, T.XSD + "string", "")
        if k == "num":
            dt = "integer" if re.fullmatch(r"[+-]?\d+", v) else "double" if "e" in v.lower() else "decimal"
            return ("lit", v, T.XSD + dt, "")
        if k == "word" and v in ("true", "false"):
            return ("lit", v, T.XSD + "boolean", "")
        raise QueryError(f"unexpected {v!r}")

    # expressions, loosest first
    def expr(self):
        left = self.conj()
        while self.take("||"):
            left = ("or", left, self.conj())
        return left

    def conj(self):
        left = self.comparison()
        while self.take("&&"):
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.additive()
        k, v = self.peek()
        if k == "op" and v in ("=", "!=", "<", ">", "<=", ">="):
            self.next()
            return ("cmp", v, left, self.additive())
        negated = self.word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.next()
        if self.take("IN"):
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.expr())
                self.take(",")
            return ("in", left, items, negated)
        return left

    def additive(self):
        left = self.multiplicative()
        while True:
            k, v = self.peek()
            if k == "op" and v in ("+", "-"):
                self.next()
                left = ("arith", v, left, self.multiplicative())
            elif k == "num" and v[0] in "+-":
                self.next()
                left = ("arith", v[0], left, ("const", ("lit", v[1:], T.XSD + ("integer" if v[1:].isdigit() else "decimal"), "")))
            else:
                return left

    def multiplicative(self):
        left = self.unary()
        while self.peek()[0] == "op" and self.peek()[1] in ("*", "/"):
            left = ("arith", self.next()[1], left, self.unary())
        return left

    def unary(self):
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("arith", "-", ("const", ("lit", "0", T.XSD + "integer", "")), self.unary())
        return self.primary()

    def primary(self):
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        k, v = self.peek()
        if k == "word" and v not in ("true", "false"):
            name = self.next()[1].upper()
            if name in ("NOT", "EXISTS"):
                if name == "NOT":
                    self.need("EXISTS")
                raise QueryError("EXISTS is accepted only as a whole FILTER")
            self.need("(")
            if name in _AGGREGATES:
                distinct = self.take("DISTINCT")
                arg = None if self.take("*") else self.expr()
                sep = " "
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    sep = _unquote(self.next()[1])
                self.need(")")
                return ("agg", name, distinct, arg, sep)
            args = []
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return ("call", name, args)
        if k in ("iri", "pname") and self.peek(1)[1] == "(":  # a cast
            iri = self.iri(self.next()[1])
            self.need("(")
            arg = self.expr()
            self.need(")")
            return ("cast", iri, arg)
        t = self.term()
        return ("var", t[1]) if t[0] == "var" else ("const", t)


def _unquote(v: str) -> str:
    q = 3 if v[:3] in ('"""', "'''") else 1
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), chr(int(m.group(1)[1:], 16)) if m.group(1)[0] in "uU" and len(m.group(1)) > 1 else m.group(1)), v[q:-q], flags=re.S)


# --- compilation ---------------------------------------------------------------------------------------------------------------------------------


@dataclass
class Value:
    """A compiled expression: kind is term, bool, num or str."""

    kind: str
    col: Column

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        dt = {"bool": "boolean", "num": "decimal", "int": "integer", "str": "string"}[self.kind]
        return T.literal(self.col.cast("string"), T.XSD + dt)

    def text(self) -> Column:
        return self.col["value"] if self.kind == "term" else self.col.cast("string")

    def number(self) -> Column:
        if self.kind in ("num", "int"):
            return self.col
        return F.when(self.col["kind"] == "lit", self.col["value"].try_cast("double")) if self.kind == "term" else self.col.try_cast("double")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind in ("num", "int"):
            return self.col != 0
        if self.kind == "str":
            return F.length(self.col) > 0
        v = self.col
        return F.when(v["dt"] == T.XSD + "boolean", v["value"] == "true").when(T.is_numeric(v), v["value"].try_cast("double") != 0).when(v["kind"] == "lit", F.length(v["value"]) > 0)


class Compiler:
    def __init__(self, graph):
        self.graph = graph

    # expressions
    def value(self, e, cols: set[str]) -> Value:
        k = e[0]
        if k == "var":
            return Value("term", F.col(f"`{e[1]}`") if e[1] in cols else F.lit(None).cast(T.TERM))
        if k == "const":
            return Value("term", T.constant(e[1]))
        if k == "col":  # an aggregate computed before
            return Value(e[1], F.col(f"`{e[2]}`"))
        if k in ("or", "and"):
            a, b = self.value(e[1], cols).truth(), self.value(e[2], cols).truth()
            return Value("bool", a | b if k == "or" else a & b)
        if k == "not":
            return Value("bool", ~self.value(e[1], cols).truth())
        if k == "cmp":
            return Value("bool", self.compare(e[1], self.value(e[2], cols), self.value(e[3], cols)))
        if k == "in":
            left = self.value(e[1], cols)
            hit = reduce(lambda x, y: x | y, [self.compare("=", left, self.value(i, cols)) for i in e[2]], F.lit(False))
            return Value("bool", ~hit if e[3] else hit)
        if k == "arith":
            a, b = self.value(e[2], cols).number(), self.value(e[3], cols).number()
            return Value("num", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e[1]]())
        if k == "cast":
            v = self.value(e[2], cols)
            local = e[1].rpartition("#")[2]
            if local in ("integer", "int", "long"):
                return Value("int", v.text().try_cast("double").cast("bigint"))
            if local in ("double", "decimal", "float"):
                return Value("num", v.number())
            if local == "boolean":
                return Value("bool", v.text() == "true")
            if local == "string":
                return Value("str", v.text())
            return Value("term", T.literal(v.text(), e[1]))
        if k == "call":
            return self.call(e[1], e[2], cols)
        raise QueryError(f"an aggregate is not allowed here: {e!r}")

    def compare(self, op: str, a: Value, b: Value) -> Column:
        fs = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
        f = fs[op]
        if a.kind == "term" and b.kind == "term":
            numeric = T.is_numeric(a.col) & T.is_numeric(b.col)
            number = f(a.number(), b.number())
            if op in ("=", "!="):
                same = (a.col["kind"] == b.col["kind"]) & (a.col["value"] == b.col["value"]) & (a.col["dt"] == b.col["dt"]) & (a.col["lang"] == b.col["lang"])
                return F.when(numeric, number).otherwise(same if op == "=" else ~same)
            return F.when(numeric, number).when((a.col["kind"] == "lit") & (b.col["kind"] == "lit") & ~T.is_numeric(a.col) & ~T.is_numeric(b.col), f(a.col["value"], b.col["value"]))
        if "num" in (a.kind, b.kind) or "int" in (a.kind, b.kind):
            return f(a.number(), b.number())
        if "bool" in (a.kind, b.kind):
            return f(a.truth(), b.truth())
        return f(a.text(), b.text())

    def call(self, name: str, args, cols: set[str]) -> Value:
        if name == "BOUND":
            return Value("bool", F.col(f"`{args[0][1]}`").isNotNull() if args[0][1] in cols else F.lit(False))
        vs = [self.value(a, cols) for a in args]
        t = [v.text() for v in vs]
        simple = {
            "STR": lambda: Value("str", t[0]),
            "STRLEN": lambda: Value("int", F.length(t[0])),
            "UCASE": lambda: Value("str", F.upper(t[0])),
            "LCASE": lambda: Value("str", F.lower(t[0])),
            "STRSTARTS": lambda: Value("bool", F.startswith(t[0], t[1])),
            "STRENDS": lambda: Value("bool", F.endswith(t[0], t[1])),
            "CONTAINS": lambda: Value("bool", F.contains(t[0], t[1])),
            "STRBEFORE": lambda: Value("str", F.when(F.contains(t[0], t[1]), F.substring_index(t[0], args[1][1][1], 1)).otherwise("")),
            "STRAFTER": lambda: Value("str", F.when(F.contains(t[0], t[1]), F.substr(t[0], F.instr(t[0], t[1]) + F.length(t[1]))).otherwise("")),
            "SUBSTR": lambda: Value("str", F.substr(t[0], vs[1].number().cast("int"), *( [vs[2].number().cast("int")] if len(vs) > 2 else []))),
            "CONCAT": lambda: Value("str", F.concat(*t)),
            "REPLACE": lambda: Value("str", F.regexp_replace(t[0], t[1], t[2])),
            "REGEX": lambda: Value("bool", F.rlike(t[0], F.concat(F.lit("(?i)"), t[1]) if len(t) > 2 and "i" in args[2][1][1] else t[1])),
            "LANG": lambda: Value("str", vs[0].col["lang"]),
            "DATATYPE": lambda: Value("term", T.iri(vs[0].term()["dt"])),
            "ISIRI": lambda: Value("bool", vs[0].col["kind"] == "iri"),
            "ISURI": lambda: Value("bool", vs[0].col["kind"] == "iri"),
            "ISBLANK": lambda: Value("bool", vs[0].col["kind"] == "bnode"),
            "ISLITERAL": lambda: Value("bool", vs[0].term()["kind"] == "lit"),
            "ISNUMERIC": lambda: Value("bool", T.is_numeric(vs[0].term())),
            "IRI": lambda: Value("term", T.iri(t[0])),
            "URI": lambda: Value("term", T.iri(t[0])),
            "ABS": lambda: Value("num", F.abs(vs[0].number())),
            "ROUND": lambda: Value("num", F.floor(vs[0].number() + 0.5)),
            "CEIL": lambda: Value("num", F.ceil(vs[0].number())),
            "FLOOR": lambda: Value("num", F.floor(vs[0].number())),
            "YEAR": lambda: Value("int", F.year(t[0].try_cast("timestamp"))),
            "MONTH": lambda: Value("int", F.month(t[0].try_cast("timestamp"))),
            "DAY": lambda: Value("int", F.day(t[0].try_cast("timestamp"))),
            "IF": lambda: Value("term", F.when(vs[0].truth(), vs[1].term()).otherwise(vs[2].term())),
            "COALESCE": lambda: Value("term", F.coalesce(*[v.term() for v in vs])),
            "SAMETERM": lambda: Value("bool", vs[0].term() == vs[1].term()),
            "SHA256": lambda: Value("str", F.sha2(t[0], 256)),
        }
        if name not in simple:
            raise QueryError(f"unknown function {name}")
        return simple[name]()

    # patterns
    def group(self, g: Group, df: DataFrame | None = None, conditions=()) -> DataFrame | None:
        """``conditions`` hold for the group's solutions as its own filters do, but are tested by the caller; both let scans read less."""
        filters = [p for p in g.parts if p[0] in ("filter", "exists", "notexists")]
        bounds = [b for e in [*[p[1] for p in filters if p[0] == "filter"], *conditions] for b in bounds_of(e)]
        for p in g.parts:
            k = p[0]
            if k == "bgp":
                df = join(df, self.bgp(p[1], bounds))
            elif k == "join":
                df = join(df, self.group(p[1]))
            elif k == "sub":
                df = join(df, self.select(p[1], terms=True))
            elif k == "union":
                branches = [self.group(b) for b in p[1]]
                df = join(df, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches))
            elif k == "optional":
                inner = p[1]
                conditions = [x[1] for x in inner.parts if x[0] == "filter"]
                right = self.group(Group([x for x in inner.parts if x[0] != "filter"]), conditions=conditions)
                df = self.left(df, right, conditions)
            elif k == "minus":
                right = self.group(p[1])
                shared = [c for c in df.columns if c in right.columns]
                df = df.join(right.select(*_q(shared)).distinct(), shared, "left_anti") if shared else df
            elif k == "bind":
                df = (df if df is not None else self.unit()).withColumn(p[1], self.value(p[2], set(df.columns) if df is not None else set()).term())
            elif k == "values":
                df = join(df, self.values(p[1], p[2]))
        if df is None:
            df = self.unit()
        for p in filters:
            if p[0] == "filter":
                df = df.filter(F.coalesce(self.value(p[1], set(df.columns)).truth(), F.lit(False)))
            else:
                df = self.exists(df, p[1], p[0] == "notexists")
        return df

    def unit(self) -> DataFrame:
        return self.graph.spark.range(1).select(F.lit(True).alias("_unit"))

    def values(self, names, rows) -> DataFrame:
        schema = ", ".join(f"`{n}` {T.TERM}" for n in names)
        return self.graph.spark.createDataFrame([tuple(None if t is None else T.python_term(t) for t in r) for r in rows], schema)

    def left(self, df: DataFrame | None, right: DataFrame, conditions) -> DataFrame:
        if df is None:
            return right
        shared = [c for c in df.columns if c in right.columns]
        r = right.select(*[F.col(f"`{c}`").alias("_r_" + c if c in shared else c) for c in right.columns])
        on = reduce(lambda a, b: a & b, [df[f"`{c}`"] == r[f"`_r_{c}`"] for c in shared], F.lit(True))
        both = set(df.columns) | set(right.columns)
        for e in conditions:
            on = on & F.coalesce(self.value(e, both).truth(), F.lit(False))
        return df.join(r, on, "left").drop(*["_r_" + c for c in shared])

    def exists(self, df: DataFrame, g: Group, negated: bool) -> DataFrame:
        """Semi or anti join on the shared variables; filters of the pattern that use outer variables become part of the condition."""
        conditions = [x[1] for x in g.parts if x[0] == "filter"]
        inner = self.group(Group([x for x in g.parts if x[0] != "filter"]), conditions=conditions)
        shared = [c for c in df.columns if c in inner.columns]
        r = inner.select(*[F.col(f"`{c}`").alias("_r_" + c if c in shared else c) for c in inner.columns])
        on = reduce(lambda a, b: a & b, [df[f"`{c}`"] == r[f"`_r_{c}`"] for c in shared], F.lit(True))
        for e in conditions:
            on = on & F.coalesce(self.value(e, set(df.columns) | set(inner.columns)).truth(), F.lit(False))
        return df.join(r, on, "left_anti" if negated else "left_semi")

    def bgp(self, triples, bounds=()) -> DataFrame:
        """Stars by subject, joined in an order in which each shares a variable with what came before where possible."""
        stars: dict = {}
        singles = []
        for s, p, o in triples:
            if p[0] == "iri":
                stars.setdefault(s, []).append((p[1], o))
            else:
                singles.append((s, p, o))
        raw = getattr(self.graph, "basic", None)
        whole = raw(list(stars.items()), bounds) if raw and stars else None
        frames = ([whole] if whole is not None else [self.graph.star(s, pos, bounds) for s, pos in stars.items()]) + [self.pattern(*t) for t in singles]
        df, rest = frames[0], frames[1:]
        while rest:
            k = next((i for i, f in enumerate(rest) if set(f.columns) & set(df.columns)), 0)
            df = join(df, rest.pop(k))
        return df

    def pattern(self, s, p, o) -> DataFrame:
        if p[0] == "var":
            return self.graph.triples(s, p, o)
        if p[0] == "alt":
            parts = []
            for x in p[1:]:
                out: list = []
                Parser("", {}).connect(s, x, o, out)
                parts.append(self.bgp(out))
            return reduce(lambda a, b: a.unionByName(b), parts)
        if p[0] == "closure":
            if p[1][0] != "iri":
                raise QueryError("+ and * are accepted after one predicate")
            return self.graph.closure(s, p[1][1], o, p[2] == "*")
        raise QueryError(f"unknown path {p!r}")

    # query forms
    def select(self, q: Query, terms: bool = False) -> DataFrame:
        df = self.group(q.where)
        aggregated = bool(q.group) or any(e is not None and _has_aggregate(e) for _, e in q.select) or bool(q.having)
        computed: dict[str, Value] = {}
        if aggregated:
            df, q, computed = self.aggregate(df, q)
        cols = set(df.columns)
        names = [n for n, _ in q.select] or [c for c in df.columns if not c.startswith("_")]
        given = dict(q.select)
        for n in names:
            if given.get(n) is not None:
                computed[n] = self.value(given[n], cols)
        hidden = []
        if q.order:
            keys = []
            for i, (e, down) in enumerate(q.order):
                v = computed[e[1]] if e[0] == "var" and e[1] in computed else self.value(e, cols)
                for j, key in enumerate(sort_keys(v)):
                    name = f"_o{i}_{j}"
                    hidden.append(key.alias(name))
                    keys.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first())
        out = [(computed[n].term() if terms else plain(computed[n])).alias(n) if n in computed else (F.col(f"`{n}`") if terms else plain(Value("term", F.col(f"`{n}`") if n in cols else F.lit(None).cast(T.TERM)))).alias(n) for n in names]
        df = df.select(*out, *hidden)
        if q.distinct:
            if hidden:
                df = df.dropDuplicates(names)
            else:
                df = df.distinct()
        if q.order:
            df = df.orderBy(*keys).drop(*[f"_o{i}_{j}" for i in range(len(q.order)) for j in range(2)])
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df

    def aggregate(self, df: DataFrame, q: Query):
        cols = set(df.columns)
        keys = []
        for name, e in q.group:
            keys.append((self.value(e, cols).term() if e is not None else F.col(f"`{name}`") if name in cols else F.lit(None).cast(T.TERM)).alias(name))
        aggs: list[Column] = []
        inputs: dict[str, Column] = {}

        def pull(e):
            if not isinstance(e, tuple):
                return [pull(x) for x in e] if isinstance(e, list) else e
            if e and e[0] == "agg":
                name = f"_a{len(aggs)}"
                col, kind = self.aggregate_of(e, cols, inputs)
                aggs.append(col.alias(name))
                return ("col", kind, name)
            return tuple(pull(x) if isinstance(x, (tuple, list)) else x for x in e)

        select = [(n, pull(e) if e is not None else None) for n, e in q.select]
        having = [pull(e) for e in q.having]
        order = [(pull(e), d) for e, d in q.order]
        if inputs:  # computed once, below the aggregation
            df = df.withColumns(inputs)
        out = df.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_n")]))
        for e in having:
            out = out.filter(F.coalesce(self.value(e, set(out.columns)).truth(), F.lit(False)))
        return out, Query("SELECT", select or [(n, None) for n, _ in q.group], q.distinct, q.where, order=order, limit=q.limit, offset=q.offset), {}

    def aggregate_of(self, e, cols, inputs: dict[str, Column]) -> tuple[Column, str]:
        _, name, distinct, arg, sep = e

        def given(c: Column) -> Column:
            inputs[f"_i{len(inputs)}"] = c
            return F.col(f"_i{len(inputs) - 1}")

        if name == "COUNT":
            if arg is None:
                return (F.count_distinct(*[F.col(f"`{c}`") for c in sorted(cols)]) if distinct else F.count("*")), "int"
            t = given(self.value(arg, cols).term())
            return (F.count_distinct(t) if distinct else F.count(t)), "int"
        v = self.value(arg, cols)
        if name in ("SUM", "AVG"):
            n = given(v.number())
            f = {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg}[name]
            return F.coalesce(f(n), F.lit(0.0)), "num"
        if name in ("MIN", "MAX"):
            t = v.term()
            keyed = given(F.when(t.isNotNull(), F.struct(v.number().alias("n"), t["value"].alias("v"))))
            return (F.min_by if name == "MIN" else F.max_by)(given(t), keyed), "term"
        if name == "SAMPLE":
            return F.min(given(v.term())), "term"
        text = given(v.text())
        texts = F.array_sort(F.collect_set(text) if distinct else F.collect_list(text))
        return F.array_join(texts, sep), "str"

    def construct(self, q: Query) -> DataFrame:
        df = self.group(q.where)
        cols = set(df.columns)

        def slot(t):
            return F.col(f"`{t[1]}`") if t[0] == "var" and t[1] in cols else T.bnode(F.concat(F.lit(t[1]), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(cols)])), 256))) if t[0] == "var" else T.constant(t)

        rows = F.array(*[F.struct(slot(s).alias("s"), slot(p)["value"].alias("p"), slot(o).alias("o")) for s, p, o in q.template])
        out = df.select(F.explode(rows).alias("t")).select("t.s", "t.p", "t.o")
        return out.filter(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("s.kind") != "lit")).distinct()


def bounds_of(e) -> list[tuple[str, str, object]]:
    """(variable, operator, value) of the comparisons of a variable with a number, or equality with a text, that a filter demands in any case."""
    if e[0] == "and":
        return bounds_of(e[1]) + bounds_of(e[2])
    if e[0] != "cmp" or e[1] == "!=":
        return []
    op, a, b = e[1:]
    if a[0] == "const" and b[0] == "var":
        a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
    if a[0] != "var" or b[0] != "const" or b[1][0] != "lit":
        return []
    text, dt = b[1][1], b[1][2]
    if dt in T.NUMERIC:
        return [(a[1], op, int(text) if re.fullmatch(r"[+-]?\d{1,15}", text) else float(text))]
    return [(a[1], op, text)] if op == "=" and dt == T.XSD + "string" else []


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("agg",) or any(_has_aggregate(x) for x in e)) or isinstance(e, list) and any(_has_aggregate(x) for x in e)


def _q(names) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def join(a: DataFrame | None, b: DataFrame) -> DataFrame:
    if a is None:
        return b
    shared = [c for c in a.columns if c in b.columns]
    if shared:
        return a.join(b, shared)
    if "_unit" in a.columns or "_unit" in b.columns:
        return a.crossJoin(b)
    raise QueryError("patterns without a common variable are not joined: they would pair all solutions")


def plain(v: Value) -> Column:
    """Result column: the lexical value of a term, or the number, text or truth computed."""
    return v.col["value"] if v.kind == "term" else v.col


def sort_keys(v: Value) -> list[Column]:
    if v.kind == "term":
        return [v.number(), v.col["value"]]
    return [v.col]


def run(graph, text: str, prefixes: dict[str, str] | None = None, terms: bool = False):
    """SELECT gives a DataFrame of plain values (or terms), ASK a truth value, CONSTRUCT and DESCRIBE statements (s, p, o)."""
    q = Parser(text, {**T.PREFIXES, **(prefixes or {})}).query()
    c = Compiler(graph)
    if q.form == "SELECT":
        return c.select(q, terms)
    if q.form == "ASK":
        return bool(c.group(q.where).limit(1).count())
    if q.form == "CONSTRUCT":
        return c.construct(q)
    ids = [T.constant(t)["value"] for t in q.describe if t[0] != "var"]
    out = None
    for t in q.describe:
        if t[0] == "var":
            subjects = c.group(q.where).select(F.col(f"`{t[1]}`.value").alias("s")).distinct()
        else:
            subjects = graph.spark.range(1).select(F.lit(t[1]).alias("s"))
        d = graph.describe(subjects)
        out = d if out is None else out.unionByName(d)
    if out is None or not (ids or q.where.parts):
        raise QueryError("DESCRIBE needs a resource")
    return out.distinct()
