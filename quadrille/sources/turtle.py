"""Turtle and N-Triples: readers and writers.

N-Triples is line-based and is read and written by Spark expressions alone.  A Turtle document is read whole by one task (its prefixes and blank
nodes span it); many documents are spread over the tasks, with an error row for each that does not parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .rdf_json_xml import FormatError, from_json_ld, from_rdf_xml

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<prefix>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)"""
    r"""|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))(?![\w:])|(?P<bool>true|false)(?![\w:.-])|(?P<bnode>_:[\w](?:[\w.-]*[\w-])?)|(?P<a>a)(?=[\s<\[])|(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)|(?P<op>[.;,\[\]()])""",
    re.X | re.S,
)


class TurtleError(ValueError):
    def __init__(self, message: str, line: int):
        super().__init__(f"{message} (line {line})")
        self.message, self.line = message, line


def _unescape(v: str) -> str:
    q = 3 if v[:3] in ('"""', "'''") else 1
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m.group(1)[1:], 16)) if len(m.group(1)) > 1 else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m.group(1), m.group(1)), v[q:-q], flags=re.S)


def parse(text: str, doc: str = "") -> list[tuple]:
    """Statements (s, p, o) of terms ("iri", v), ("bnode", v) and ("lit", v, datatype, language).  Blank node labels get the document's name."""
    toks: list[tuple[str, str, int]] = []
    pos, line = 0, 1
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise TurtleError(f"unexpected {text[pos:pos + 20]!r}", line)
        if m.lastgroup != "ws":
            toks.append((m.lastgroup, m.group(), line))
        line += m.group().count("\n")
        pos = m.end()
    toks.append(("end", "", line))
    prefixes: dict[str, str] = {}
    base = ""
    out: list[tuple] = []
    state = {"i": 0, "b": 0}

    def peek():
        return toks[state["i"]]

    def take():
        t = toks[state["i"]]
        state["i"] += 1
        return t

    def need(op: str):
        k, v, n = take()
        if v != op:
            raise TurtleError(f"expected {op} before {v!r}", n)

    def fresh():
        state["b"] += 1
        return ("bnode", f"{doc}b{state['b']}")

    def resolve(v: str) -> str:
        return v if re.match(r"[A-Za-z][\w+.-]*:", v) else base + v

    def term():
        k, v, n = take()
        if k == "iri":
            return ("iri", resolve(v[1:-1]))
        if k == "pname":
            name, _, local = v.partition(":")
            if name not in prefixes:
                raise TurtleError(f"unknown prefix {name!r}", n)
            return ("iri", prefixes[name] + re.sub(r"\\(.)", r"\1", local))
        if k == "a":
            return ("iri", T.RDF_TYPE)
        if k == "bnode":
            return ("bnode", doc + v[2:])
        if k == "bool":
            return ("lit", v, T.XSD + "boolean", "")
        if k == "num":
            return ("lit", v, T.XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), "")
        if k == "str":
            s = _unescape(v)
            if peek()[0] == "lang":
                return ("lit", s, T.LANG_STRING, take()[1][1:].lower())
            if peek()[0] == "dt":
                take()
                return ("lit", s, term()[1], "")
            return ("lit", s, T.XSD + "string", "")
        if v == "[":
            b = fresh()
            if peek()[1] != "]":
                properties(b)
            need("]")
            return b
        if v == "(":
            items = []
            while peek()[1] != ")":
                if peek()[0] == "end":
                    raise TurtleError("missing )", n)
                items.append(term())
            take()
            node = ("iri", T.RDF + "nil")
            for x in reversed(items):
                cell = fresh()
                out.append((cell, ("iri", T.RDF + "first"), x))
                out.append((cell, ("iri", T.RDF + "rest"), node))
                node = cell
            return node
        raise TurtleError(f"unexpected {v!r}", n)

    def properties(s):
        while True:
            p = term()
            if p[0] != "iri":
                raise TurtleError("a predicate must be an IRI", peek()[2])
            while True:
                out.append((s, p, term()))
                if peek()[1] != ",":
                    break
                take()
            if peek()[1] != ";":
                return
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]") or peek()[0] == "end":
                return

    while peek()[0] != "end":
        k, v, n = peek()
        if k == "prefix":
            take()
            if v.lstrip("@").lower() == "prefix":
                name = take()[1]
                prefixes[name[:-1]] = resolve(take()[1][1:-1])
            else:
                base = resolve(take()[1][1:-1])
            if v[0] == "@":
                need(".")
            continue
        bracket = v == "["
        s = term()
        if s[0] == "lit":
            raise TurtleError("a subject must not be a literal", n)
        if not (bracket and peek()[1] == "."):
            properties(s)
        need(".")
    return out


def parse_any(path: str, text: str) -> list[tuple]:
    """Statements of a document in the form that its ending names; Turtle, which covers N-Triples, without a known ending."""
    end = path.lower().rpartition(".")[2]
    if end in ("jsonld", "json"):
        return from_json_ld(text, f"{path}#")
    if end in ("rdf", "owl", "xml"):
        return from_rdf_xml(text, f"{path}#")
    return parse(text, f"{path}#")


def to_rows(statements: list[tuple], graph: str = "") -> list[tuple]:
    return [(graph, T.python_term(s), p[1], T.python_term(o)) for s, p, o in statements]


QUADS = f"g string, s {T.TERM}, p string, o {T.TERM}"


def from_text(spark: SparkSession, text: str, graph: str = "") -> DataFrame:
    return spark.createDataFrame(to_rows(parse(text), graph), QUADS)


def read_documents(docs: DataFrame, name: str = "path", text: str = "content") -> DataFrame:
    """(name, error, line, statements) of each document; a document that does not parse has an error and no statements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, t in zip(b["name"], b["text"]):
                try:
                    rows.append((n, None, None, [{"s": dict(zip(("kind", "value", "dt", "lang"), T.python_term(s))), "p": p[1], "o": dict(zip(("kind", "value", "dt", "lang"), T.python_term(o)))} for s, p, o in parse_any(str(n), t or "")]))
                except TurtleError as e:
                    rows.append((n, e.message, e.line, []))
                except FormatError as e:
                    rows.append((n, str(e), None, []))
            yield pd.DataFrame(rows, columns=["name", "error", "line", "statements"]).astype({"line": "Int32"})

    return docs.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInPandas(run, f"name string, error string, line int, statements array<struct<s: {T.TERM}, p: string, o: {T.TERM}>>")


def load_files(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Statements of files in Turtle, N-Triples, JSON-LD or RDF/XML by their endings, and one row per file (path, error, statements).  Globs that match nothing give empty tables."""
    docs = spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    parsed = read_documents(docs)
    quads = parsed.select(F.col("name").alias("g"), F.explode("statements").alias("t")).select("g", "t.s", "t.p", "t.o")
    return quads, parsed.select(F.col("name").alias("path"), "error", F.size("statements").alias("statements"))


_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$'


def _nt_unescape(c):
    """Escapes resolved in one pass from left to right, so that an escaped backslash begins no further escape."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)
    short = F.create_map(*[F.lit(x) for kv in {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\b": "\b", "\\f": "\f", '\\"': '"', "\\'": "'", "\\\\": "\\"}.items() for x in kv])

    def one(t):
        point = F.decode(F.unhex(F.lpad(F.substr(t, F.lit(3)), 8, "0")), "UTF-32")
        return F.when(F.rlike(t, F.lit(r"^\\[uU][0-9A-Fa-f]{4}")), point).otherwise(F.coalesce(F.try_element_at(short, t), t))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def _nt_term(c):
    lit = F.regexp_extract(c, r'(?s)^"(.*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)
    dt, lang = F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1)
    return F.when(F.startswith(c, F.lit("<")), T.iri(F.regexp_extract(c, r"^<(.*)>$", 1))).when(F.startswith(c, F.lit("_:")), T.bnode(F.regexp_extract(c, r"^_:(.*)$", 1))).otherwise(
        T.literal(_nt_unescape(lit), F.when(dt != "", dt).when(lang != "", T.LANG_STRING).otherwise(T.XSD + "string"), F.lower(lang))
    )


def read_ntriples(spark: SparkSession, *paths: str) -> DataFrame:
    """Quads of N-Triples and N-Quads files; lines of another form are left out (see ``bad_lines``)."""
    lines = spark.read.text(list(paths)).filter(F.col("value").rlike(_NT))
    part = lambda i: F.regexp_extract("value", _NT, i)
    return lines.select(part(4).alias("g"), _nt_term(part(1)).alias("s"), part(2).alias("p"), _nt_term(part(3)).alias("o"))


def bad_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths)).filter(~F.col("value").rlike(_NT) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def nt_text(term):
    """N-Triples form of a term column."""
    e = term["value"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        e = F.replace(e, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), e, F.lit('"'))
    return F.when(term["kind"] == "iri", F.concat(F.lit("<"), term["value"], F.lit(">"))).when(term["kind"] == "bnode", F.concat(F.lit("_:"), F.regexp_replace(term["value"], r"[^\w]", "_"))).when(term["lang"] != "", F.concat(quoted, F.lit("@"), term["lang"])).when(term["dt"] == T.XSD + "string", quoted).otherwise(
        F.concat(quoted, F.lit("^^<"), term["dt"], F.lit(">"))
    )


def ntriples(quads: DataFrame) -> DataFrame:
    """One column ``value`` with a line per statement."""
    return quads.select(F.concat(nt_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), nt_text(F.col("o")), F.lit(" .")).alias("value"))


def write_ntriples(quads: DataFrame, path: str) -> None:
    ntriples(quads).write.mode("overwrite").text(path)


def turtle_blocks(quads: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One column ``value`` with a block per subject; statements of a subject come together by one shuffle, in order of predicate and object."""
    p = F.concat(F.lit("<"), F.col("p"), F.lit(">"))
    o = nt_text(F.col("o"))
    for name, iri in (prefixes or {}).items():
        short = lambda c, iri=iri, name=name: F.regexp_replace(c, "^<" + re.escape(iri).replace("/", "/") + r"([A-Za-z_][\w-]*)>$", f"{name}:$1")
        p, o = short(p), short(o)
    pairs = F.array_sort(F.collect_set(F.concat(F.lit("    "), F.when(F.col("p") == T.RDF_TYPE, F.lit("a")).otherwise(p), F.lit(" "), o)))
    return quads.groupBy(nt_text(F.col("s")).alias("s")).agg(F.array_join(pairs, " ;\n").alias("b")).select(F.concat("s", F.lit("\n"), "b", F.lit(" .")).alias("value"))


def write_turtle(quads: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Turtle text files, each complete with its prefixes."""
    head = "".join(f"@prefix {n}: <{i}> .\n" for n, i in (prefixes or {}).items())

    def with_head(batches):
        first = True
        for b in batches:
            if first and len(b):
                b = b.copy()
                b.iloc[0, 0] = head + b.iloc[0, 0]
                first = False
            yield b

    turtle_blocks(quads, prefixes).mapInPandas(with_head, "value string").write.mode("overwrite").text(path)


def write_store(quads: DataFrame, path: str) -> None:
    """Columnar store, partitioned by predicate so that a pattern reads only its predicate's files."""
    quads.withColumn("pred", F.regexp_replace("p", r"[^\w]", "_")).write.mode("overwrite").partitionBy("pred").parquet(path)
