"""Generated, minified or vendored source files and data in the guise of code.

Each file is lexed and re-emitted in canonical form, one statement a line; the original layout is held against that:

* minified: the canonical form has far more lines than the original, or its lines are far longer than people write;
* data: literals that are no documentation dominate what is not comment or documentation;
* generated: nearly all canonical lines share a few token shapes;
* vendored: the canonical form without comments stands in another project as that project's own, or the file declares itself part of another
  project: its module's namespace is neither like the name of the project it lies in nor that of a good part of the project's files.

No wording and no folder name decides: what a comment claims is neither needed nor believed, so files that people maintain are no cases whatever
their path or wording, and the original of a copied file is none.  Null and empty contents are no cases.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .syntax import language_of, normal
from .common import analyse, current, source_files

_LINE_COMMENT = {"elixir": r"\#[^\n]*", "python": r"\#[^\n]*", "erlang": r"%[^\n]*", "javascript": r"//[^\n]*|/\*.*?(?:\*/|\Z)"}
_STRINGS = {
    "elixir": r'~[a-zA-Z]?"""(?:.*?)"""|~[a-zA-Z]?\'\'\'(?:.*?)\'\'\'|"""(?:.*?)"""|\'\'\'(?:.*?)\'\'\'|"(?:[^"\\]|\\.)*"|~[a-zA-Z](?:\((?:[^)\\]|\\.)*\)|/(?:[^/\\\n]|\\.)*/|\[[^\]\n]*\]|\{[^}\n]*\})|\?(?:\\.|[^\s\\])',
    "python": r'[A-Za-z]{0,2}(?:"""(?:.*?)"""|\'\'\'(?:.*?)\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')',
    "erlang": r'"(?:[^"\\]|\\.)*"|\$(?:\\.|[^\s\\])',
    "javascript": r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`',
}
_LEX = {k: re.compile(rf"(?P<com>{_LINE_COMMENT[k]})|(?P<str>{_STRINGS[k]})|(?P<num>\b0[xX][0-9a-fA-F_]+|\b\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*[?!]?)|(?P<nl>\n)|(?P<op>[^\w\s])", re.S) for k in _STRINGS}

#: Bounds of the layout test: canonical lines for each line, characters a line, shares of literals and of the two commonest shapes, and how many lines
#: and tokens a layout needs to be one.  A file that is little but one literal has few tokens; for it the last two count.
EXPANSION, LONG_LINE, LITERAL_SHARE, SHAPE_SHARE, MIN_LINES, MIN_TOKENS, BLOB_SHARE, BLOB_CHARS = 3.0, 300, 0.6, 0.8, 12, 60, 0.85, 400
#: Share of a project's files from which on a namespace is the project's own.
OWN_SHARE = 1 / 3


def layout(lang: str, text: str) -> dict:
    """Measures of a file's layout against its canonical form, and the hash of that form without comments and documentation (None without code)."""
    lines: list[list[str]] = [[]]
    depth = lit = code = n = comment_chars = breaks = on_line = 0
    doc_next = False
    bare = hashlib.md5()
    for m in _LEX[lang].finditer(text):
        k, v = m.lastgroup, m.group()
        if k == "com":
            comment_chars += len(v)
            continue
        if k == "nl":
            breaks += on_line > 0
            on_line = 0
            if lines[-1] and (depth == 0 or len(lines[-1]) > 2):
                lines.append([])
            continue
        if k == "str":
            # documentation: what follows a documenting attribute, or stands alone as a Python statement
            if doc_next or lang == "python" and not lines[-1]:
                doc_next = False
                on_line += 1
                continue
            lit += len(v)
            code += len(v)
            lines[-1].append("L")
        elif k == "num":
            lit += len(v)
            code += len(v)
            lines[-1].append("L")
        else:
            code += len(v)
            if k == "word":
                lines[-1].append(v if v in _SHAPE_WORDS else "w")
            else:
                lines[-1].append(v)
                if v in "([{":
                    depth += 1
                elif v in ")]}":
                    depth = max(0, depth - 1)
        doc_next = lang == "elixir" and (k == "word" and v in ("moduledoc", "doc", "typedoc") or doc_next and v == "(")
        bare.update(v.encode("utf-8", "surrogatepass") + b"\0")
        n += 1
        on_line += 1
        if _ends_statement(lang, v, depth):
            breaks += 1
            on_line = 0
            if lang == "javascript":
                lines.append([])
    breaks += on_line > 0
    canon = [x for x in lines if x]
    body = [x for x in text.split("\n") if x.strip()]
    shapes = Counter(" ".join(_squeeze(x)) for x in canon if len(x) > 2)
    total = sum(shapes.values())
    top = sum(c for _, c in shapes.most_common(2))
    return {
        "expansion": (len(canon) if lang == "javascript" else breaks) / max(1, len(body) - (comment_chars > 0)),
        "mean": (len(text) - comment_chars) / max(1, len(body)),
        "literal": lit / code if code else 0.0,
        "code": code,
        "uniform": top / total if total else 0.0,
        "lines": total,
        "tokens": n,
        "hash": bare.hexdigest() if n else None,
    }


def _ends_statement(lang: str, v: str, depth: int) -> bool:
    """Whether the canonical form breaks the line after a token."""
    if lang == "javascript":
        return v in (";", "{", "}")
    if lang == "erlang":
        return v == ";" or depth == 0 and v in (",", ".")
    if lang == "python":
        return v == ";"
    return v in (";", "do")


_SHAPE_WORDS = frozenset("def defp do end fn case when if for with function return const let var export import class raise try receive".split())


def _squeeze(shape: list[str]) -> list[str]:
    """A line's token shape with runs of list elements as one."""
    out: list[str] = []
    for t in shape:
        if len(out) >= 3 and t == out[-2] and out[-1] == out[-3] and out[-1] == ",":
            out.pop()
            continue
        out.append(t)
    return out


def namespace(lang: str, text: str) -> str | None:
    """First part of the module's name, in lower case, for languages whose modules carry one."""
    if lang == "elixir":
        m = re.search(r"^\s*defmodule\s+([A-Z]\w*)", text, re.M)
    elif lang == "erlang":
        m = re.search(r"^-module\(\s*'?([a-z]\w*?)(?:_\w*)?'?\s*\)", text, re.M)
    else:
        return None
    return m.group(1).lower().replace("_", "") if m else None


def kind_of(path: str | None, content: str | None) -> tuple | None:
    """(kind by layout, namespace, hash of the canonical form, tokens); kind null: not told by the file alone."""
    lang = language_of(path)
    if lang is None or lang == "json":
        return None
    text = normal(content)
    x = layout(lang, text)
    kind = None
    enough = x["tokens"] >= MIN_TOKENS
    if enough and (x["expansion"] >= EXPANSION or x["mean"] >= LONG_LINE and x["literal"] < LITERAL_SHARE):
        kind = "minified"
    elif enough and x["literal"] >= LITERAL_SHARE or x["literal"] >= BLOB_SHARE and x["code"] >= BLOB_CHARS:
        kind = "data"
    elif x["lines"] >= MIN_LINES and x["uniform"] >= SHAPE_SHARE:
        kind = "generated"
    return kind, namespace(lang, text), x["hash"], x["tokens"]


def classify_files(files: DataFrame) -> DataFrame:
    """(file_id, kind) with kind = minified, data, generated or vendored, of the current state of each code file that is one of them.

    Projects and namespaces come from narrow rows by aggregations with partial results.  Of equal forms without a namespace the earliest state is the
    original, of equal times the least project; forms of fewer than ``MIN_TOKENS`` tokens may be equal by chance and need a namespace.
    """
    rows = analyse(files, kind_of, "struct<kind string, ns string, hash string, tokens int>", keep="package string, path string")
    c = current(rows, "package", "path", "result").select("file_id", "mtime", "package", "path", "result.*")
    app = F.regexp_extract(F.col("path"), r"^(?:apps|packages|libs|services)/([^/]+)/", 1)
    c = stored(c.withColumn("unit", F.regexp_replace(F.lower(F.coalesce(F.when(app != "", app), F.col("package"), F.lit(""))), "_", "")).drop("path", "package"), "origin")
    # the namespaces that are a project's own: like its name, or those of a good part of its files
    held = c.filter("ns is not null").groupBy("unit", "ns").agg(F.count("*").alias("n"))
    whole = held.groupBy("unit").agg(F.sum("n").alias("whole"))
    alike = F.startswith("ns", F.col("unit")) | F.startswith("unit", F.col("ns"))
    own = held.join(whole, "unit").filter(alike & (F.col("unit") != "") | (F.col("n") >= F.col("whole") * OWN_SHARE) & (F.col("n") > 1)).select("unit", "ns", F.lit(True).alias("own"))
    j = c.join(own, ["unit", "ns"], "left")
    foreign = F.col("ns").isNotNull() & F.col("own").isNull()
    # the first project of each form without a namespace, where more than one holds it
    plain = c.filter(F.col("ns").isNull() & (F.col("tokens") >= MIN_TOKENS))
    first = plain.groupBy("hash").agg(F.min(F.struct("mtime", "unit")).alias("o"), F.min("unit").alias("a"), F.max("unit").alias("b")).filter("a <> b").select("hash", F.col("o.unit").alias("original"))
    copies = plain.join(first, "hash").filter(F.col("unit") != F.col("original")).select("file_id", F.coalesce("kind", F.lit("vendored")).alias("kind"))
    told = j.withColumn("kind", F.coalesce("kind", F.when(foreign, "vendored"))).filter("kind is not null").select("file_id", "kind")
    return told.unionByName(copies).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return classify_files(source_files(spark, folder)).select("file_id")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The files with the kind found."""
    return classify_files(source_files(spark, folder))
