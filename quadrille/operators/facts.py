"""Code facts: syntax trees as an interval table, facts as queries over it, and facts as graph statements.

``ast_nodes`` parses each file where its row is read and gives one row per node with its pre- and post-order numbers; a is an ancestor of b exactly
if a.pre < b.pre and a.post > b.post.  Each node carries its enclosing module and function, so most facts are a filter and a projection.
Files that do not parse give a row of ``parse_errors`` and no nodes.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import terms as T
from ..session import spread
from ..syntax import elixir, normal, tables
from ..syntax.lalr import Machine, SyntaxFault

NODE = "file_id bigint, pre int, post int, parent int, depth int, nth int, kind string, name string, text string, arity int, defaults int, has_do boolean, line int, module string, fun string, fun_arity int, free array<string>"
_LEAF = {"ID": "var", "PID": "call_name", "NP": "call_name", "NP_DO": "call_name", "P_DO": "call_name", "ID_DO": "call_name", "ALIAS": "alias", "ATOM": "atom", "INT": "integer", "FLOAT": "float", "CHAR": "integer", "STR": "string", "CHARS": "charlist", "SIGIL": "sigil", "LIT": "atom", "INT_CAP": "placeholder", "KW": "key", "BLOCK": "section"}
DEFINERS = ("def", "defp", "defmacro", "defmacrop", "defguard", "defguardp", "defdelegate")
MODULES = ("defmodule", "defprotocol", "defimpl")
CONTROL = ("if", "unless", "cond", "case", "with", "receive", "for")
SPECIAL = (*DEFINERS, *MODULES, *CONTROL, "alias", "import", "require", "use", "quote", "unquote", "unquote_splicing", "try", "raise", "reraise", "throw", "exit", "super", "fn", "defstruct", "defexception", "defoverridable", "@")


#: Calls whose text facts look into; of others only the name is kept, so that nested calls do not repeat each other's text.
_TEXTS = frozenset(["alias", "import", "require", "use", "defstruct", "defexception", "defimpl", "defprotocol", "Supervisor.init", "Supervisor.start_link", "DynamicSupervisor.init", "DynamicSupervisor.start_link", ":ets.new"])


class Leaf(str):
    """Text of a token with its terminal and line."""

    __slots__ = ("kind", "line")


def parse_tree(text: str):
    """The syntax tree of a text; texts within texts are lexed by recursion, for which the interpreter's limit is raised where one nests beyond it."""
    try:
        lexed = elixir.lex(text)
    except RecursionError:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(limit + 4 * len(text))
        try:
            lexed = elixir.lex(text)
        finally:
            sys.setrecursionlimit(limit)
    m = Machine(tables("elixir"))
    line = 1
    for t in lexed.tokens:
        leaf = Leaf(t[1] if t[1] is not None else "")
        leaf.kind, leaf.line = t[0], t[2]
        line = t[2]
        m.feed(t[0], leaf, line)
    return m.end(line)


def _text(x) -> str:
    """Text of a node; members of a list are parted by commas."""
    out, todo = [], [x]
    while todo:
        y = todo.pop()
        if isinstance(y, str):
            out.append(str(y))
        elif isinstance(y, list):
            todo.extend(z for i, k in reversed(list(enumerate(y))) for z in ((k, ", ") if i else (k,)))
        elif isinstance(y, tuple):
            todo.extend(reversed(y[1]))
    return "".join(out)


def _line(x) -> int | None:
    todo = [x]
    while todo:
        y = todo.pop(0)
        if isinstance(y, Leaf):
            return y.line
        if isinstance(y, tuple):
            todo = list(y[1]) + todo
        elif isinstance(y, list):
            todo = y + todo
    return None


def _name_arity(x) -> tuple[str, list, object] | None:
    """Name, arguments and node of a definition's head."""
    while isinstance(x, tuple) and x[0] == "bin" and x[1][1] == "when":
        x = x[1][0]
    if isinstance(x, str):
        return str(x), [], x
    if isinstance(x, tuple) and x[0] == "call":
        return str(x[1][0]), next((k for k in x[1][1:] if isinstance(k, list)), []), x
    if isinstance(x, tuple) and x[0] == "bin":
        return str(x[1][1]), [x[1][0], x[1][2]], x
    return None


def nodes_of(file_id: int, text: str) -> list[tuple]:
    """Rows of NODE for one file; raises SyntaxFault.

    ``free`` of an anonymous function holds the variables that it uses and does not bind, as often as it uses them.  Arguments, left sides of ``=`` and
    ``<-`` and the heads of clauses bind, anywhere in the function; pinned variables, guards, defaults and sizes use.  What an inner function leaves
    free, the outer one uses.
    """
    tree = parse_tree(text)
    rows: list[list] = []
    heads: set[int] = set()
    named: set[int] = set()  # functions that a capture names
    pre = post = 0
    # (node, parent, depth, nth, module, fun, arity, scope, binds) or a row to close with its scope: (bound, used, outer scope)
    stack: list = [((x, -1, 0, i, None, None, None, None, False)) for i, x in reversed(list(enumerate(tree or [])))]
    while stack:
        item = stack.pop()
        if len(item) == 2:
            row, scope = item
            row[2] = post
            post += 1
            if scope:
                row[-1] = sorted(v for v in scope[1] if v not in scope[0])
                if scope[2]:
                    scope[2][1].extend(row[-1])
            continue
        x, parent, depth, nth, module, fun, arity, scope, binds = item
        sides = None  # whether each child stands where it binds
        kind, name, n, defaults, has_do, kids = "leaf", None, None, None, False, []
        mod2, fun2, ar2 = module, fun, arity
        if isinstance(x, Leaf):
            kind, name = _LEAF.get(x.kind, "token"), str(x)
            if kind == "token":
                continue
            if kind == "var" and scope and name != "_":
                scope[0].add(name) if binds else scope[1].append(name)
        elif isinstance(x, list):
            for i, k in reversed(list(enumerate(x))):
                stack.append((k, parent, depth, i, module, fun, arity, scope, binds))
            continue
        elif isinstance(x, tuple):
            label, kids = x[0], x[1]
            args = next((k for k in kids[1:] if isinstance(k, list)), [])
            if label in ("call", "call_do"):
                has_do = label == "call_do"
                kind, name, n = "call", str(kids[0]) if isinstance(kids[0], str) else _text(kids[0]), len(args) + has_do
                if "." in name[1:] and name[:1] != ".":
                    kind = "remote_call"
                if name in MODULES and args:
                    own = _text(args[0])
                    target = re.search(r"\bfor:\s*([A-Z]\w*(?:\.[A-Z]\w*)*)", _text(args[1:])) if name == "defimpl" else None
                    mod2 = f"{own}.{target.group(1)}" if target else f"{module}.{own}" if module and name != "defimpl" else own
                    fun2 = ar2 = None
                elif name in DEFINERS and args:
                    h = _name_arity(args[0])
                    if h:
                        fun2, ar2 = h[0], len(h[1])
                        heads.add(id(h[2]))
                        defaults = sum(isinstance(a, tuple) and a[0] == "bin" and a[1][1] == "\\\\" for a in h[1])
                kids = kids[1:]
            elif label == "dot":
                inner = kids[2]
                if isinstance(inner, tuple) and inner[0] == "call":
                    kind, name = "remote_call", f"{_text(kids[0])}.{inner[1][0]}"
                    n = len(next((k for k in inner[1][1:] if isinstance(k, list)), []))
                    kids = [kids[0], *inner[1][1:]]
                elif isinstance(inner, Leaf) and inner.kind == "ALIAS":
                    kind, name, kids = "alias", _text(x), []
                else:
                    # without parentheses a variable's member is a field
                    kind, name, n, kids = "field" if isinstance(kids[0], Leaf) and kids[0].kind == "ID" else "remote_call", _text(x), 0, [kids[0]]
            elif label == "dotcall":
                kind, name, n = "dynamic_call", _text(kids[0]), len(args)
            elif label == "at":
                inner = kids[1]
                kind = "attribute"
                name = str(inner) if isinstance(inner, str) else str(inner[1][0]) if isinstance(inner, tuple) and inner[0].startswith("call") else _text(inner)
                n = len(next((k for k in inner[1][1:] if isinstance(k, list)), [])) if isinstance(inner, tuple) and inner[0].startswith("call") else 0
                kids = inner[1][1:] if isinstance(inner, tuple) and inner[0].startswith("call") else []
            elif label in ("bin", "un"):
                kind = "operator" if label == "bin" or str(kids[0]) != "&" else "capture"
                name, n = str(kids[1] if label == "bin" else kids[0]), 2 if label == "bin" else 1
                if kind == "capture" and isinstance(kids[1], tuple) and kids[1][0] == "bin" and kids[1][1][1] == "/":
                    named.add(id(kids[1][1][0]))
                if label == "bin":
                    kids = [kids[0], kids[2]]
                    sides = [binds or name in ("=", "<-"), binds and name not in ("when", "\\\\", "::")]
                else:
                    kids, sides = [kids[1]], [binds and name != "^"]
            elif label == "fn":
                kind, n = "fn", None
            elif label in ("stab", "stab0"):
                kind = "clause"
                sides = [True] * (len(kids) - 1) + [False] if label == "stab" else None
            else:
                kind = label
        else:
            continue
        if id(x) in heads:
            kind = "head"
        elif id(x) in named:
            kind = "function_name"
        text = f"{name} {_text(args)}" if kind == "call" and name in _TEXTS else f"@{name} {_text(kids)}" if kind == "attribute" else _text(x) if name in _TEXTS else name
        row = [file_id, pre, None, parent, depth, nth, kind, name, text, n, defaults, has_do, _line(x), mod2 if kind == "call" and name in MODULES else module, fun2 if kind == "call" and name in DEFINERS else fun, ar2 if kind == "call" and name in DEFINERS else arity, None]
        rows.append(row)
        me = pre
        pre += 1
        inner = (set(), [], scope) if kind == "fn" else scope
        stack.append((row, inner if kind == "fn" else None))
        for i, k in reversed(list(enumerate(kids))):
            stack.append((k, me, depth + 1, i, mod2, fun2, ar2, inner, sides[i] if sides else binds and kind != "call"))
    return [tuple(r) for r in rows]


def _parse_rows(files: DataFrame, errors: bool, keep: list[str]) -> DataFrame:
    kept = ", ".join(f"{c} bigint" for c in keep)
    schema = ("file_id bigint, path string, message string, line int" if errors else NODE) + (f", {kept}" if kept else "")
    cols = [c.split()[0] for c in schema.split(", ")]
    whole = [c for c in cols if c in ("pre", "post", "parent", "depth", "nth", "arity", "defaults", "line", "fun_arity")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, path, content, *rest in zip(b["file_id"].astype("Int64"), b["path"], b["content"], *(b[c].astype("Int64") for c in keep)):
                fid = None if fid is pd.NA else int(fid)
                try:
                    rows = nodes_of(fid, normal(content))
                    if not errors:
                        out.extend((*r, *rest) for r in rows)
                except SyntaxFault as e:
                    if errors:
                        out.append((fid, path, e.message, e.line, *rest))
            yield pd.DataFrame(out, columns=cols).astype({c: "Int32" for c in whole} | {c: "Int64" for c in ("file_id", *keep)})

    src = files.filter(F.col("path").rlike(r"\.exs?$")).select("file_id", "path", "content", *keep)
    return spread(src).mapInPandas(run, schema)


def ast_nodes(files: DataFrame) -> DataFrame:
    """The interval table of all files that parse; a null file_id is an id of its own."""
    return _parse_rows(files, False, [])


def parse_errors(files: DataFrame) -> DataFrame:
    return _parse_rows(files, True, [])


def of_current_files(files: DataFrame, errors: bool = False) -> DataFrame:
    """``ast_nodes`` or ``parse_errors`` of the current states among ``files`` (file_id, path, content, mtime).

    The greatest mtime of a file_id is current, of equal ones the greatest content hash; a null mtime is below all others.  Contents are parsed where
    they are read and never moved: which state is current is found over (file_id, mtime, hash), and the rows of other states are dropped by a semi
    join, below which filters on the facts wanted and the choice of their columns reach.
    """
    keyed = files.select("file_id", "path", "content", "mtime", F.xxhash64("content", F.col("content").isNull(), "path").alias("version"))
    best = keyed.groupBy("file_id").agg(F.max(F.struct("mtime", "version")).alias("_b")).select(F.col("file_id").alias("_f"), F.col("_b.mtime").alias("_m"), F.col("_b.version").alias("_v"))
    rows = _parse_rows(keyed, errors, ["mtime", "version"])
    on = F.col("file_id").eqNullSafe(F.col("_f")) & F.col("mtime").eqNullSafe(F.col("_m")) & (F.col("version") == F.col("_v"))
    return rows.join(best, on, "left_semi").drop("mtime", "version").distinct()  # a state may be delivered twice


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes below given nodes (file_id, pre, post), by intervals within a file."""
    a = of.select("file_id", F.col("pre").alias("a_pre"), F.col("post").alias("a_post"))
    return nodes.join(a, "file_id").filter((F.col("pre") > F.col("a_pre")) & (F.col("post") < F.col("a_post")))


# --- facts ---------------------------------------------------------------------------------------------------------------------------------------


def _calls(n: DataFrame, *names: str) -> DataFrame:
    return n.filter((F.col("kind") == "call") & F.col("name").isin(*names))


def modules(n: DataFrame) -> DataFrame:
    m = _calls(n, *MODULES).select("file_id", F.col("module").alias("name"), F.col("name").alias("definer"), "line", F.col("depth"))
    parent = F.when(F.col("depth") > 0, F.regexp_extract("name", r"^(.*)\.[^.]+$", 1))
    return m.withColumn("parent", F.when(parent != "", parent))


def clauses(n: DataFrame) -> DataFrame:
    """Definition clauses, numbered from 1 within their function."""
    w = Window.partitionBy("file_id", "module", "fun", "fun_arity").orderBy("pre")
    return _calls(n, *DEFINERS).filter(F.col("fun").isNotNull()).select("file_id", "module", F.col("fun").alias("name"), F.col("fun_arity").alias("arity"), F.col("name").alias("definer"), "defaults", "line", F.row_number().over(w).alias("clause_order"))


def functions(n: DataFrame) -> DataFrame:
    c = clauses(n)
    return c.groupBy("file_id", "module", "name", "arity").agg(F.min_by("definer", "clause_order").alias("definer"), F.count("*").alias("clauses"), (F.col("arity") - F.max("defaults")).alias("min_arity"), F.min("line").alias("line"))


def parameters(n: DataFrame) -> DataFrame:
    """Parameters of definition clauses by place, with their kind."""
    head = n.filter(F.col("kind") == "head").select(F.col("file_id").alias("_f"), F.col("pre").alias("_h"))
    p = n.join(head, (F.col("file_id") == F.col("_f")) & (F.col("parent") == F.col("_h"))).drop("_f", "_h")
    kind = F.when((F.col("kind") == "operator") & (F.col("name") == "\\\\"), "default").when((F.col("kind") == "operator") & (F.col("name") == "^"), "pin").when(F.col("kind") == "var", "simple").otherwise("pattern")
    w = Window.partitionBy("file_id", "parent").orderBy("pre")
    return p.select("file_id", "module", F.col("fun").alias("name"), F.col("fun_arity").alias("arity"), kind.alias("parameter_kind"), "text", "line", (F.row_number().over(w) - 1).alias("position"))


def calls(n: DataFrame) -> DataFrame:
    """Local, remote and dynamic calls with the function they stand in, numbered from 0 within the module."""
    local = (F.col("kind") == "call") & ~F.col("name").isin(*SPECIAL)
    hit = n.filter(local | F.col("kind").isin("remote_call", "dynamic_call"))
    kind = F.when(F.col("kind") == "dynamic_call", "dynamic").when(F.col("name").isin("apply", "Kernel.apply"), "dynamic").when(F.col("kind") == "remote_call", "remote").otherwise("local")
    w = Window.partitionBy("file_id", "module").orderBy("pre")
    return hit.filter(F.col("fun").isNotNull()).select("file_id", "module", "fun", "fun_arity", kind.alias("call_kind"), "name", "arity", "line", (F.row_number().over(w) - 1).alias("position"))


def directives(n: DataFrame) -> DataFrame:
    d = _calls(n, "alias", "import", "require", "use")
    scope = F.when(F.col("fun").isNotNull(), "function").otherwise("module")
    w = Window.partitionBy("file_id", "module", "name").orderBy("pre")
    target = F.regexp_extract(F.col("text"), r"^(?:alias|import|require|use)\(?\s*((?:[A-Z]\w*|__MODULE__)(?:\.[A-Z]\w*)*)", 1)
    group = F.regexp_extract(F.col("text"), r"\.\{([^}]*)\}", 1)
    each = d.select("file_id", "module", F.col("name").alias("directive"), "line", scope.alias("scope"), target.alias("base"), group.alias("grouped"), F.regexp_extract("text", r"as:\s*([A-Z][\w.]*)", 1).alias("renamed"), F.col("text").rlike(r"\bonly:").alias("has_only"), F.col("text").rlike(r"\bexcept:").alias("has_except"), (F.row_number().over(w) - 1).alias("position"))
    parts = F.when(F.col("grouped") != "", F.transform(F.split("grouped", r"\s*,\s*"), lambda x: F.concat("base", F.lit("."), F.trim(x)))).otherwise(F.array("base"))
    return each.withColumn("target", F.explode(parts)).drop("base", "grouped")


def attributes(n: DataFrame) -> DataFrame:
    kind = F.col("name")
    return n.filter(F.col("kind") == "attribute").select("file_id", "module", F.col("name"), "line", F.col("arity").alias("values"), F.regexp_replace("text", r"(?s)^@\S+ ?", "").alias("value"), "text", F.when(kind.isin("doc", "moduledoc", "typedoc"), "documentation").when(kind.isin("type", "typep", "opaque"), "type").when(kind.isin("spec", "callback", "macrocallback"), "spec").when(kind.isin("behaviour", "impl", "deprecated", "since", "derive", "compile", "enforce_keys", "on_load", "before_compile", "after_compile", "external_resource", "dialyzer", "vsn"), kind).otherwise("attribute").alias("attribute_kind"))


def types(n: DataFrame) -> DataFrame:
    t = attributes(n).filter("attribute_kind = 'type'")
    head = F.regexp_extract("text", r"^@?(?:typep|type|opaque)\s*([a-z_]\w*)", 1)
    args = F.regexp_extract("text", r"^@?(?:typep|type|opaque)\s*[a-z_]\w*\(([^)]*)\)", 1)
    return t.select("file_id", "module", head.alias("name"), F.when(args == "", 0).otherwise(F.size(F.split(args, ","))).alias("arity"), F.col("name").alias("visibility"), "line")


def specs(n: DataFrame) -> DataFrame:
    return attributes(n).filter("attribute_kind = 'spec'").select("file_id", "module", F.col("name").alias("spec_kind"), F.regexp_extract("text", r"^@?(?:spec|callback|macrocallback)\s*([a-z_]\w*[?!]?)", 1).alias("name"), "line")


def control_flow(n: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id", "module", "name").orderBy("pre")
    return _calls(n, *CONTROL).select("file_id", "module", "fun", "fun_arity", F.col("name").alias("construct"), "line", (F.row_number().over(w) - 1).alias("position"))


def exceptions(n: DataFrame) -> DataFrame:
    return _calls(n, "try", "raise", "reraise", "throw", "exit").select("file_id", "module", "fun", "fun_arity", F.col("name").alias("construct"), "line")


def structs(n: DataFrame) -> DataFrame:
    return _calls(n, "defstruct", "defexception").select("file_id", "module", F.col("name").alias("definer"), F.regexp_extract_all("text", F.lit(r"(?::|\b)([a-z_]\w*)(?=[:,\]]|$)"), 1).alias("fields"), "line")


def protocols(n: DataFrame) -> DataFrame:
    p = _calls(n, "defprotocol", "defimpl")
    alias = r"([A-Z]\w*(?:\.[A-Z]\w*)*)"
    return p.select("file_id", F.regexp_extract("text", rf"^\w+ {alias}", 1).alias("protocol"), (F.col("name") == "defimpl").alias("implementation"), F.regexp_extract("text", rf"\bfor:\s*{alias}", 1).alias("for_type"), "line")


def behaviours(n: DataFrame) -> DataFrame:
    """Behaviours that modules adopt, by @behaviour or use of a known process behaviour."""
    adopted = attributes(n).filter("name = 'behaviour'").select("file_id", "module", F.regexp_extract("text", r"([A-Z][\w.]*)", 1).alias("behaviour"))
    used = directives(n).filter((F.col("directive") == "use") & F.col("target").isin("GenServer", "Supervisor", "DynamicSupervisor", "Agent", "Task", "Application")).select("file_id", "module", F.col("target").alias("behaviour"))
    return adopted.unionByName(used).distinct()


#: Callbacks of process behaviours by name and arity.
CALLBACKS = [("GenServer", "init", 1), ("GenServer", "handle_call", 3), ("GenServer", "handle_cast", 2), ("GenServer", "handle_info", 2), ("GenServer", "handle_continue", 2), ("GenServer", "terminate", 2), ("GenServer", "code_change", 3), ("GenServer", "format_status", 1), ("Supervisor", "init", 1), ("DynamicSupervisor", "init", 1), ("Application", "start", 2), ("Application", "stop", 1)]


def process_callbacks(n: DataFrame) -> DataFrame:
    """Functions of modules that are callbacks of a process behaviour the module adopts."""
    cb = n.sparkSession.createDataFrame(CALLBACKS, "behaviour string, name string, arity int")
    f = functions(n)
    return behaviours(n).join(f, ["file_id", "module"]).join(F.broadcast(cb), ["behaviour", "name", "arity"]).select("file_id", "module", "behaviour", "name", "arity", "line")


def anonymous_functions(n: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id", "module").orderBy("pre")
    return n.filter(F.col("kind").isin("fn", "capture")).select("file_id", "module", "fun", "fun_arity", "kind", "line", "pre", "post", (F.row_number().over(w) - 1).alias("position"))


def free_variables(n: DataFrame) -> DataFrame:
    """Variables that an anonymous function uses and does not bind, per function, with how often it uses them; see ``nodes_of``."""
    return n.filter(F.col("kind") == "fn").select("file_id", "module", "fun", "line", "pre", F.explode("free").alias("name")).groupBy("file_id", "module", "fun", "line", "pre", "name").agg(F.count("*").alias("uses"))


def quotes(n: DataFrame) -> DataFrame:
    return _calls(n, "quote", "unquote", "unquote_splicing").select("file_id", "module", "fun", F.col("name").alias("construct"), "line", "depth")


def snapshot_statistics(files: DataFrame, n: DataFrame) -> DataFrame:
    """One row: modules, definition clauses, macros, protocols, behaviours, files and lines; ``files`` has path and lines."""
    counts = n.agg(F.count_if((F.col("kind") == "call") & (F.col("name") == "defmodule")).alias("modules"), F.count_if((F.col("kind") == "call") & F.col("name").isin("def", "defp")).alias("functions"), F.count_if((F.col("kind") == "call") & F.col("name").isin("defmacro", "defmacrop")).alias("macros"), F.count_if((F.col("kind") == "call") & (F.col("name") == "defprotocol")).alias("protocols"), F.count_distinct(F.when((F.col("kind") == "attribute") & (F.col("name") == "callback"), F.struct("file_id", "module"))).alias("behaviours"))
    lines = files.filter(F.col("path").rlike(r"\.exs?$")).agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return counts.crossJoin(lines)  # one row each


def supervisors(n: DataFrame) -> DataFrame:
    """Supervisors with strategy and restart limits; without options the strategy is one_for_one, with 3 restarts in 5 seconds."""
    c = n.filter((F.col("kind") == "remote_call") & F.col("name").isin("Supervisor.init", "Supervisor.start_link", "DynamicSupervisor.init", "DynamicSupervisor.start_link"))
    number = lambda k, d: F.coalesce(F.regexp_extract("text", rf"{k}:\s*(\d+)", 1).try_cast("int"), F.lit(d))
    strategy = F.regexp_extract("text", r"strategy:\s*:(\w+)", 1)
    out = c.groupBy("file_id", "module").agg(F.min_by(F.struct(F.regexp_extract("name", r"^(\w+)\.", 1).alias("behaviour"), F.when(strategy == "", "one_for_one").otherwise(strategy).alias("strategy"), number("max_restarts", 3).alias("max_restarts"), number("max_seconds", 5).alias("max_seconds"), "line"), "pre").alias("s"))
    out = out.select("file_id", "module", "s.*")
    return out.withColumn("intensity", F.try_divide(F.col("max_restarts"), F.col("max_seconds"))).withColumn("high", F.col("intensity") > 1.0)


def child_specs(n: DataFrame) -> DataFrame:
    """The first module in each element of a supervisor's child list in init or start_link, by place; a name that ends in Supervisor is one, all others
    are workers."""
    sup = n.filter((F.col("kind") == "operator") & (F.col("name") == "=") & (F.col("fun") == "init") | (F.col("kind") == "remote_call") & F.col("name").isin("Supervisor.init", "Supervisor.start_link")).select("file_id", "module", "fun", F.col("pre").alias("a"), F.col("post").alias("b"))
    lists = n.filter("kind = 'list'").select("file_id", F.col("pre").alias("lp"), F.col("post").alias("lq")).join(sup, "file_id").filter("lp > a and lq < b").select("file_id", "module", "lp").distinct()
    # outermost lists only: an element may hold a list of its own
    element = n.select("file_id", F.col("parent").alias("lp"), F.col("pre").alias("e"), F.col("post").alias("f")).join(lists, ["file_id", "lp"])
    named = n.filter("kind = 'alias'").select("file_id", "name", "pre", "post", "line").join(element, "file_id").filter("pre >= e and post <= f")
    each = named.groupBy("file_id", "module", "lp", "e").agg(F.min(F.struct("pre", "name", "line")).alias("c")).groupBy("file_id", "module", "c").agg(F.min("lp").alias("lp")).select("file_id", "module", "lp", "c.*")
    place = Window.partitionBy("file_id", "module", "lp").orderBy("pre")
    return each.select("file_id", "module", F.col("name").alias("child"), (F.row_number().over(place) - 1).alias("position"), F.when(F.endswith("name", F.lit("Supervisor")), "supervisor").otherwise("worker").alias("type"), "line")


def ets_tables(n: DataFrame) -> DataFrame:
    """Tables made by :ets.new with type and access by the order of precedence of their options."""
    t = n.filter((F.col("kind") == "remote_call") & (F.col("name") == ":ets.new"))
    has = lambda o: F.rlike("text", F.lit(rf":{o}\b"))
    kind = F.when(has("ordered_set"), "ordered_set").when(has("duplicate_bag"), "duplicate_bag").when(has("bag"), "bag").otherwise("set")
    access = F.when(has("public"), "public").when(has("private"), "private").otherwise("protected")
    flag = lambda o: F.rlike("text", F.lit(rf"{o}[:,]\s*(true|:auto)"))
    return t.select("file_id", "module", "fun", F.regexp_extract("text", r":ets\.new\(:?(\w+)", 1).alias("table"), kind.alias("type"), access.alias("access"), has("named_table").alias("named"), flag("read_concurrency").alias("read_concurrency"), flag("write_concurrency").alias("write_concurrency"), "line")


def macro_invocations(n: DataFrame) -> DataFrame:
    """Calls of known macros by library."""
    table = {"Logger": "debug info notice warning error critical alert emergency", "Ecto.Schema": "schema field belongs_to has_many has_one many_to_many embeds_one embeds_many timestamps", "ExUnit": "test describe assert refute setup setup_all assert_raise", "Kernel": "if unless def defp defmacro defmodule defstruct raise use require import alias"}
    by = F.create_map(*[F.lit(x) for lib, ws in table.items() for w in ws.split() for x in ((f"Logger.{w}" if lib == "Logger" else w), lib)])
    lib = F.try_element_at(by, F.col("name"))
    w = Window.partitionBy("file_id", "module", "name").orderBy("pre")
    return n.filter(F.col("kind").isin("call", "remote_call")).withColumn("library", lib).filter("library is not null").select("file_id", "module", "fun", F.col("name").alias("macro"), "library", "arity", "line", (F.row_number().over(w) - 1).alias("position"))


#: Tests on one node by name, as the walker's predicates.
MATCHERS: dict[str, Column] = {}


def _matchers() -> None:
    kind, name = F.col("kind"), F.col("name")
    call = lambda *ns: (kind == "call") & name.isin(*ns)
    MATCHERS.update(
        module=call("defmodule"), protocol=call("defprotocol"), implementation=call("defimpl"), function=call("def", "defp"), public_function=call("def"), private_function=call("defp"), macro=call("defmacro", "defmacrop"), guard=call("defguard", "defguardp"), delegate=call("defdelegate"), struct_definition=call("defstruct"),
        exception_definition=call("defexception"), directive=call("alias", "import", "require", "use"), control_flow=call(*CONTROL), quote=call("quote"), unquote=call("unquote", "unquote_splicing"), attribute=kind == "attribute", documentation=(kind == "attribute") & name.isin("doc", "moduledoc", "typedoc"), type_definition=(kind == "attribute") & name.isin("type", "typep", "opaque"),
        spec=(kind == "attribute") & (name == "spec"), callback=(kind == "attribute") & name.isin("callback", "macrocallback"), behaviour=(kind == "attribute") & (name == "behaviour"), anonymous_function=kind == "fn", capture=kind == "capture", pipe=(kind == "operator") & (name == "|>"), operator=kind == "operator", variable=kind == "var", literal=kind.isin("integer", "float", "string", "charlist", "atom", "sigil"), remote_call=kind == "remote_call",
    )


def find(n: DataFrame, matcher: str) -> DataFrame:
    """Nodes that a named test accepts, in pre-order within files."""
    if not MATCHERS:
        _matchers()
    return n.filter(MATCHERS[matcher])


# --- statements ----------------------------------------------------------------------------------------------------------------------------------


def _statements(df: DataFrame, subject: Column, pairs: list[tuple[str, Column]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs])
    return df.select(T.iri(subject).alias("s"), F.explode(rows).alias("t")).select(F.lit("").alias("g"), "s", "t.p", "t.o").filter(F.col("o").isNotNull())


def _text_of(c: str, dt: str = "string") -> Column:
    return T.literal(F.col(c).cast("string"), T.XSD + dt)


def build(n: DataFrame, base: str = T.DATA) -> DataFrame:
    """Statements (g, s, p, o) about modules, functions, clauses, calls, control flow, directives, types and processes; duplicates removed.

    The nodes are read once for each part: hand in a stored table, or they are parsed as often.
    """
    b, C = F.lit(base), lambda x: T.constant(("iri", x))
    mod = lambda c: S.iri_module(b, F.col(c))
    fun = lambda m, f, a: S.iri_function(b, F.col(m), F.col(f), F.col(a))
    m, f, c = modules(n), functions(n), clauses(n)
    parts = [
        _statements(m, mod("name"), [(T.RDF_TYPE, C(T.STRUCT + "Module")), (T.RDF_TYPE, F.when(F.col("parent").isNotNull(), C(T.STRUCT + "NestedModule"))), (T.STRUCT + "moduleName", _text_of("name")), (T.STRUCT + "parentModule", T.iri(mod("parent"))), (T.RDF_TYPE, F.when(F.col("definer") == "defprotocol", C(T.STRUCT + "Protocol")))]),
        _statements(f, fun("module", "name", "arity"), [(T.RDF_TYPE, C(T.STRUCT + "Function")), (T.RDF_TYPE, F.when(F.col("definer") == "def", C(T.STRUCT + "PublicFunction")).when(F.col("definer") == "defp", C(T.STRUCT + "PrivateFunction")).when(F.col("definer").isin("defguard", "defguardp"), C(T.STRUCT + "GuardFunction")).when(F.col("definer") == "defdelegate", C(T.STRUCT + "DelegatedFunction")).when(F.col("definer").isin("defmacro", "defmacrop"), C(T.STRUCT + "Macro"))), (T.STRUCT + "functionName", _text_of("name")), (T.STRUCT + "arity", _text_of("arity", "nonNegativeInteger")), (T.STRUCT + "minArity", F.when(F.col("min_arity") != F.col("arity"), _text_of("min_arity", "nonNegativeInteger"))), (T.STRUCT + "belongsTo", T.iri(mod("module")))]),
        _statements(f, mod("module"), [(T.STRUCT + "containsFunction", T.iri(fun("module", "name", "arity")))]),
        _statements(c, S.iri_child(fun("module", "name", "arity"), F.lit("clause"), F.col("clause_order") - 1), [(T.RDF_TYPE, C(T.STRUCT + "FunctionClause")), (T.STRUCT + "clauseOrder", _text_of("clause_order", "positiveInteger"))]),
        _statements(c, fun("module", "name", "arity"), [(T.STRUCT + "hasClause", T.iri(S.iri_child(fun("module", "name", "arity"), F.lit("clause"), F.col("clause_order") - 1)))]),
    ]
    k = calls(n)
    call = F.concat(b, F.lit("call/"), S.escape_name(F.col("module")), F.lit("/"), F.col("position").cast("string"))
    parts.append(_statements(k, call, [(T.RDF_TYPE, F.when(F.col("call_kind") == "remote", C(T.STRUCT + "RemoteCall")).otherwise(C(T.STRUCT + "LocalCall"))), (T.STRUCT + "calledName", _text_of("name")), (T.STRUCT + "callerFunction", T.iri(fun("module", "fun", "fun_arity"))), (T.STRUCT + "callsFunction", F.when(F.col("call_kind") == "local", T.iri(fun("module", "name", "arity"))).when(F.col("call_kind") == "remote", T.iri(F.concat(b, S.escape_name(F.regexp_extract("name", r"^(.*)\.[^.]+$", 1)), F.lit("/"), S.escape_name(F.regexp_extract("name", r"([^.]+)$", 1)), F.lit("/"), F.col("arity").cast("string")))))]))
    d = directives(n)
    dir_iri = S.iri_child(mod("module"), F.col("directive"), F.col("position"))
    parts.append(_statements(d, dir_iri, [(T.RDF_TYPE, T.iri(F.concat(F.lit(T.STRUCT + "Module"), F.initcap("directive")))), (T.STRUCT + "refersTo", T.iri(mod("target")))]))
    t = types(n)
    parts.append(_statements(t, S.iri_child(mod("module"), F.lit("type"), F.col("name"), F.col("arity")), [(T.RDF_TYPE, F.when(F.col("visibility") == "typep", C(T.STRUCT + "PrivateType")).when(F.col("visibility") == "opaque", C(T.STRUCT + "OpaqueType")).otherwise(C(T.STRUCT + "PublicType"))), (T.STRUCT + "typeName", _text_of("name")), (T.STRUCT + "typeArity", _text_of("arity", "nonNegativeInteger"))]))
    v = control_flow(n)
    parts.append(_statements(v, S.iri_child(mod("module"), F.col("construct"), F.col("position")), [(T.RDF_TYPE, T.iri(F.concat(F.lit(T.CORE), F.initcap("construct"), F.lit("Expression")))), (T.CORE + "inFunction", T.iri(fun("module", "fun", "fun_arity")))]))
    p = process_callbacks(n)
    parts.append(_statements(p, fun("module", "name", "arity"), [(T.RDF_TYPE, T.iri(F.concat(F.lit(T.OTP), F.replace(F.initcap(F.replace("name", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), F.lit("Callback"))))]))
    named = lambda kind: S.iri_child(mod("module"), F.lit(kind), F.col("line"))
    a = attributes(n)
    parts.append(_statements(a, S.iri_child(mod("module"), F.lit("attribute"), F.col("name"), F.col("line")), [(T.RDF_TYPE, T.iri(F.concat(F.lit(T.STRUCT), F.replace(F.initcap(F.replace("attribute_kind", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), F.lit("Attribute")))), (T.STRUCT + "attributeName", _text_of("name")), (T.STRUCT + "attributeOf", T.iri(mod("module")))]))
    x = exceptions(n)
    parts.append(_statements(x, named("exception"), [(T.RDF_TYPE, T.iri(F.concat(F.lit(T.CORE), F.initcap("construct"), F.lit("Expression")))), (T.CORE + "inFunction", T.iri(fun("module", "fun", "fun_arity")))]))
    st = structs(n)
    parts.append(_statements(st, S.iri_child(mod("module"), F.lit("struct")), [(T.RDF_TYPE, F.when(F.col("definer") == "defexception", C(T.STRUCT + "Exception")).otherwise(C(T.STRUCT + "Struct"))), (T.STRUCT + "structOf", T.iri(mod("module")))]))
    fields = st.select("module", F.posexplode("fields").alias("i", "field"))
    parts.append(_statements(fields, S.iri_child(mod("module"), F.lit("struct"), F.lit("field"), F.col("field")), [(T.RDF_TYPE, C(T.STRUCT + "StructField")), (T.STRUCT + "fieldName", _text_of("field"))]))
    pr = protocols(n)
    parts.append(_statements(pr, mod("protocol"), [(T.RDF_TYPE, F.when(F.col("implementation"), C(T.STRUCT + "ProtocolImplementation")).otherwise(C(T.STRUCT + "Protocol"))), (T.STRUCT + "forDataType", F.when(F.col("for_type") != "", T.iri(mod("for_type"))))]))
    bh = behaviours(n)
    parts.append(_statements(bh, mod("module"), [(T.STRUCT + "implementsBehaviour", T.iri(mod("behaviour"))), (T.RDF_TYPE, F.when(F.col("behaviour").isin("GenServer", "Supervisor", "DynamicSupervisor", "Agent", "Task"), T.iri(F.concat(F.lit(T.OTP), "behaviour", F.lit("Implementation")))))]))
    an = anonymous_functions(n)
    parts.append(_statements(an, S.iri_child(mod("module"), F.when(F.col("kind") == "fn", "anon").otherwise("&"), F.col("position")), [(T.RDF_TYPE, F.when(F.col("kind") == "fn", C(T.STRUCT + "AnonymousFunction")).otherwise(C(T.STRUCT + "CapturedFunction")))]))
    su = supervisors(n)
    parts.append(_statements(su, mod("module"), [(T.RDF_TYPE, T.iri(F.concat(F.lit(T.OTP), "behaviour"))), (T.OTP + "hasStrategy", T.iri(F.concat(F.lit(T.OTP), F.replace(F.initcap(F.replace("strategy", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))))), (T.OTP + "maxRestarts", _text_of("max_restarts", "nonNegativeInteger")), (T.OTP + "maxSeconds", _text_of("max_seconds", "positiveInteger"))]))
    ch = child_specs(n)
    parts.append(_statements(ch, mod("module"), [(T.OTP + "supervises", T.iri(mod("child")))]))
    parts.append(_statements(ch, mod("child"), [(T.OTP + "supervisedBy", T.iri(mod("module")))]))
    et = ets_tables(n)
    parts.append(_statements(et, S.iri_child(mod("module"), F.lit("ets"), F.col("table")), [(T.RDF_TYPE, C(T.OTP + "ETSTable")), (T.OTP + "hasTableType", _text_of("type")), (T.OTP + "hasAccessType", _text_of("access"))]))
    return reduce(lambda x, y: x.unionByName(y), parts).distinct()
