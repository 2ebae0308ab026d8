"""Graphs of statements and their operations.

A graph answers stars, single patterns, closures and descriptions.  ``QuadGraph`` holds statements in a DataFrame (g, s, p, o) with s and o as
terms; ``MappedGraph`` reads relational tables as a graph without writing statements: a star over one class becomes a single scan of its table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..session import stored

QUADS = f"g string, s {T.TERM}, p string, o {T.TERM}"


def bind(df: DataFrame, slots: list[tuple[str, tuple]]) -> DataFrame:
    """Columns bound to the terms of a pattern: constants and repeated variables become filters, variables output columns."""
    out: dict[str, str] = {}
    for col, t in slots:
        if t[0] == "var":
            if t[1] in out:
                df = df.filter(F.col(col) == F.col(out[t[1]]))
            else:
                out[t[1]] = col
        else:
            k, v, dt, lang = T.python_term(t)
            c = F.col(col)
            df = df.filter((c["kind"] == k) & (c["value"] == v) & (c["dt"] == dt) & (c["lang"] == lang))
    return df.select(*[F.col(c).alias(v) for v, c in out.items()]) if out else df.select(F.lit(True).alias("_unit")).limit(1)


class QuadGraph:
    """Statements in a DataFrame; duplicates are removed when statements are added, never at read."""

    one_row_per_subject = False

    def __init__(self, quads: DataFrame):
        self.quads = quads
        self.spark = quads.sparkSession

    def triples(self, s, p, o) -> DataFrame:
        q = self.quads.select("s", T.iri(F.col("p")).alias("p"), "o")
        return bind(q, [("s", s), ("p", p), ("o", o)])

    def star(self, s, pairs, bounds=()) -> DataFrame:
        """Patterns with one subject: a join by the subject of one filtered scan per predicate; a pattern that binds nothing more is a semi join.

        ``bounds`` are conditions that a query states anyway; statements have no typed columns to use them on.
        """
        quads, subject = self.quads, s
        if s[0] != "var":
            k, v, dt, lang = T.python_term(s)
            quads = quads.filter((F.col("s.kind") == k) & (F.col("s.value") == v) & (F.col("s.dt") == dt) & (F.col("s.lang") == lang))
            subject = ("var", "_subject")
        frames = [bind(quads.filter(F.col("p") == p).select("s", "o"), [("s", subject), ("o", o)]) for p, o in pairs]
        frames.sort(key=lambda f: len(f.columns) == 1)  # those that only test come last
        df = frames[0] if len(frames[0].columns) > 1 else frames[0].distinct()
        for one in frames[1:]:
            df = df.join(one, [c for c in df.columns if c in one.columns], "inner" if len(one.columns) > 1 else "left_semi")
        if s[0] == "var":
            return df
        rest = [c for c in df.columns if c != "_subject"]
        return df.select(*[F.col(f"`{c}`") for c in rest]) if rest else df.select(F.lit(True).alias("_unit")).limit(1)

    def with_optional(self, cls: str, path: str) -> DataFrame:
        """(focus, value) of the instances of a class, with a null value where they have none."""
        focus = self.star(("var", "focus"), [(T.RDF_TYPE, ("iri", cls))])
        values = self.quads.filter(F.col("p") == path).select(F.col("s").alias("focus"), F.col("o").alias("value"))
        return focus.join(values, "focus", "left")

    def closure(self, s, p: str, o, reflexive: bool) -> DataFrame:
        edges = self.quads.filter(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b"))
        return bind(reachable(edges, reflexive).select(F.col("a").alias("s"), F.col("b").alias("o")), [("s", s), ("o", o)])

    def describe(self, subjects: DataFrame) -> DataFrame:
        """All statements of the given subjects, (s, p, o); none where a subject is absent."""
        return self.quads.join(subjects, self.quads["s"]["value"] == subjects["s"], "left_semi").select("s", "p", "o")

    # set operations
    def add(self, *others: DataFrame) -> QuadGraph:
        """Set union with further statements."""
        return QuadGraph(reduce(lambda a, b: a.unionByName(b), [self.quads, *others]).distinct())

    merge = add

    def subjects(self) -> DataFrame:
        return self.quads.select("s").distinct()

    def statement_count(self) -> DataFrame:
        return self.quads.agg(F.count("*").alias("statements"))

    def predicates(self) -> DataFrame:
        return self.quads.groupBy("p").agg(F.count("*").alias("n"))

    def in_namespace(self, prefix: str) -> DataFrame:
        return self.quads.filter(F.startswith(F.col("s.value"), F.lit(prefix)))

    def filter_subject(self, value: str) -> DataFrame:
        return self.quads.filter(F.col("s.value") == value)


def reachable(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """(a, b) for every path of edges (a, b).

    Works with cycles.  Each round joins only the pairs that the last round found, with all known ones on both sides, so that path lengths double and
    no pair is extended twice; it ends when a round finds none.  Each round is written to the shared folder, which cuts the lineage and survives lost
    executors.
    """
    edges = stored(edges.select("a", "b").distinct(), "edges")
    total = newest = edges
    while newest.take(1):
        ahead = newest.alias("x").join(total.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        behind = total.alias("x").join(newest.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        newest = stored(ahead.unionByName(behind).distinct().join(total, ["a", "b"], "left_anti"), "paths")
        total = total.unionByName(newest)
    if reflexive:
        nodes = edges.select(F.col("a").alias("n")).unionByName(edges.select(F.col("b").alias("n"))).distinct()
        total = total.unionByName(nodes.select(F.col("n").alias("a"), F.col("n").alias("b"))).distinct()
    return total


def materialise(graph: QuadGraph, profile: str = "rdfs") -> QuadGraph:
    """The graph with what RDFS subclass, subproperty, domain and range axioms entail; profile owl adds inverse and transitive properties."""
    q = graph.quads.select("s", "p", "o").distinct()

    def axioms(p: str) -> DataFrame:
        return graph.quads.filter(F.col("p") == p).select(F.col("s.value").alias("a"), F.col("o.value").alias("b"))

    sub_p = reachable(axioms(T.RDFS + "subPropertyOf"))
    q = q.unionByName(q.join(sub_p, q["p"] == sub_p["a"]).select("s", F.col("b").alias("p"), "o")).distinct()
    if profile == "owl":
        inv = axioms(T.OWL + "inverseOf")
        inv = inv.unionByName(inv.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        q = q.unionByName(q.join(inv, q["p"] == inv["a"]).filter(F.col("o.kind") != "lit").select(F.col("o").alias("s"), F.col("b").alias("p"), F.col("s").alias("o"))).distinct()
        kinds = graph.quads.filter((F.col("p") == T.RDF_TYPE) & (F.col("o.value") == T.OWL + "TransitiveProperty")).select(F.col("s.value").alias("tp"))
        chain = q.join(kinds, q["p"] == kinds["tp"], "left_semi").filter(F.col("o.kind") != "lit")
        pairs = reachable(chain.select(F.struct("p", F.col("s").alias("n")).alias("a"), F.struct("p", F.col("o").alias("n")).alias("b")))
        q = q.unionByName(pairs.select(F.col("a.n").alias("s"), F.col("a.p").alias("p"), F.col("b.n").alias("o"))).distinct()
    typed = []
    for axiom, side in ((T.RDFS + "domain", "s"), (T.RDFS + "range", "o")):
        ax = axioms(axiom)
        typed.append(q.join(ax, q["p"] == ax["a"]).filter(F.col(f"{side}.kind") != "lit").select(F.col(side).alias("s"), F.lit(T.RDF_TYPE).alias("p"), T.iri(F.col("b")).alias("o")))
    q = reduce(lambda a, b: a.unionByName(b), [q, *typed]).distinct()
    sub_c = reachable(axioms(T.RDFS + "subClassOf"))
    more = q.filter(F.col("p") == T.RDF_TYPE).join(sub_c, F.col("o.value") == sub_c["a"]).select("s", "p", T.iri(F.col("b")).alias("o"))
    return QuadGraph(q.unionByName(more).distinct().withColumn("g", F.lit("")).select("g", "s", "p", "o"))


_NUMBERS = ("int", "bigint", "smallint", "tinyint", "double", "float")
_COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


@dataclass
class ClassMap:
    """A table read as instances of a class: subject template over the key, a predicate per column, links per foreign key."""

    cls: str
    table: str
    key: str
    links: dict[str, str] = field(default_factory=dict)  # column -> table whose instances it names
    key_expr: str | None = None  # for keys of several columns


class MappedGraph:
    """Relational tables as a graph; predicates are the column names in the data namespace.  A table's key is unique."""

    one_row_per_subject = True

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], maps: list[ClassMap], base: str = T.DATA):
        self.spark, self.tables, self.maps, self.base = spark, tables, maps, base
        self.by_class = {base + m.cls: m for m in maps}
        self.by_predicate: dict[str, list[ClassMap]] = {}
        for m in maps:
            for c in tables[m.table].columns:
                self.by_predicate.setdefault(base + c, []).append(m)

    def key(self, m: ClassMap):
        return F.expr(m.key_expr) if m.key_expr else F.col(m.key)

    def subject(self, m: ClassMap):
        return self._name(m.table, self.key(m))

    def _name(self, table: str, key) -> F.Column:
        return T.iri(F.concat(F.lit(f"{self.base}{table}/"), key.cast("string")))

    def object(self, m: ClassMap, column: str):
        if column in m.links:
            return self._name(m.links[column], F.col(column))
        return T.typed(F.col(column), dict(self.tables[m.table].dtypes)[column])

    def _maps(self, pairs) -> list[ClassMap]:
        """The tables that have all predicates of a star."""
        maps = None
        for p, o in pairs:
            here = [self.by_class[o[1]]] if p == T.RDF_TYPE and o[0] == "iri" and o[1] in self.by_class else self.maps if p == T.RDF_TYPE and o[0] == "var" else self.by_predicate.get(p, []) if p != T.RDF_TYPE else []
            maps = here if maps is None else [m for m in maps if m in here]
        return maps or []

    def _scan(self, m: ClassMap, pairs, bounds) -> DataFrame:
        """The table with what the star asks of its typed columns, so that it reaches the scan: no nulls, equal texts, and bounds on variables."""
        df = self.tables[m.table]
        types = dict(df.dtypes)
        for p, o in pairs:
            if p == T.RDF_TYPE:
                continue
            column = p[len(self.base):]
            df = df.filter(F.col(column).isNotNull())
            if column in m.links:
                continue
            if o[0] == "lit" and o[2] == T.XSD + "string" and types[column] == "string":
                df = df.filter(F.col(column) == o[1])
            for var, op, value in bounds if o[0] == "var" else ():
                if var == o[1] and (isinstance(value, str) if types[column] == "string" else not isinstance(value, str) and types[column] in _NUMBERS):
                    df = df.filter(_COMPARE[op](F.col(column), F.lit(value)))
        return df

    def star(self, s, pairs, bounds=()) -> DataFrame:
        """One scan of the table that has all predicates of the star; a union over tables where several have."""
        frames = []
        for m in self._maps(pairs):
            slots, cols = [("_s", s)], [self.subject(m).alias("_s")]
            for i, (p, o) in enumerate(pairs):
                cols.append((T.constant(("iri", self.base + m.cls)) if p == T.RDF_TYPE else self.object(m, p[len(self.base):])).alias(f"_o{i}"))
                slots.append((f"_o{i}", o))
            frames.append(bind(self._scan(m, pairs, bounds).select(*cols), slots))
        if not frames:
            names = [t[1] for t in [s, *[o for _, o in pairs]] if t[0] == "var"]
            return self.spark.createDataFrame([], ", ".join(f"`{n}` {T.TERM}" for n in dict.fromkeys(names)) or "_unit boolean")
        return reduce(lambda a, b: a.unionByName(b), frames)

    def basic(self, stars: list[tuple], bounds=()) -> DataFrame | None:
        """Stars (subject, pairs) joined by the tables' own key columns, with terms built from what is left at the end.

        None where this cannot say it: a star over several tables, a shared variable whose columns differ in kind, or a constant subject or link.
        """
        frames = []
        for s, pairs in stars:
            maps = self._maps(pairs)
            if len(maps) != 1 or s[0] != "var":
                return None
            m = maps[0]
            types = dict(self.tables[m.table].dtypes)
            df, held, equal = self._scan(m, pairs, bounds), {s[1]: (("iri", m.table), self.key(m))}, []
            for p, o in pairs:
                column = p[len(self.base):]
                if p == T.RDF_TYPE:
                    if o[0] == "var":
                        return None
                elif o[0] == "var":
                    kind = ("iri", m.links[column]) if column in m.links else ("lit", types[column])
                    if o[1] in held:
                        if held[o[1]][0] != kind:
                            return None
                        equal.append(held[o[1]][1] == F.col(column))
                    else:
                        held[o[1]] = (kind, F.col(column))
                elif o[0] == "lit" and column not in m.links:
                    equal.append(self.object(m, column) == T.constant(o))
                else:
                    return None
            for e in equal:
                df = df.filter(e)
            frames.append((df.select(*[c.alias(v) for v, (_, c) in held.items()]), {v: k for v, (k, _) in held.items()}))
        df, kinds = frames.pop(0)
        while frames:
            k = next((i for i, (_, other) in enumerate(frames) if other.keys() & kinds.keys()), None)
            if k is None:
                return None
            one, other = frames.pop(k)
            shared = sorted(other.keys() & kinds.keys())
            if any(other[v] != kinds[v] or kinds[v][1] in ("double", "float") for v in shared):  # equal numbers may differ as texts
                return None
            df, kinds = df.join(one, shared), {**kinds, **other}
        return df.select(*[(self._name(k[1], F.col(f"`{v}`")) if k[0] == "iri" else T.typed(F.col(f"`{v}`"), k[1])).alias(v) for v, k in kinds.items()])

    def with_optional(self, cls: str, path: str) -> DataFrame:
        """(focus, value) of the instances of a class, with a null value where they have none: one scan of two columns."""
        m = self.by_class.get(cls)
        if m is None:
            return self.spark.createDataFrame([], f"focus {T.TERM}, value {T.TERM}")
        column = path[len(self.base):]
        value = T.constant(("iri", cls)) if path == T.RDF_TYPE else self.object(m, column) if m in self.by_predicate.get(path, []) else F.lit(None).cast(T.TERM)
        return self.tables[m.table].select(self.subject(m).alias("focus"), value.alias("value"))

    def quads(self, only: list[str] | None = None) -> DataFrame:
        """All statements, by one pass over each table."""
        out = []
        for m in self.maps:
            if only and m.table not in only:
                continue
            df = self.tables[m.table]
            rows = [F.struct(F.lit(T.RDF_TYPE).alias("p"), T.constant(("iri", self.base + m.cls)).alias("o"))]
            rows += [F.struct(F.lit(self.base + c).alias("p"), self.object(m, c).alias("o")) for c in df.columns]
            out.append(df.select(self.subject(m).alias("s"), F.explode(F.array(*rows)).alias("t")).select(F.lit("").alias("g"), "s", "t.p", "t.o").filter(F.col("o").isNotNull()))
        return reduce(lambda a, b: a.unionByName(b), out)

    def triples(self, s, p, o) -> DataFrame:
        return QuadGraph(self.quads()).triples(s, p, o)

    def closure(self, s, p: str, o, reflexive: bool) -> DataFrame:
        return QuadGraph(self.quads()).closure(s, p, o, reflexive)

    def describe(self, subjects: DataFrame) -> DataFrame:
        return QuadGraph(self.quads()).describe(subjects)


#: The driver's tables as classes.
TPCH = [
    ClassMap("Region", "region", "r_regionkey"),
    ClassMap("Nation", "nation", "n_nationkey", {"n_regionkey": "region"}),
    ClassMap("Customer", "customer", "c_custkey", {"c_nationkey": "nation"}),
    ClassMap("Supplier", "supplier", "s_suppkey", {"s_nationkey": "nation"}),
    ClassMap("Part", "part", "p_partkey"),
    ClassMap("Order", "orders", "o_orderkey", {"o_custkey": "customer"}),
    ClassMap("LineItem", "lineitem", "l_orderkey", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "concat_ws('-', l_orderkey, l_linenumber)"),
]


def mapped(spark: SparkSession, folder: str, names: list[str] | None = None) -> MappedGraph:
    """The driver's relational tables as a graph."""
    from ..session import table

    maps = [m for m in TPCH if not names or m.table in names]
    return MappedGraph(spark, {m.table: table(spark, folder, m.table) for m in maps}, maps)
