"""SHACL shapes compiled to violation plans.

A shape has targets and constraint components; each component becomes one DataFrame of violations (focus, path, component, value, message,
severity).  ``validate`` unions them.  A class and a path are asked of the graph together: over mapped tables that is one scan of the columns needed,
over statements a join.  Counts keep focus nodes without values.  Shapes that refer to themselves are refused.
``compat`` keeps two habits of the modelled engine: a property-level minInclusive is not checked, and patterns over 500 characters are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T

RESULT = f"shape string, focus {T.TERM}, path string, component string, value {T.TERM}, message string, severity string"
MAX_PATTERN = 500


@dataclass
class Property:
    """Constraints on the values of one path."""

    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    cls: str | None = None
    node_kind: str | None = None
    pattern: str | None = None
    flags: str = ""
    min_length: int | None = None
    max_length: int | None = None
    one_of: list | None = None  # parser terms
    has_value: tuple | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None
    language_in: list | None = None
    qualified_class: str | None = None
    qualified_min: int | None = None
    message: str | None = None


@dataclass
class Shape:
    """A node shape.  ``node`` holds constraints on the focus itself; ``all_of`` and so on name other shapes; ``sparql`` are SELECTs of $this."""

    name: str
    target_classes: list[str] = field(default_factory=list)
    target_nodes: list[tuple] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)
    node: Property | None = None
    all_of: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    one_of: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)
    sparql: list[str] = field(default_factory=list)
    severity: str = "violation"
    message: str | None = None


class Focus:
    """The focus nodes of a shape: instances by direct type, and named nodes whether or not they occur in the data."""

    def __init__(self, graph, classes: list[str], nodes: list[tuple]):
        self.graph, self.classes, self.nodes, self.spark = graph, classes, nodes, graph.spark

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        df = reduce(lambda a, b: a.unionByName(b), parts)
        return df if len(parts) == 1 and self.graph.one_row_per_subject else df.distinct()

    def _named(self) -> DataFrame:
        return self.spark.createDataFrame([(T.python_term(t),) for t in self.nodes], f"focus {T.TERM}")

    def frame(self) -> DataFrame:
        parts = [self.graph.star(("var", "focus"), [(T.RDF_TYPE, ("iri", c))]) for c in self.classes]
        return self._union(parts + ([self._named()] if self.nodes else []), f"focus {T.TERM}")

    def values(self, path: str, bounds=()) -> DataFrame:
        """(focus, value) of a path; ``bounds`` on ``value`` that the caller tests anyway."""
        parts = [self.graph.star(("var", "focus"), [(T.RDF_TYPE, ("iri", c)), (path, ("var", "value"))], bounds) for c in self.classes]
        if self.nodes:
            parts.append(self._named().join(self.graph.star(("var", "focus"), [(path, ("var", "value"))], bounds), "focus"))
        return self._union(parts, f"focus {T.TERM}, value {T.TERM}")

    def with_optional(self, path: str) -> DataFrame:
        """(focus, value) with a null value for focus nodes without any."""
        parts = [self.graph.with_optional(c, path) for c in self.classes]
        if self.nodes:
            parts.append(self._named().join(self.graph.star(("var", "focus"), [(path, ("var", "value"))]), "focus", "left"))
        return self._union(parts, f"focus {T.TERM}, value {T.TERM}")


class Validator:
    """``graph`` is a graph, or statements (g, s, p, o)."""

    def __init__(self, graph, shapes: list[Shape], compat: bool = False):
        if isinstance(graph, DataFrame):
            from ..operators.graph import QuadGraph

            graph = QuadGraph(graph)
        self.graph, self.shapes, self.compat = graph, {s.name: s for s in shapes}, compat
        self.order = shapes
        self.spark = graph.spark

    def targets(self, shape: Shape) -> Focus:
        return Focus(self.graph, shape.target_classes, shape.target_nodes)

    def instances(self, cls: str) -> DataFrame:
        return self.graph.star(("var", "value"), [(T.RDF_TYPE, ("iri", cls))])

    # one function per kind of component; each returns rows (focus, path, component, value)
    def _per_value(self, p: Property, node: bool) -> list[tuple[str, Column]]:
        """(component, condition that a value fails) of the components that look at one value."""
        v = F.col("value")
        lit = v["kind"] == "lit"
        text = v["value"]
        number = text.try_cast("double")
        out: list[tuple[str, Column]] = []
        if p.datatype:
            out.append(("datatype", ~lit | (v["dt"] != p.datatype)))
        if p.node_kind:
            kinds = {"IRI": ["iri"], "BlankNode": ["bnode"], "Literal": ["lit"], "BlankNodeOrIRI": ["bnode", "iri"], "BlankNodeOrLiteral": ["bnode", "lit"], "IRIOrLiteral": ["iri", "lit"]}[p.node_kind]
            out.append(("nodeKind", ~v["kind"].isin(*kinds)))
        if p.pattern and not (self.compat and len(p.pattern) > MAX_PATTERN):
            out.append(("pattern", lit & ~F.rlike(text, F.lit(("(?i)" if "i" in p.flags else "") + p.pattern))))
        if p.min_length is not None:
            out.append(("minLength", lit & (F.length(text) < p.min_length) | (v["kind"] == "bnode")))
        if p.max_length is not None:
            out.append(("maxLength", lit & (F.length(text) > p.max_length) | (v["kind"] == "bnode")))
        if p.one_of:
            terms = [T.constant(t) for t in p.one_of]
            out.append(("in", ~v.isin(*terms)))
        if p.language_in is not None:
            out.append(("languageIn", ~lit | ~v["lang"].isin(*p.language_in)))
        if p.max_inclusive is not None:
            out.append(("maxInclusive", lit & (number > p.max_inclusive) if not node else ~lit | F.coalesce(number > p.max_inclusive, F.lit(True))))
        if p.min_inclusive is not None and not (self.compat and not node):
            out.append(("minInclusive", lit & (number < p.min_inclusive) if not node else ~lit | F.coalesce(number < p.min_inclusive, F.lit(True))))
        if p.min_exclusive is not None:
            out.append(("minExclusive", lit & (number <= p.min_exclusive)))
        if p.max_exclusive is not None:
            out.append(("maxExclusive", lit & (number >= p.max_exclusive)))
        return out

    def property_violations(self, focus: Focus, p: Property) -> DataFrame:
        null = F.lit(None).cast(T.TERM)
        parts = []
        tests = self._per_value(p, False)
        limit = {"maxInclusive": (">", p.max_inclusive), "minInclusive": ("<", p.min_inclusive), "minExclusive": ("<=", p.min_exclusive), "maxExclusive": (">=", p.max_exclusive)}
        # a single limit on numbers reaches the scan
        vals = focus.values(p.path, [("value", *limit[tests[0][0]])] if len(tests) == 1 and tests[0][0] in limit and not p.cls else ()) if tests or p.cls else None
        if tests:
            # one pass over the values for all of them
            failed = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())
            parts.append(vals.select("focus", F.explode(failed).alias("component"), "value"))
        if p.cls:
            bad = vals.join(self.instances(p.cls), "value", "left_anti")
            parts.append(bad.select("focus", F.lit("class").alias("component"), "value"))
        counted = [p.min_count is not None, p.max_count is not None, p.has_value is not None, p.qualified_min is not None]
        if any(counted):
            v = focus.with_optional(p.path)
            if p.qualified_class:
                v = v.join(self.instances(p.qualified_class).distinct().withColumn("_in", F.lit(True)), "value", "left")
            hit = F.col("value") == T.constant(p.has_value) if p.has_value else F.lit(None).cast("boolean")
            per = v.groupBy("focus").agg(F.count("value").alias("n"), F.count_if(hit).alias("hits"), F.count_if(F.col("_in")).alias("q") if p.qualified_class else F.lit(0).alias("q"))
            tests = []
            if p.min_count is not None:
                tests.append(("minCount", F.col("n") < p.min_count))
            if p.max_count is not None:
                tests.append(("maxCount", F.col("n") > p.max_count))
            if p.has_value is not None:
                tests.append(("hasValue", F.col("hits") == 0))
            if p.qualified_min is not None:
                tests.append(("qualifiedMinCount", F.col("q") < p.qualified_min))
            failed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())
            parts.append(per.select("focus", F.explode(failed).alias("component"), null.alias("value")))
        if not parts:
            return self.spark.createDataFrame([], f"focus {T.TERM}, path string, component string, value {T.TERM}")
        out = reduce(lambda a, b: a.unionByName(b), parts)
        return out.select("focus", F.lit(p.path).alias("path"), "component", "value")

    def node_violations(self, focus: Focus, p: Property) -> DataFrame:
        v = focus.frame().withColumn("value", F.col("focus"))
        tests = self._per_value(p, True)
        if p.has_value is not None:
            tests.append(("hasValue", F.col("value") != T.constant(p.has_value)))
        parts = []
        if tests:
            failed = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())
            parts.append(v.select("focus", F.explode(failed).alias("component"), "value"))
        if p.cls:
            parts.append(v.join(self.instances(p.cls), "value", "left_anti").select("focus", F.lit("class").alias("component"), "value"))
        if not parts:
            return self.spark.createDataFrame([], f"focus {T.TERM}, path string, component string, value {T.TERM}")
        return reduce(lambda a, b: a.unionByName(b), parts).select("focus", F.lit(None).cast("string").alias("path"), "component", "value")

    def violations(self, shape: Shape, focus: Focus, within: tuple = ()) -> DataFrame:
        """(focus, path, component, value, message) of a shape on given focus nodes; ``within`` names the shapes that refer to it."""
        if shape.name in within:
            raise ValueError(f"shape {shape.name} refers to itself")
        parts = [self.property_violations(focus, p).withColumn("message", F.lit(p.message).cast("string")) for p in shape.properties]
        if shape.node:
            parts.append(self.node_violations(focus, shape.node).withColumn("message", F.lit(shape.message).cast("string")))
        logical = [("and", shape.all_of), ("or", shape.any_of), ("xone", shape.one_of), ("not", shape.none_of)]
        for component, names in logical:
            if not names:
                continue
            # conformance matrix: how many of the named shapes each focus violates
            failing = [self.violations(self.shapes[n], focus, (*within, shape.name)).select("focus").distinct() for n in names if n in self.shapes]
            everyone = focus.frame()
            fails = reduce(lambda a, b: a.unionByName(b), failing) if failing else everyone.limit(0)
            per = everyone.join(fails.groupBy("focus").agg(F.count("*").alias("f")), "focus", "left").fillna(0, ["f"])
            total = len(names)
            bad = {"and": F.col("f") > 0, "or": F.col("f") == total, "xone": total - F.col("f") != 1, "not": F.col("f") < total}[component]
            parts.append(per.filter(bad).select("focus", F.lit(None).cast("string").alias("path"), F.lit(component).alias("component"), F.col("focus").alias("value"), F.lit(shape.message).cast("string").alias("message")))
        for text in shape.sparql:
            from . import sparql

            rows = sparql.run(self.graph, text.replace("$this", "?this"), terms=True)
            hit = focus.frame().join(rows.select(F.col("this").alias("focus")), "focus")
            parts.append(hit.select("focus", F.lit(None).cast("string").alias("path"), F.lit("sparql").alias("component"), F.col("focus").alias("value"), F.lit(shape.message).cast("string").alias("message")))
        if not parts:
            return self.spark.createDataFrame([], f"focus {T.TERM}, path string, component string, value {T.TERM}, message string")
        return reduce(lambda a, b: a.unionByName(b), parts)

    def report(self) -> DataFrame:
        """All violations of all shapes with targets, in the columns of RESULT."""
        parts = []
        for s in self.order:
            if s.target_classes or s.target_nodes:
                v = self.violations(s, self.targets(s))
                text = F.coalesce("message", F.concat(F.lit("value does not meet "), F.col("component")))
                parts.append(v.select(F.lit(s.name).alias("shape"), "focus", "path", "component", "value", text.alias("message"), F.lit(s.severity).alias("severity")))
        if not parts:
            return self.spark.createDataFrame([], RESULT)
        return reduce(lambda a, b: a.unionByName(b), parts)


def validate(graph, shapes: list[Shape], compat: bool = False) -> DataFrame:
    return Validator(graph, shapes, compat).report()


def conforms(report: DataFrame) -> DataFrame:
    """One row: whether no result has severity violation, and the counts by severity."""
    n = lambda level: F.count_if(F.col("severity") == level)
    return report.agg((n("violation") == 0).alias("conforms"), F.count("*").alias("results"), n("violation").alias("violations"), n("warning").alias("warnings"), n("info").alias("infos"))


def read_shapes(triples: list[tuple]) -> list[Shape]:
    """Shapes from parsed statements (s, p, o) of the parser's terms; unknown components are left out, malformed counts raise."""
    by_s: dict[tuple, dict[str, list]] = {}
    for s, p, o in triples:
        by_s.setdefault(s, {}).setdefault(p[1], []).append(o)
    sh = lambda x: T.SH + x

    def items(node) -> list:
        out, seen = [], set()
        while node and node != ("iri", T.RDF + "nil"):
            if node in seen:
                raise ValueError(f"the list at {node[1]} leads back to itself")
            seen.add(node)
            d = by_s.get(node, {})
            out += d.get(T.RDF + "first", [])
            node = (d.get(T.RDF + "rest") or [None])[0]
        return out

    def first(d, name):
        return (d.get(sh(name)) or [None])[0]

    def number(d, name, kind=float):
        t = first(d, name)
        return kind(t[1]) if t else None

    def constraints(d, path: str) -> Property:
        qualified = by_s.get(first(d, "qualifiedValueShape"), {})
        kind = first(d, "nodeKind")
        name = lambda x: first(d, x)[1] if first(d, x) else None
        return Property(
            path, number(d, "minCount", int), number(d, "maxCount", int), name("datatype"), name("class"), kind[1].rpartition("#")[2] if kind else None, name("pattern"), name("flags") or "", number(d, "minLength", int), number(d, "maxLength", int),
            items(first(d, "in")) if first(d, "in") else None, first(d, "hasValue"), number(d, "minInclusive"), number(d, "maxInclusive"), number(d, "minExclusive"), number(d, "maxExclusive"),
            [x[1] for x in items(first(d, "languageIn"))] if first(d, "languageIn") else None, first(qualified, "class")[1] if first(qualified, "class") else None, number(d, "qualifiedMinCount", int), name("message"),
        )

    shapes = []
    referred = {o for _, p, o in triples if p[1] in (sh("property"),)}
    roots = [s for s, d in by_s.items() if ("iri", sh("NodeShape")) in d.get(T.RDF_TYPE, []) or sh("targetClass") in d or sh("targetNode") in d]
    members = {x for d in by_s.values() for k in ("and", "or", "xone") for o in d.get(sh(k), []) for x in items(o)} | {o for d in by_s.values() for o in d.get(sh("not"), [])}
    for s in dict.fromkeys([*roots, *sorted(members)]):
        if s in referred:
            continue
        d = by_s.get(s, {})
        own = constraints(d, "")
        implicit = [s[1]] if ("iri", T.RDFS + "Class") in d.get(T.RDF_TYPE, []) else []
        shapes.append(Shape(
            s[1], [o[1] for o in d.get(sh("targetClass"), [])] + implicit, d.get(sh("targetNode"), []), [constraints(by_s.get(o, {}), by_s[o][sh("path")][0][1]) for o in d.get(sh("property"), []) if sh("path") in by_s.get(o, {})],
            own if any(v not in (None, "", []) for k, v in own.__dict__.items() if k not in ("path", "message")) else None, [x[1] for o in d.get(sh("and"), []) for x in items(o)], [x[1] for o in d.get(sh("or"), []) for x in items(o)],
            [x[1] for o in d.get(sh("xone"), []) for x in items(o)], [o[1] for o in d.get(sh("not"), [])], [x[1] for o in d.get(sh("sparql"), []) for x in by_s.get(o, {}).get(sh("select"), [])],
            (first(d, "severity") or ("iri", "#Violation"))[1].rpartition("#")[2].lower(), first(d, "message")[1] if first(d, "message") else None,
        ))
    return shapes
