import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators.graph import QuadGraph, materialise, reachable
from quadrille.plans import shacl, sparql
from quadrille.sources import turtle

DATA = """
@prefix ex: <http://e/> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
ex:a a ex:Person ; ex:name "Ann" ; ex:age 31 ; ex:knows ex:b, ex:c .
ex:b a ex:Person ; ex:name "Bob"@en ; ex:age "x" ; ex:knows ex:c .
ex:c a ex:Robot ; ex:name "Cyd", "Cid" ; ex:age 1.5 .
ex:d ex:parts ( 1 2 ) .
"""


@pytest.fixture(scope="module")
def graph(spark):
    return QuadGraph(turtle.from_text(spark, DATA).cache())


def ask(graph, text):
    return sorted((tuple(r) for r in sparql.run(graph, "PREFIX ex: <http://e/> " + text).collect()), key=str)


@pytest.mark.parametrize(
    "text,rows",
    [
        ("SELECT ?n WHERE { ?x a ex:Person ; ex:name ?n }", [("Ann",), ("Bob",)]),
        ("SELECT ?n WHERE { ?x ex:name ?n ; ex:age ?a . FILTER(?a > 1) }", [("Ann",), ("Cid",), ("Cyd",)]),
        ("SELECT ?x (COUNT(?k) AS ?n) WHERE { ?x a ex:Person OPTIONAL { ?x ex:knows ?k } } GROUP BY ?x HAVING (COUNT(?k) > 1)", [("http://e/a", 2)]),
        ("SELECT ?x WHERE { ?x ex:age ?a FILTER NOT EXISTS { ?x ex:knows ?k } }", [("http://e/c",)]),
        ("SELECT ?x WHERE { { ?x a ex:Robot } UNION { ?x ex:knows ex:b } }", [("http://e/a",), ("http://e/c",)]),
        ("SELECT ?n ?k WHERE { ?x ex:name ?n OPTIONAL { ?x ex:knows ?k . ?k a ex:Robot } }", [("Ann", "http://e/c"), ("Bob", "http://e/c"), ("Cid", None), ("Cyd", None)]),
        ("SELECT (LANG(?n) AS ?l) WHERE { ex:b ex:name ?n }", [("en",)]),
        ('SELECT ?x WHERE { ?x ex:name "Bob" }', []),
        ('SELECT ?x WHERE { ?x ex:name "Bob"@en }', [("http://e/b",)]),
        ("SELECT DISTINCT ?y WHERE { ex:a ex:knows+ ?y }", [("http://e/b",), ("http://e/c",)]),
        ("SELECT ?n WHERE { ex:a ex:knows/ex:name ?n }", [("Bob",), ("Cid",), ("Cyd",)]),
        ("SELECT ?x WHERE { ?x ^ex:knows ex:b }", [("http://e/c",)]),
        ("SELECT ?v WHERE { VALUES ?v { 1 2 } FILTER(?v != 1) }", [("2",)]),
        ("SELECT ?n WHERE { ?x ex:name ?n } ORDER BY DESC(?n) LIMIT 2", [("Cid",), ("Cyd",)]),
        ("SELECT (IF(BOUND(?k), \"y\", \"n\") AS ?r) WHERE { ?x a ex:Robot OPTIONAL { ?x ex:knows ?k } }", [("n",)]),
        ("SELECT (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?all) WHERE { ex:c ex:name ?n }", [("Cid|Cyd",)]),
        ("SELECT ?p (COUNT(*) AS ?n) WHERE { ex:c ?p ?o } GROUP BY ?p ORDER BY ?n", [("http://e/age", 1), ("http://e/name", 2), (T.RDF_TYPE, 1)]),
    ],
)
def test_queries(graph, text, rows):
    assert ask(graph, text) == sorted(rows, key=str)


def test_forms(graph):
    assert sparql.run(graph, "ASK { ?x a <http://e/Robot> }") is True
    assert sparql.run(graph, "ASK { ?x a <http://e/None> }") is False
    out = sparql.run(graph, "CONSTRUCT { ?y <http://e/knownBy> ?x } WHERE { ?x <http://e/knows> ?y }")
    assert {(r.s.value, r.o.value) for r in out.collect()} == {("http://e/b", "http://e/a"), ("http://e/c", "http://e/a"), ("http://e/c", "http://e/b")}
    assert sparql.run(graph, "DESCRIBE <http://e/d>").count() == 1
    assert sparql.run(graph, "DESCRIBE <http://e/nobody>").count() == 0
    for bad in ("SELECT", "SELECT ?x WHERE { ?x", "FETCH ?x", "SELECT ?x WHERE { ?x nope:y ?z }", "SELECT ?a WHERE { ?a <x:p> ?b . ?c <x:q> ?d }"):
        with pytest.raises(sparql.QueryError):
            sparql.run(graph, bad)


def test_set_operations(spark, graph):
    n = graph.quads.count()
    assert graph.merge(graph.quads, graph.quads).quads.count() == n
    assert graph.add(turtle.from_text(spark, "<http://e/z> <http://e/p> 1 .")).quads.count() == n + 1
    empty = QuadGraph(graph.quads.limit(0))
    assert empty.subjects().count() == 0 and sparql.run(empty, "SELECT ?x WHERE { ?x <http://e/p> ?y }").count() == 0
    assert graph.in_namespace("http://e/a").count() == 5


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (1, 2)], "a bigint, b bigint")
    got = {(r.a, r.b) for r in reachable(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)} | {(5, 5)}
    assert reachable(edges.limit(0)).count() == 0


def test_inference(spark):
    g = QuadGraph(turtle.from_text(spark, """@prefix ex: <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
ex:A rdfs:subClassOf ex:B . ex:B rdfs:subClassOf ex:C . ex:p rdfs:subPropertyOf ex:q . ex:q rdfs:domain ex:A . ex:q owl:inverseOf ex:r . ex:t a owl:TransitiveProperty .
ex:x ex:p ex:y . ex:y ex:t ex:z . ex:z ex:t ex:w ."""))
    got = {(r.s.value[9:], r.p.split("/")[-1], r.o.value[9:]) for r in materialise(g, "owl").quads.filter(F.col("s.value").rlike("^http://e/[xyzw]$")).collect()}
    assert {("x", "q", "y"), ("y", "r", "x"), ("y", "t", "w")} <= got
    assert {o for s, p, o in got if s == "x" and "type" in p} == {"A", "B", "C"}


SHAPES = """
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:S a sh:NodeShape ; sh:targetClass ex:Person ; sh:property [ sh:path ex:name ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:message "one name" ] , [ sh:path ex:age ; sh:maxInclusive 30 ; sh:in ( 31 1.5 ) ] , [ sh:path ex:knows ; sh:class ex:Robot ] .
ex:N a sh:NodeShape ; sh:targetNode ex:nobody ; sh:property [ sh:path ex:name ; sh:minCount 1 ] .
"""


def test_constraints(spark, graph):
    shapes = shacl.read_shapes(turtle.parse(SHAPES))
    assert [s.name for s in shapes] == ["http://e/S", "http://e/N"]
    got = {(r.focus.value[9:], r.component, r.value and r.value.value, r.message) for r in shacl.validate(graph.quads, shapes).collect()}
    assert {x[:3] for x in got} == {("b", "datatype", "Bob"), ("a", "maxInclusive", "31"), ("b", "in", "x"), ("a", "class", "http://e/b"), ("nobody", "minCount", None)}
    assert ("b", "datatype", "Bob", "one name") in got
    assert shacl.conforms(shacl.validate(graph.quads, [])).first().conforms
    assert shacl.validate(graph.quads.limit(0), shapes).count() == 1  # a named target needs no presence in the data


def test_logic(spark, graph):
    P, S = shacl.Property, shacl.Shape
    a, b = S("a", properties=[P("http://e/knows", min_count=1)]), S("b", properties=[P("http://e/name", max_count=1)])
    cls = ["http://e/Person", "http://e/Robot"]
    for kw, want in (("all_of", {"c"}), ("any_of", {"c"}), ("one_of", {"a", "b", "c"}), ("none_of", {"a", "b"})):
        got = {r.focus.value[9:] for r in shacl.validate(graph.quads, [S("s", cls, **{kw: ["a", "b"]}), a, b]).collect()}
        assert got == want, kw


def test_turtle_round_trip(spark, graph, tmp_path):
    turtle.write_ntriples(graph.quads, str(tmp_path / "nt"))
    back = turtle.read_ntriples(spark, str(tmp_path / "nt"))
    key = lambda df: sorted(str((tuple(r.s), r.p, tuple(r.o))) for r in df.select("s", "p", "o").collect())
    assert key(back) == key(graph.quads)
    turtle.write_turtle(graph.quads, str(tmp_path / "ttl"), {"ex": "http://e/"})
    quads, files = turtle.load_files(spark, str(tmp_path / "ttl"))
    assert quads.count() == graph.quads.count() and files.filter("error is not null").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.ttl").write_text("<a:b> <c:d> .")
    (tmp_path / "bad" / "y.ttl").write_text('@prefix e: <http://e/> .\ne:a e:b "é\\u00e9\\n", 2.5, true .')
    quads, files = turtle.load_files(spark, str(tmp_path / "bad"))
    assert quads.count() == 3 and {bool(r.error) for r in files.collect()} == {True, False}


@pytest.mark.parametrize("bad", ["<a:b> .", "<a:b> <c:d> e:f .", '"x" <a:b> <c:d> .', "<a:b> <c:d> ( 1 .", "<a:b> <c:d> 1"])
def test_bad_turtle(bad):
    with pytest.raises(turtle.TurtleError):
        turtle.parse(bad)
