"""Plans that must hold at scale: bounds at the scan, one scan a constraint, joins by the tables' own keys."""

import re

import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators.graph import QuadGraph, mapped
from quadrille.plans import shacl, sparql
from quadrille.sources import turtle

D = T.DATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "tables,text,pushed",
    [
        (["customer"], "SELECT ?n ?b WHERE { ?c :c_name ?n ; :c_acctbal ?b FILTER(?b > 9000 && ?n = \"x\") }", ["GreaterThan(c_acctbal,9000.0)", "EqualTo(c_name,x)"]),
        (["part"], "SELECT ?s WHERE { ?p :p_size ?s FILTER(40 <= ?s) }", ["GreaterThanOrEqual(p_size,40)"]),
        (["customer", "orders"], "SELECT ?n ?t WHERE { ?c :c_name ?n OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t < 1000) } }", ["LessThan(o_totalprice,1000.0)"]),
        (["customer", "orders"], "SELECT ?n WHERE { ?c :c_name ?n FILTER NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t < 1000) } }", ["LessThan(o_totalprice,1000.0)"]),
    ],
)
def test_bounds_reach_the_scan(spark, sf, tables, text, pushed):
    p = plan(sparql.run(mapped(spark, sf, tables), text))
    for x in pushed:
        assert x in p


def test_a_bound_within_an_optional_part_does_not_drop_rows(spark, sf):
    g = mapped(spark, sf, ["customer", "orders"])
    assert sparql.run(g, "SELECT ?n ?t WHERE { ?c :c_name ?n OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t < 0) } }").count() == 150


def test_stars_join_by_the_keys_of_the_tables(spark, sf):
    df = sparql.run(mapped(spark, sf, ["orders", "customer", "nation"]), "SELECT ?n ?p WHERE { ?o :o_custkey ?c ; :o_totalprice ?p . ?c :c_nationkey ?k . ?k :n_name ?n }")
    joins = [x for x in plan(df).split("\n") if "Join" in x]
    assert len(joins) == 2 and not any("concat" in x or "struct" in x for x in joins)
    assert df.count() == 1500


@pytest.mark.parametrize("p,columns", [(shacl.Property(D + "o_totalprice", max_inclusive=10.0), "o_orderkey:bigint,o_totalprice:double"), (shacl.Property(D + "o_orderstatus", min_count=1, has_value=("lit", "F", T.XSD + "string", "")), "o_orderkey:bigint,o_orderstatus:string")])
def test_a_constraint_is_one_scan_of_its_columns(spark, sf, p, columns):
    text = plan(shacl.validate(mapped(spark, sf, ["orders"]), [shacl.Shape("s", [D + "Order"], properties=[p])]))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == [columns]
    assert "Join" not in text and ("GreaterThan(o_totalprice,10.0)" in text or p.min_count)


def test_constant_subject_pairs_all_values(spark):
    g = QuadGraph(turtle.from_text(spark, "@prefix : <https://quadrille.example/data#> . :x :p 1, 2 ; :q 3, 4 ; :r 5 . :y :p 9 ."))
    run = lambda q: sorted(tuple(r) for r in sparql.run(g, q).collect())
    assert run("SELECT ?a ?b WHERE { :x :p ?a ; :q ?b }") == [("1", "3"), ("1", "4"), ("2", "3"), ("2", "4")]
    assert run("SELECT ?a WHERE { :x :r 5 ; :p ?a }") == [("1",), ("2",)]
    assert run("SELECT ?a WHERE { :x :r 6 ; :p ?a }") == []
    assert run("SELECT ?s ?a WHERE { ?s :q 3 ; :p ?a ; :q 4 }") == [("https://quadrille.example/data#x", "1"), ("https://quadrille.example/data#x", "2")]
    assert sparql.run(g, "ASK { :x :r 5 ; :q 3 }") and not sparql.run(g, "ASK { :x :r 5 ; :q 5 }")


def test_long_lists_and_circles_of_shapes(spark):
    members = " ".join(str(i) for i in range(150))
    shapes = shacl.read_shapes(turtle.parse(f"@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:in ( {members} ) ] ."))
    g = turtle.from_text(spark, "@prefix e: <http://e/> . e:a a e:C ; e:p 149, 150 .")
    assert [r.value.value for r in shacl.validate(g, shapes).collect()] == ["150"]
    deep = [shacl.Shape(f"n{i}", ["http://e/C"] if not i else [], all_of=[f"n{i + 1}"]) for i in range(6)] + [shacl.Shape("n6", properties=[shacl.Property("http://e/p", max_count=1)])]
    assert {r.shape for r in shacl.validate(g, deep).collect()} == {"n0"}
    with pytest.raises(ValueError):
        shacl.validate(g, [shacl.Shape("a", ["http://e/C"], all_of=["b"]), shacl.Shape("b", all_of=["a"])])
    with pytest.raises(ValueError):
        shacl.read_shapes(turtle.parse("@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix e: <http://e/> . e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:in e:l ] . e:l rdf:first 1 ; rdf:rest e:l ."))


def test_ntriples_escapes(spark, tmp_path):
    lines = [r'<http://e/a> <http://e/p> "a\\nb" .', r'<http://e/b> <http://e/p> "caf\u00E9 \U0001F600" .', r'<http://e/c> <http://e/p> "t\tn\nq\"s\\" .', r'<http://e/d> <http://e/p> "" .']
    (tmp_path / "x.nt").write_text("\n".join(lines))
    q = turtle.read_ntriples(spark, str(tmp_path / "x.nt"))
    want = {"a": "a\\nb", "b": "caf\u00e9 \U0001f600", "c": 't\tn\nq"s\\', "d": ""}
    assert {r.s.value[-1]: r.o.value for r in q.collect()} == want
    turtle.write_ntriples(q, str(tmp_path / "out"))
    again = turtle.read_ntriples(spark, str(tmp_path / "out"))
    assert {r.s.value[-1]: r.o.value for r in again.collect()} == want
    assert again.filter(F.col("o.dt") != T.XSD + "string").count() == 0
