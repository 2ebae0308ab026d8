import pytest

from quadrille.operators.graph import QuadGraph
from quadrille.plans import report, shacl
from quadrille.sources import rdf_json_xml as J
from quadrille.sources import turtle

TTL = '@prefix ex: <http://e/> . ex:a a ex:P ; ex:n "x"@en ; ex:k ex:b ; ex:i 5 .'
LD = '{"@context": {"ex": "http://e/", "k": {"@id": "ex:k", "@type": "@id"}}, "@id": "ex:a", "@type": "ex:P", "ex:n": {"@value": "x", "@language": "EN"}, "k": "ex:b", "ex:i": 5, "ex:none": null}'
XML = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://e/"><ex:P rdf:about="http://e/a"><ex:n xml:lang="en">x</ex:n><ex:k rdf:resource="http://e/b"/><ex:i rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</ex:i></ex:P></rdf:RDF>'


def test_three_forms_of_one_graph():
    assert set(turtle.parse(TTL)) == set(J.from_json_ld(LD)) == set(J.from_rdf_xml(XML))


def test_nested_and_lists():
    ld = J.from_json_ld('[{"@id": "http://e/a", "http://e/l": [{"@list": [1, true]}], "http://e/o": [{"http://e/p": 1.5}]}]')
    assert len(ld) == 7
    xml = J.from_rdf_xml('<ex:A xmlns:ex="http://e/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><ex:l rdf:parseType="Collection"><ex:B/><ex:C/></ex:l><ex:m rdf:parseType="Resource"><ex:q>1</ex:q></ex:m></ex:A>')
    assert len(xml) == 10


@pytest.mark.parametrize("f,bad", [(J.from_json_ld, "{"), (J.from_json_ld, "[1]"), (J.from_rdf_xml, "<a>"), (J.from_rdf_xml, "")])
def test_errors(f, bad):
    with pytest.raises(J.FormatError):
        f(bad)


def test_report_round_trip(spark):
    g = QuadGraph(turtle.from_text(spark, TTL))
    shapes = [shacl.Shape("http://e/S", ["http://e/P"], properties=[shacl.Property("http://e/i", max_inclusive=1, datatype="http://www.w3.org/2001/XMLSchema#string"), shacl.Property("http://e/z", min_count=1)])]
    r = shacl.validate(g.quads, shapes)
    back = report.from_statements(report.to_statements(r))
    key = lambda df: sorted(str(tuple(x[c] for c in ("shape", "focus", "path", "component", "value", "message", "severity"))) for x in df.collect())
    assert key(back) == key(r) and len(key(r)) == 3
    assert report.to_statements(r.limit(0)).count() == 1
