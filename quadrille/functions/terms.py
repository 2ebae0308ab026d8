"""Graph terms: ``struct<kind, value, dt, lang>`` with kind iri, bnode or lit.

Term equality is of all four parts, never of numeric value; ``dt`` and ``lang`` are empty, not null, where they do not apply, so that terms can be
join keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "struct<kind: string, value: string, dt: string, lang: string>"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
PROV = "http://www.w3.org/ns/prov#"
RDF_TYPE, LANG_STRING = RDF + "type", RDF + "langString"
#: Vocabularies of code, structure, processes and evolution, under this library's own address.
ONT = "https://quadrille.example/ontology/"
CORE, STRUCT, OTP, EVO = ONT + "core#", ONT + "structure#", ONT + "otp#", ONT + "evolution#"
DATA = "https://quadrille.example/data#"
PREFIXES = {"xsd": XSD, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "sh": SH, "prov": PROV, "core": CORE, "struct": STRUCT, "otp": OTP, "evo": EVO, "": DATA}
NUMERIC = tuple(XSD + x for x in "integer decimal double float int long short byte nonNegativeInteger positiveInteger unsignedInt unsignedLong negativeInteger nonPositiveInteger".split())
#: XSD type of a Spark type.
SPARK_TO_XSD = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "string": "string"}


def _struct(kind: str, value: Column, dt: str | Column = "", lang: str | Column = "") -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), as_col(dt).alias("dt"), as_col(lang).alias("lang"))


def iri(value: Column) -> Column:
    return F.when(value.isNotNull(), _struct("iri", value))


def bnode(value: Column) -> Column:
    return F.when(value.isNotNull(), _struct("bnode", value))


def literal(value: Column, dt: str | Column = XSD + "string", lang: str | Column = "") -> Column:
    """Literal of a lexical form; null for a null form."""
    return F.when(value.isNotNull(), _struct("lit", value, dt, lang))


def python_term(t: tuple) -> tuple[str, str, str, str]:
    """Term of the parser, ("iri", value) or ("lit", value, datatype, language), as a row."""
    return ("lit", *t[1:]) if t[0] == "lit" else (t[0], t[1], "", "")


def constant(t: tuple) -> Column:
    k, v, dt, lang = python_term(t)
    return _struct(k, F.lit(v), dt, lang)


def is_numeric(term: Column) -> Column:
    return (term["kind"] == "lit") & term["dt"].isin(*NUMERIC)


def lexical(c: Column, spark_type: str) -> Column:
    """Lexical form of a typed column."""
    if spark_type.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.cast("string")


def typed(c: Column, spark_type: str) -> Column:
    """Literal of a typed column, in the datatype that its Spark type stands for."""
    base = spark_type.partition("(")[0]
    return literal(lexical(c, base), XSD + ("decimal" if base == "decimal" else SPARK_TO_XSD.get(base, "string")))


