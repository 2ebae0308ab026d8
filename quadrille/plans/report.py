"""Validation reports as statements and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T


def to_statements(report: DataFrame, name: str = T.DATA + "report") -> DataFrame:
    """(g, s, p, o): a report node with its verdict, and a node per result named by the hash of its content."""
    lit = lambda c: T.literal(F.col(c))
    node = T.bnode(F.concat(F.lit("r"), F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in report.columns])), 256), 1, 24)))
    component = F.concat(F.lit(T.SH), F.upper(F.substring("component", 1, 1)), F.substr("component", F.lit(2)), F.lit("ConstraintComponent"))
    pairs = [
        (T.RDF_TYPE, T.constant(("iri", T.SH + "ValidationResult"))), (T.SH + "focusNode", F.col("focus")), (T.SH + "resultPath", T.iri(F.col("path"))), (T.SH + "value", F.col("value")), (T.SH + "sourceShape", T.iri(F.col("shape"))),
        (T.SH + "sourceConstraintComponent", T.iri(component)), (T.SH + "resultMessage", lit("message")), (T.SH + "resultSeverity", T.iri(F.concat(F.lit(T.SH), F.initcap("severity")))),
    ]
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs])
    results = report.select(node.alias("s"), F.explode(rows).alias("t")).select(F.lit("").alias("g"), "s", "t.p", "t.o").filter(F.col("o").isNotNull())
    root = T.constant(("iri", name))
    links = report.select(F.lit("").alias("g"), root.alias("s"), F.lit(T.SH + "result").alias("p"), node.alias("o"))
    verdict = report.agg((F.count_if(F.col("severity") == "violation") == 0).alias("c")).select(F.lit("").alias("g"), root.alias("s"), F.lit(T.SH + "conforms").alias("p"), T.literal(F.col("c").cast("string"), T.XSD + "boolean").alias("o"))
    return results.union(links).union(verdict).distinct()


def from_statements(quads: DataFrame) -> DataFrame:
    """The report's rows again, one pivot by result node."""
    kind = quads.filter((F.col("p") == T.RDF_TYPE) & (F.col("o.value") == T.SH + "ValidationResult")).select("s")
    q = quads.join(kind, "s", "left_semi")
    pick = lambda p: F.max(F.when(F.col("p") == T.SH + p, F.col("o")))
    g = q.groupBy("s").agg(pick("sourceShape").alias("shape"), pick("focusNode").alias("focus"), pick("resultPath").alias("path"), pick("sourceConstraintComponent").alias("c"), pick("value").alias("value"), pick("resultMessage").alias("m"), pick("resultSeverity").alias("v"))
    comp = F.regexp_extract("c.value", r"#(.*)ConstraintComponent$", 1)
    out = g.select(F.col("shape.value").alias("shape"), "focus", F.col("path.value").alias("path"), F.concat(F.lower(F.substring(comp, 1, 1)), F.substr(comp, F.lit(2))).alias("component"), "value", F.col("m.value").alias("message"), F.lower(F.regexp_extract("v.value", r"#(.*)$", 1)).alias("severity"))
    return out
