"""Queries over the driver's tables, each with its equivalent in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sample
from .functions import scalars as S
from .functions import terms as T
from .operators import facts, provenance, rollups
from .operators.graph import QuadGraph, mapped, materialise, reachable
from .plans import shacl, sparql
from .session import shared_folder, stored, table
from .streaming.history import neighbours
from .streaming.ledger import SnapshotIndex

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
D = T.DATA


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _sparql(name: str, tables: list[str], text: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return sparql.run(mapped(spark, folder, tables), text)


def iri_sql(tab: str, key: str) -> str:
    return f"'{D}{tab}/' || {key}"


# --- query language ------------------------------------------------------------------------------------------------------------------------------

_sparql("orders_per_nation", ["orders", "customer", "nation"], "SELECT ?nation (COUNT(?o) AS ?orders) WHERE { ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_name ?nation } GROUP BY ?nation ORDER BY DESC(?orders) ?nation", "SELECT n_name AS nation, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_sparql("bgp_star", ["customer"], "SELECT ?name ?balance ?segment WHERE { ?c a :Customer ; :c_name ?name ; :c_acctbal ?balance ; :c_mktsegment ?segment . FILTER(?balance > 9000) }", "SELECT c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance, c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000")
_sparql("bgp_chain", ["customer", "nation", "region"], "SELECT ?c ?region WHERE { ?c :c_nationkey ?n . ?n :n_regionkey ?r . ?r :r_name ?region }", f"SELECT {iri_sql('customer', 'c_custkey')} AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_sparql(
    "dependency_matrix", ["orders", "lineitem", "customer", "supplier"],
    "SELECT ?from ?to (COUNT(*) AS ?n) WHERE { ?l :l_orderkey ?o ; :l_suppkey ?s . ?o :o_custkey ?c . ?c :c_nationkey ?from . ?s :s_nationkey ?to . FILTER(?from != ?to) } GROUP BY ?from ?to",
    f"SELECT {iri_sql('nation', 'c_nationkey')} AS \"from\", {iri_sql('nation', 's_nationkey')} AS \"to\", count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2",
)
_sparql("optional_join", ["customer", "orders"], "SELECT ?name ?status WHERE { ?c :c_name ?name . OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus ?status . FILTER(?status = \"P\") } }", "SELECT c_name AS name, o_orderstatus AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
_sparql("not_exists_anti", ["customer", "orders"], "SELECT ?name WHERE { ?c :c_name ?name . FILTER NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p . FILTER(?p > 400000) } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_sparql("exists_semi", ["customer", "orders"], "SELECT ?name WHERE { ?c :c_name ?name . FILTER EXISTS { ?o :o_custkey ?c ; :o_orderstatus \"F\" } }", "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_sparql("sparql_minus", ["customer"], "SELECT ?c WHERE { ?c a :Customer MINUS { ?c :c_mktsegment \"BUILDING\" } }", f"SELECT {iri_sql('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
_sparql("sparql_union", ["customer", "supplier"], "SELECT ?name WHERE { { ?x :c_name ?name } UNION { ?x :s_name ?name } }", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
_sparql("sparql_values", ["nation"], "SELECT ?name WHERE { VALUES ?name { \"NATION_1\" \"NATION_2\" \"FRANCE\" \"GERMANY\" } ?n :n_name ?name }", "SELECT n_name AS name FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'FRANCE', 'GERMANY')")
_sparql("sparql_bind", ["part"], "SELECT ?brand ?big WHERE { ?p :p_brand ?brand ; :p_size ?size . BIND(?size * 2 AS ?big) FILTER(?big > 90) }", "SELECT p_brand AS brand, CAST(CAST(p_size * 2 AS DOUBLE) AS VARCHAR) AS big FROM part WHERE p_size * 2 > 90")
_sparql("sparql_distinct_order_limit", ["part"], "SELECT DISTINCT ?brand WHERE { ?p :p_brand ?brand } ORDER BY DESC(?brand) LIMIT 5 OFFSET 2", "SELECT DISTINCT p_brand AS brand FROM part ORDER BY 1 DESC LIMIT 5 OFFSET 2")
_sparql("sparql_strings", ["part"], "SELECT ?t (STRLEN(?t) AS ?len) WHERE { ?p :p_type ?t ; :p_name ?n . FILTER(CONTAINS(?t, \"A\") && STRSTARTS(STR(?p), \"https\") && REGEX(?n, \"a\", \"i\") && ?t NOT IN (\"X\", \"Y\")) }", "SELECT p_type AS t, length(p_type) AS len FROM part WHERE contains(p_type, 'A') AND regexp_matches(p_name, '(?i)a')")
_sparql("having_groups", ["lineitem"], "SELECT ?f (COUNT(*) AS ?n) (SUM(?q) AS ?total) WHERE { ?l :l_returnflag ?f ; :l_quantity ?q } GROUP BY ?f HAVING (COUNT(*) > 10)", "SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1 HAVING count(*) > 10")
_sparql(
    "subselect_count_join", ["orders", "lineitem"], "SELECT ?o ?n WHERE { { SELECT ?o (COUNT(?l) AS ?n) WHERE { ?l :l_orderkey ?o } GROUP BY ?o } ?o :o_orderstatus \"P\" . FILTER(?n != 4) }",
    f"SELECT {iri_sql('orders', 'o_orderkey')} AS o, CAST(n AS VARCHAR) AS n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND n <> 4",
)
_sparql("count_by_type", ["region", "nation", "customer", "supplier", "part", "orders"], "SELECT ?type (COUNT(?x) AS ?n) WHERE { ?x a ?type } GROUP BY ?type ORDER BY DESC(?n)", " UNION ALL ".join(f"SELECT '{D}{c}' AS type, count(*) AS n FROM {t}" for c, t in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"))))
_sparql("four_stats", ["orders"], "SELECT (COUNT(*) AS ?orders) (COUNT(DISTINCT ?c) AS ?customers) (MIN(?p) AS ?least) (MAX(?p) AS ?most) (AVG(?p) AS ?mean) WHERE { ?o :o_custkey ?c ; :o_totalprice ?p }", "SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(min(o_totalprice) AS VARCHAR) AS least, CAST(max(o_totalprice) AS VARCHAR) AS most, avg(o_totalprice) AS mean FROM orders")
_sparql("path_sequence", ["customer", "nation", "region"], "SELECT ?region (COUNT(?c) AS ?n) WHERE { ?c :c_nationkey/:n_regionkey/:r_name ?region } GROUP BY ?region", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")


@query("construct_links", f"SELECT DISTINCT {iri_sql('nation', 'n_nationkey')} AS s, '{D}inRegion' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def construct_links(spark, folder):
    out = sparql.run(mapped(spark, folder, ["nation", "region"]), "CONSTRUCT { ?n :inRegion ?name } WHERE { ?n :n_regionkey ?r . ?r :r_name ?name }")
    return out.select(F.col("s.value").alias("s"), "p", F.col("o.value").alias("o"))


@query("ask_exists", "SELECT EXISTS (SELECT 1 FROM nation WHERE n_name = 'NOWHERE') AS answer")
def ask_exists(spark, folder):
    answer = sparql.run(mapped(spark, folder, ["nation"]), 'ASK { ?n :n_name "NOWHERE" }')
    return spark.range(1).select(F.lit(answer).alias("answer"))


# --- graph ---------------------------------------------------------------------------------------------------------------------------------------


def _graph(spark, folder, tables) -> QuadGraph:
    return QuadGraph(mapped(spark, folder, tables).quads())


@query("graph_merge", "SELECT count(*) AS statements FROM (SELECT 1 FROM customer, range(6) UNION ALL SELECT 1 FROM supplier, range(5))")
def graph_merge(spark, folder):
    c = _graph(spark, folder, ["customer"])
    return c.merge(_graph(spark, folder, ["supplier"]).quads, c.quads).statement_count()


@query("subjects", f"SELECT {iri_sql('supplier', 's_suppkey')} AS s FROM supplier UNION SELECT {iri_sql('nation', 'n_nationkey')} FROM nation")
def subjects(spark, folder):
    return _graph(spark, folder, ["supplier", "nation"]).subjects().select(F.col("s.value").alias("s"))


@query("predicate_histogram", " UNION ALL ".join(f"SELECT '{D}{c}' AS p, count({c}) AS n FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + f" UNION ALL SELECT '{T.RDF_TYPE}', count(*) FROM orders")
def predicate_histogram(spark, folder):
    return _graph(spark, folder, ["orders"]).predicates()


@query("describe", f"SELECT '{D}c_name' AS p, c_name AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{D}c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{D}c_nationkey', {iri_sql('nation', 'c_nationkey')} FROM customer WHERE c_custkey = 7")
def describe(spark, folder):
    d = sparql.run(mapped(spark, folder, ["customer"]), "DESCRIBE :customer\\/7".replace("\\/", "/").replace(":customer/7", f"<{D}customer/7>"))
    return d.filter(F.col("p").isin(D + "c_name", D + "c_mktsegment", D + "c_nationkey")).select("p", F.col("o.value").alias("o"))


@query("closure", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM r")
def closure(spark, folder):
    n = table(spark, folder, "nation").filter("n_nationkey > 0")
    return reachable(n.select(F.col("n_nationkey").cast("bigint").alias("a"), F.expr("n_nationkey div 2").alias("b")))


@query("inference", f"SELECT {iri_sql('customer', 'c_custkey')} AS s FROM customer UNION SELECT {iri_sql('supplier', 's_suppkey')} FROM supplier")
def inference(spark, folder):
    g = _graph(spark, folder, ["customer", "supplier"])
    ax = [("", T.python_term(("iri", D + c)), T.RDFS + "subClassOf", T.python_term(("iri", D + p))) for c, p in (("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"))]
    full = materialise(g.add(spark.createDataFrame(ax, f"g string, s {T.TERM}, p string, o {T.TERM}")))
    return full.quads.filter((F.col("p") == T.RDF_TYPE) & (F.col("o.value") == D + "Agent")).select(F.col("s.value").alias("s"))


# --- constraints ---------------------------------------------------------------------------------------------------------------------------------


def _shacl(name: str, tables: list[str], shapes: list[shacl.Shape], sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        r = shacl.validate(mapped(spark, folder, tables), shapes)
        return r.select(F.col("focus.value").alias("focus"), "component", F.col("value.value").alias("value"))


P, Sh = shacl.Property, shacl.Shape
_cust = [D + "Customer"]
_foc = iri_sql("customer", "c_custkey")
_shacl("shacl_min_count", ["orders", "customer"], [Sh("s", _cust, properties=[P(D + "o_custkey", min_count=1)])], f"SELECT {_foc} AS focus, 'minCount' AS component, CAST(NULL AS VARCHAR) AS value FROM customer")
_shacl("shacl_max_count", ["customer"], [Sh("s", _cust, properties=[P(D + "c_name", max_count=0)])], f"SELECT {_foc} AS focus, 'maxCount' AS component, CAST(NULL AS VARCHAR) AS value FROM customer")
_shacl("shacl_datatype", ["customer"], [Sh("s", _cust, properties=[P(D + "c_acctbal", datatype=T.XSD + "integer"), P(D + "c_name", datatype=T.XSD + "string")])], f"SELECT {_foc} AS focus, 'datatype' AS component, CAST(c_acctbal AS VARCHAR) AS value FROM customer")
_shacl("shacl_class", ["customer", "nation"], [Sh("s", _cust, properties=[P(D + "c_nationkey", cls=D + "Region")])], f"SELECT {_foc} AS focus, 'class' AS component, {iri_sql('nation', 'c_nationkey')} AS value FROM customer")
_shacl("shacl_pattern", ["customer"], [Sh("s", _cust, properties=[P(D + "c_mktsegment", pattern="^B")])], f"SELECT {_foc} AS focus, 'pattern' AS component, c_mktsegment AS value FROM customer WHERE NOT regexp_matches(c_mktsegment, '^B')")
_shacl("shacl_in", ["orders"], [Sh("s", [D + "Order"], properties=[P(D + "o_orderstatus", one_of=[("lit", "F", T.XSD + "string", ""), ("lit", "O", T.XSD + "string", "")])])], f"SELECT {iri_sql('orders', 'o_orderkey')} AS focus, 'in' AS component, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
_shacl("shacl_has_value", ["orders"], [Sh("s", [D + "Order"], properties=[P(D + "o_orderstatus", has_value=("lit", "F", T.XSD + "string", ""))])], f"SELECT {iri_sql('orders', 'o_orderkey')} AS focus, 'hasValue' AS component, CAST(NULL AS VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'F'")
_shacl("shacl_max_inclusive", ["part"], [Sh("s", [D + "Part"], properties=[P(D + "p_size", max_inclusive=40)])], f"SELECT {iri_sql('part', 'p_partkey')} AS focus, 'maxInclusive' AS component, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size > 40")
_shacl("shacl_min_inclusive", ["part"], [Sh("s", [D + "Part"], properties=[P(D + "p_size", min_inclusive=10)])], f"SELECT {iri_sql('part', 'p_partkey')} AS focus, 'minInclusive' AS component, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size < 10")
_shacl("shacl_min_length", ["part"], [Sh("s", [D + "Part"], properties=[P(D + "p_type", min_length=8)])], f"SELECT {iri_sql('part', 'p_partkey')} AS focus, 'minLength' AS component, p_type AS value FROM part WHERE length(p_type) < 8")
_shacl("shacl_node_kind", ["customer"], [Sh("s", _cust, properties=[P(D + "c_nationkey", node_kind="Literal")])], f"SELECT {_foc} AS focus, 'nodeKind' AS component, {iri_sql('nation', 'c_nationkey')} AS value FROM customer")
_shacl("shacl_qualified", ["customer", "nation"], [Sh("s", _cust, properties=[P(D + "c_nationkey", qualified_class=D + "Nation", qualified_min=2)])], f"SELECT {_foc} AS focus, 'qualifiedMinCount' AS component, CAST(NULL AS VARCHAR) AS value FROM customer")
_part_a, _part_b = Sh("a", properties=[P(D + "p_size", max_inclusive=25)]), Sh("b", properties=[P(D + "p_retailprice", max_inclusive=950)])
_pf = iri_sql("part", "p_partkey")
for _name, _kw, _cond in (("and", "all_of", "p_size > 25 OR p_retailprice > 950"), ("or", "any_of", "p_size > 25 AND p_retailprice > 950"), ("xone", "one_of", "(p_size > 25) = (p_retailprice > 950)"), ("not", "none_of", "p_size <= 25 OR p_retailprice <= 950")):
    _shacl(f"shacl_{_name}", ["part"], [Sh("s", [D + "Part"], **{_kw: ["a", "b"]}), _part_a, _part_b], f"SELECT {_pf} AS focus, '{_name}' AS component, {_pf} AS value FROM part WHERE {_cond}")
_shacl("shacl_sparql", ["orders"], [Sh("s", [D + "Order"], sparql=["SELECT $this WHERE { $this :o_totalprice ?p . FILTER(?p > 300000) }"])], f"SELECT {iri_sql('orders', 'o_orderkey')} AS focus, 'sparql' AS component, {iri_sql('orders', 'o_orderkey')} AS value FROM orders WHERE o_totalprice > 300000")


@query("shacl_report", "SELECT count(*) FILTER (p_size > 45) = 0 AS conforms, count(*) FILTER (p_size > 45) + count(*) FILTER (p_retailprice > 950) AS results, count(*) FILTER (p_size > 45) AS violations, count(*) FILTER (p_retailprice > 950) AS warnings, 0 AS infos FROM part")
def shacl_report(spark, folder):
    shapes = [Sh("s", [D + "Part"], properties=[P(D + "p_size", max_inclusive=45, min_count=1)]), Sh("w", [D + "Part"], properties=[P(D + "p_retailprice", max_inclusive=950)], severity="warning")]
    return shacl.conforms(shacl.validate(mapped(spark, folder, ["part"]), shapes))


# --- scalars -------------------------------------------------------------------------------------------------------------------------------------


@query("iri_build", "SELECT p_partkey, 'base#' || replace(url_encode(p_name), '~', '%7E') || '/fun/' || p_size AS iri FROM part")
def iri_build(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.concat(S.iri_module(F.lit("base#"), F.col("p_name")), F.lit("/fun/"), F.col("p_size").cast("string")).alias("iri"))


_MOD = "replace(url_encode(p_name), '~', '%7E')"
_FUN = f"'b#' || {_MOD} || '/' || lower(p_brand) || '/' || p_size"


def _part_function(spark, folder):
    """Every part as a function's name: its module from the part's name, its own from the brand."""
    p = table(spark, folder, "part").withColumn("b", F.lit("b#"))
    return p.withColumn("fun", S.iri_function(F.col("b"), F.col("p_name"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.col("p_size")))


_FUN = _FUN.replace("lower(p_brand)", "url_encode(lower(replace(p_brand, '#', '')))")


@query("iri_parse", f"SELECT p_partkey, x AS iri, CASE p_partkey % 4 WHEN 0 THEN 'clause' WHEN 1 THEN 'function' WHEN 2 THEN 'module' ELSE 'location' END AS kind, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS module, CASE WHEN p_partkey % 4 < 2 THEN lower(replace(p_brand, '#', '')) END AS name, CASE WHEN p_partkey % 4 < 2 THEN p_size END AS arity FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN {_FUN} || '/clause/' || p_size WHEN 1 THEN {_FUN} WHEN 2 THEN 'b#' || {_MOD} ELSE 'b#file/lib/' || {_MOD} || '.ex/L1-' || p_size END AS x FROM part)")
def iri_parse(spark, folder):
    p = _part_function(spark, folder)
    k = F.col("p_partkey") % 4
    place = S.iri_location(S.iri_file(F.col("b"), F.concat(F.lit("lib/"), F.col("p_name"), F.lit(".ex"))), F.lit(1), F.col("p_size"))
    iri = F.when(k == 0, S.iri_clause(F.col("fun"), F.col("p_size"))).when(k == 1, F.col("fun")).when(k == 2, S.iri_module(F.col("b"), F.col("p_name"))).otherwise(place)
    p = p.withColumn("iri", iri)
    f = S.function_from(F.col("iri"))
    return p.select("p_partkey", "iri", S.iri_parts(F.col("iri"))["kind"].alias("kind"), S.module_from(F.col("iri")).alias("module"), f["name"].alias("name"), f["arity"].alias("arity"))


_WITHIN = [("invocation", ["p_type", "p_size"]), ("attribute", ["p_type"]), ("attribute", ["p_type", "p_size"]), ("quote", ["p_size"]), ("unquote", ["p_size"]), ("hygiene", ["p_size"]), ("alias", ["p_size"]), ("import", ["p_size"]), ("require", ["p_size"]), ("use", ["p_size"]), ("option", ["p_size"]), ("anon", ["p_size"]), ("capture", ["p_type"]), ("&", ["p_size"]), ("child", ["p_type", "p_size"])]


@query("iri_family", "SELECT p_partkey, unnest([" + ", ".join("'b#' || " + _MOD + f" || '/{k}/' || " + " || '/' || ".join("replace(replace(url_encode(p_type), '+', '%20'), '~', '%7E')" if c == "p_type" else c for c in cs) for k, cs in _WITHIN) + ", 'b#' || " + _MOD + " || '/type/' || replace(url_encode(p_type), '~', '%7E') || '/' || p_size, 'b#tree/' || " + _MOD + ", 'b#call/' || " + _MOD + " || '/' || p_size]) AS iri FROM part")
def iri_family(spark, folder):
    p = table(spark, folder, "part").withColumn("b", F.lit("b#"))
    mod = S.iri_module(F.col("b"), F.col("p_name"))
    all_ = [S.iri_within(mod, k, *[F.col(c) for c in cs]) for k, cs in _WITHIN] + [S.iri_type(F.col("b"), F.col("p_name"), F.col("p_type"), F.col("p_size")), S.iri_tree(F.col("b"), F.col("p_name")), S.iri_call(F.col("b"), F.col("p_name"), F.col("p_size"))]
    return p.select("p_partkey", F.explode(F.array(*all_)).alias("iri"))


@query("agent_id", "SELECT c_custkey, substr(sha256(lower(trim(c_name))), 1, 12) AS id FROM customer")
def agent_id(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.agent_id(F.col("c_name")).alias("id"))


@query("content_id", r"SELECT doc_id, substr(sha256(trim(regexp_replace(text, '[ \t\n\r\x0B\f]+', ' ', 'g'))), 1, 16) AS id FROM documents")
def content_id(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.content_id(F.col("text")).alias("id"))


@query("conventional_commit", r"SELECT doc_id, lower(regexp_extract(split_part(text, chr(10), 1), '^(\w+(?:-\w+)*)(?:\(([^)]*)\))?(!)?\s*:\s*(.+)$', 1)) AS type, nullif(regexp_extract(split_part(text, chr(10), 1), '^(\w+(?:-\w+)*)(?:\(([^)]*)\))?(!)?\s*:\s*(.+)$', 2), '') AS scope FROM documents WHERE kind = 'commit' AND regexp_matches(split_part(text, chr(10), 1), '^(\w+(?:-\w+)*)(?:\(([^)]*)\))?(!)?\s*:\s*(.+)$')")
def conventional_commit(spark, folder):
    d = table(spark, folder, "documents").filter("kind = 'commit'").select("doc_id", S.conventional(F.col("text")).alias("c")).filter("c IS NOT NULL")
    return d.select("doc_id", "c.type", "c.scope")


def _case(pairs, col: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in pairs) + f" ELSE '{default}' END"


_SUBJ = "split_part(text, chr(10), 1)"
_CONV = S.CONVENTIONAL.replace("(?s)", "")
_PREF = "CASE " + " ".join(f"WHEN lower(regexp_extract({_SUBJ}, '{_CONV}', 1)) = '{k}' THEN '{v}'" for k, v in S.PREFIX_TYPES.items()) + " ELSE 'unknown' END"


@query("classify_commits", f"SELECT doc_id, CASE WHEN regexp_matches({_SUBJ}, '{_CONV}') THEN {_PREF} ELSE {_case(S.KEYWORD_TYPES, _SUBJ, 'unknown')} END AS type FROM documents WHERE text IS NOT NULL AND kind IN ('commit', 'issue')")
def classify_commits(spark, folder):
    d = table(spark, folder, "documents").filter("text IS NOT NULL AND kind IN ('commit', 'issue')")
    return d.select("doc_id", S.classify_commit(F.col("text"))["type"].alias("type"))


@query("activity_types", f"SELECT {_case(S.ACTIVITY_PREFIXES, 'text', 'commit')} AS type, count(*) AS n FROM documents WHERE kind = 'commit' AND text IS NOT NULL GROUP BY 1")
def activity_types(spark, folder):
    d = table(spark, folder, "documents").filter("kind = 'commit' AND text IS NOT NULL")
    return d.groupBy(S.activity_type(F.col("text")).alias("type")).agg(F.count("*").alias("n"))


@query("agent_type", "SELECT event_type AS name, CASE WHEN user_id % 7 = 0 THEN 'bot' WHEN user_id % 7 = 1 THEN 'ci' WHEN user_id % 7 = 2 THEN 'llm' ELSE 'developer' END AS type, count(*) AS n FROM events GROUP BY 1, 2")
def agent_type(spark, folder):
    k = F.col("user_id") % 7
    mail = F.when(k == 0, "x[bot]@users.example").when(k == 1, "jenkins@ci.example").when(k == 2, "copilot@x.example").otherwise("dev@x.example")
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("name"), S.agent_type(mail, F.lit("someone")).alias("type")).agg(F.count("*").alias("n"))


_CLOSED = r"list_sort(list_distinct([upper(x) for x in regexp_extract_all(text, '(?i:\b(?:fix(?:es)?|close[sd]?|resolve[sd]?)\s+)((?i:#\d+|GH-\d+|GL-\d+)|[A-Z][A-Z0-9]+-\d+)', 1)]))"
_ALL_REFS = r"[upper(x) for x in regexp_extract_all(text, '(?:^|[^A-Za-z])(#\d+)', 1) || regexp_extract_all(text, '\b((?i:GH-\d+|GL-\d+)|[A-Z][A-Z0-9]+-\d+)', 1)]"


@query("issue_refs", f"SELECT doc_id, closes, list_sort(list_distinct([x for x in refs if NOT list_contains(closes, x)])) AS mentions FROM (SELECT doc_id, {_CLOSED} AS closes, {_ALL_REFS} AS refs FROM documents WHERE text IS NOT NULL) WHERE len(closes) + len(refs) > 0")
def issue_refs(spark, folder):
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", S.closed_issues(F.col("text")).alias("closes"), S.mentioned_issues(F.col("text")).alias("mentions")).filter(F.size("closes") + F.size("mentions") > 0)


@query("issues_closed", "SELECT o_orderkey, 'https://github.com/o/r/issues/' || o_orderkey AS url, 'generic' AS tracker, o_orderkey % 10 = 0 AS breaking FROM orders")
def issues_closed(spark, folder):
    """Messages made from orders, one closed issue each."""
    m = F.concat(F.lit("fixes #"), F.col("o_orderkey").cast("string"), F.lit(", see #"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 0, "\n\nBREAKING: x").otherwise(""))
    o = table(spark, folder, "orders").withColumn("m", m).withColumn("ref", F.explode(S.closed_issues(F.col("m")))).filter(F.size(S.mentioned_issues(F.col("m"))) == 0)
    return o.select("o_orderkey", S.issue_url(F.lit("github"), F.lit("https://github.com/o/r"), F.substr("ref", F.lit(2))).alias("url"), S.tracker_of(F.col("ref")).alias("tracker"), S.is_breaking(F.col("m")).alias("breaking"))


@query("paths", r"SELECT file_id, mtime, path, NOT regexp_matches(path, '\.\.|^/|//') AS safe, regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^\./', '') AS normal, CASE WHEN starts_with(path, 'lib/') THEN substr(path, 5) END AS below FROM (SELECT DISTINCT file_id, mtime, path FROM source_file)")
def paths(spark, folder):
    p = table(spark, folder, "source_file").select("file_id", "mtime", "path").distinct()
    below = S.relative_path(F.concat(F.lit("/r/"), F.col("path")), F.lit("/r/lib/"))
    return p.select("file_id", "mtime", "path", S.safe_path(F.col("path")).alias("safe"), S.normal_path(F.col("path")).alias("normal"), below.alias("below"))


@query("references_checked", "SELECT name, length(sha256(name)) = 64 AS has_hash, false AS long_sha, true AS sha, regexp_matches(name, '^[a-zA-Z][a-zA-Z0-9_.-]*$') AS ref, sha256(name || '@x') AS who FROM (SELECT DISTINCT name FROM package)")
def references_checked(spark, folder):
    p = table(spark, folder, "package").select("name").distinct()
    h = F.sha2("name", 256)
    return p.select("name", (F.length(h) == 64).alias("has_hash"), S.valid_sha(h).alias("long_sha"), S.valid_sha(F.substring(h, 1, 40)).alias("sha"), S.valid_ref(F.col("name")).alias("ref"), S.anonymous(F.concat("name", F.lit("@x"))).alias("who"))


@query("sizes_and_durations", "SELECT file_id, size, CASE WHEN size >= 1024 THEN ((size * 10 + 512) // 1024) // 10 || '.' || ((size * 10 + 512) // 1024) % 10 || ' KB' ELSE size || ' bytes' END AS bytes, CASE WHEN size >= 60000 THEN size // 60000 || 'm ' || (size % 60000) // 1000 || 's' WHEN size >= 1000 THEN ((size * 10 + 500) // 1000) // 10 || '.' || ((size * 10 + 500) // 1000) % 10 || 's' ELSE size || 'ms' END AS took FROM (SELECT DISTINCT file_id, size FROM source_file WHERE size IS NOT NULL)")
def sizes_and_durations(spark, folder):
    f = table(spark, folder, "source_file").filter("size IS NOT NULL").select("file_id", "size").distinct()
    return f.select("file_id", "size", S.bytes_text(F.col("size")).alias("bytes"), S.duration_text(F.col("size")).alias("took"))


@query("run_error_types", "SELECT CASE WHEN regexp_matches(error, 'disk') THEN 'output_error' WHEN regexp_matches(error, 'timeout') THEN 'timeout' WHEN regexp_matches(error, 'memory|killed') THEN 'analysis_error' ELSE 'unknown' END AS error_type, count(*) AS n FROM analysis_run GROUP BY 1")
def run_error_types(spark, folder):
    return table(spark, folder, "analysis_run").groupBy(S.error_type(F.col("error")).alias("error_type")).agg(F.count("*").alias("n"))


@query("deprecation_notes", r"SELECT DISTINCT attr_value AS note, nullif(regexp_extract(attr_value, '\b([a-z_][a-z0-9_]*[!?]?)/(\d+)', 1), '') AS name, CAST(nullif(regexp_extract(attr_value, '\b([a-z_][a-z0-9_]*[!?]?)/(\d+)', 2), '') AS INT) AS arity FROM module_attribute WHERE attr_name = 'deprecated' AND attr_value IS NOT NULL AND regexp_matches(attr_value, '\b([a-z_][a-z0-9_]*[!?]?)/(\d+)') AND NOT regexp_matches(attr_value, '[A-Z][\w.]+\.[a-z_]')")
def deprecation_notes(spark, folder):
    """Deprecations that name a local function as their replacement."""
    a = table(spark, folder, "module_attribute").filter("attr_name = 'deprecated' AND attr_value IS NOT NULL").select(F.col("attr_value").alias("note")).distinct()
    return a.withColumn("r", S.replacement(F.col("note"))).filter("r.module IS NULL AND r.arity IS NOT NULL").select("note", "r.name", "r.arity")


@query("source_url", "SELECT name, 'https://github.com/org/' || name || '/blob/' || substr(sha256(name), 1, 40) || '/lib/' || name || '.ex#L7' AS url FROM (SELECT DISTINCT name FROM package)")
def source_url(spark, folder):
    p = table(spark, folder, "package").select("name").distinct()
    r = S.remote(F.concat(F.lit("git@github.com:org/"), F.col("name"), F.lit(".git")))
    base = F.concat(F.lit("https://"), r["host"], F.lit("/"), r["owner"], F.lit("/"), r["repo"])
    return p.select("name", S.permalink(S.platform(r["host"]), base, F.substring(F.sha2("name", 256), 1, 40), F.concat(F.lit("lib/"), F.col("name"), F.lit(".ex")), F.lit(7)).alias("url"))


_CUR_PKG = "(SELECT * FROM (SELECT DISTINCT * FROM package) QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC) = 1)"


def _current_packages(spark, folder):
    p = table(spark, folder, "package")
    cols = ["latest_version", "latest_stable_version", "releases", "meta", "downloads", "inserted_at", "updated_at"]
    return p.groupBy("name").agg(F.max_by(F.struct(*cols), "updated_at").alias("c")).select("name", "c.*")


@query("coalesce_fallback", f"SELECT name, coalesce(latest_stable_version, ([r for r in releases if NOT contains(r.version, '-')])[1].version, latest_version, releases[1].version) AS version FROM {_CUR_PKG}")
def coalesce_fallback(spark, folder):
    return _current_packages(spark, folder).select("name", S.latest_stable(F.col("latest_stable_version"), F.col("latest_version"), F.col("releases")).alias("version"))


@query("popularity_order", f"SELECT name, coalesce(downloads['week'], 0) AS recent, coalesce(downloads['all'], 0) AS total FROM {_CUR_PKG}")
def popularity_order(spark, folder):
    p = _current_packages(spark, folder)
    d = lambda k: F.coalesce(F.try_element_at("downloads", F.lit(k)), F.lit(0))
    return rollups.popularity_order(p.select("name", d("week").alias("recent"), d("all").alias("total")), F.col("recent"), F.col("total"), "name")


_SEM = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


@query("semver_sort", rf"SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY a DESC, b DESC, c DESC, pre = '' DESC, pre DESC, version DESC) AS rank FROM (SELECT DISTINCT name, r.version AS version, CAST(regexp_extract(r.version, '{_SEM}', 1) AS INT) AS a, CAST(regexp_extract(r.version, '{_SEM}', 2) AS INT) AS b, CAST(regexp_extract(r.version, '{_SEM}', 3) AS INT) AS c, regexp_extract(r.version, '{_SEM}', 4) AS pre FROM (SELECT name, unnest(releases) AS r FROM {_CUR_PKG}) WHERE regexp_matches(r.version, '{_SEM}'))")
def semver_sort(spark, folder):
    r = _current_packages(spark, folder).select("name", F.explode("releases.version").alias("version")).distinct().filter(S.semver(F.col("version")).isNotNull())
    return rollups.release_chain(r, "name", "version").select("name", "version", F.col("position").alias("rank"))


@query("release_chain", rf"SELECT name, version, lead(version) OVER (PARTITION BY name ORDER BY a DESC, b DESC, c DESC, pre = '' DESC, pre DESC, version DESC) AS previous FROM (SELECT DISTINCT name, r.version AS version, CAST(regexp_extract(r.version, '{_SEM}', 1) AS INT) AS a, CAST(regexp_extract(r.version, '{_SEM}', 2) AS INT) AS b, CAST(regexp_extract(r.version, '{_SEM}', 3) AS INT) AS c, regexp_extract(r.version, '{_SEM}', 4) AS pre FROM (SELECT name, unnest(releases) AS r FROM {_CUR_PKG}) WHERE regexp_matches(r.version, '{_SEM}'))")
def release_chain(spark, folder):
    r = _current_packages(spark, folder).select("name", F.explode("releases.version").alias("version")).distinct().filter(S.semver(F.col("version")).isNotNull())
    return rollups.release_chain(r, "name", "version").select("name", "version", "previous")


@query("three_valued_filter", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)^a') OR contains(p_type, 'BRASS') THEN true WHEN regexp_matches(p_name, '(?i)^b') THEN false ELSE NULL END AS likely FROM part")
def three_valued_filter(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.when(F.rlike("p_name", F.lit("(?i)^a")) | F.contains("p_type", F.lit("BRASS")), True).when(F.rlike("p_name", F.lit("(?i)^b")), False).alias("likely"))


@query("ratio_threshold", "SELECT s_suppkey, s_acctbal / (s_nationkey + 1) AS ratio, s_acctbal / (s_nationkey + 1) > 1.0 AS high FROM supplier")
def ratio_threshold(spark, folder):
    r = F.col("s_acctbal") / (F.col("s_nationkey") + 1)
    return table(spark, folder, "supplier").select("s_suppkey", r.alias("ratio"), (r > 1.0).alias("high"))


# --- histories -----------------------------------------------------------------------------------------------------------------------------------


@query("developer_rollup", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, list_sort(list(DISTINCT event_type)) AS names, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT event_id) AS items FROM events GROUP BY 1")
def developer_rollup(spark, folder):
    return rollups.developer_rollup(table(spark, folder, "events"), "user_id", "ts", "event_id", "event_type")


@query("agent_rollup", "SELECT CASE WHEN user_id % 10 = 0 THEN 'bot' ELSE 'developer' END AS type, count(DISTINCT user_id) AS agents, count(*) AS activities, min(ts) AS first_seen FROM events GROUP BY 1")
def agent_rollup(spark, folder):
    kind = S.agent_type(F.when(F.col("user_id") % 10 == 0, "a[bot]@x").otherwise("a@x"), F.lit("n"))
    return table(spark, folder, "events").groupBy(kind.alias("type")).agg(F.count_distinct("user_id").alias("agents"), F.count("*").alias("activities"), F.min("ts").alias("first_seen"))


@query("blame_rollup", "SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS commits, count(DISTINCT l_suppkey) AS authors, min((l_shipdate, l_orderkey))[2] AS oldest, max((l_shipdate, l_orderkey))[2] AS newest FROM lineitem")
def blame_rollup(spark, folder):
    return rollups.blame_rollup(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey", "l_shipdate")


@query("dedup_consecutive", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS prev, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR prev IS DISTINCT FROM event_type")
def dedup_consecutive(spark, folder):
    return rollups.dedup_consecutive(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id")


@query("derivation_chain", "SELECT event_id, derived_from, changed FROM (SELECT event_id, lag(event_id) OVER w AS derived_from, lag(event_type) OVER w IS DISTINCT FROM event_type AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE derived_from IS NOT NULL")
def derivation_chain(spark, folder):
    return rollups.derivations(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type", "event_id").select("event_id", "derived_from", "changed")


@query("snapshot_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS change, a.v AS old, b.v AS new FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders) a FULL JOIN (SELECT o_orderkey + 3 AS k, o_orderstatus AS v FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def snapshot_diff(spark, folder):
    """Two whole snapshots, one after the other, against the kept index: the orders, and the orders with every key moved on by three."""
    o = table(spark, folder, "orders")
    index = SnapshotIndex(spark, shared_folder(spark, "orders"), "k", ["v"])
    index.apply(o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")))
    index.swap()
    changes = index.apply(o.select((F.col("o_orderkey") + 3).alias("k"), F.col("o_orderstatus").alias("v")))
    return changes.select("k", "change", F.col("old.v").alias("old"), F.col("new.v").alias("new"))


@query("blame_by_commit", "SELECT l_orderkey, l_suppkey, count(*) AS lines, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2")
def blame_by_commit(spark, folder):
    return rollups.blame_by(table(spark, folder, "lineitem"), ["l_orderkey", "l_suppkey"], "l_shipdate")


@query("scope_totals", "SELECT l_orderkey, count(DISTINCT l_partkey) AS files, sum(l_linenumber) AS added, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS deleted FROM lineitem GROUP BY 1")
def scope_totals(spark, folder):
    li = table(spark, folder, "lineitem").withColumn("gone", F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))
    return rollups.scope_totals(li, "l_orderkey", "l_partkey", "l_linenumber", "gone")


@query("commits_page", "SELECT doc_id, created_at FROM documents WHERE kind = 'commit' ORDER BY created_at DESC, doc_id LIMIT 20 OFFSET 10")
def commits_page(spark, folder):
    """A page of the history, newest first: limit and offset are the feature."""
    return table(spark, folder, "documents").filter("kind = 'commit'").select("doc_id", "created_at").orderBy(F.col("created_at").desc(), "doc_id").offset(10).limit(20)


@query("most_active_packages", "SELECT package, count(*) AS commits FROM documents WHERE kind = 'commit' AND package IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_active_packages(spark, folder):
    """The first packages by their commits: a top-k report."""
    return table(spark, folder, "documents").filter("kind = 'commit' AND package IS NOT NULL").groupBy("package").agg(F.count("*").alias("commits")).orderBy(F.col("commits").desc(), "package").limit(10)


# --- provenance ----------------------------------------------------------------------------------------------------------------------------------

_COMMITS = "(SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 40) AS sha, text AS message, created_at AS made, 'dev-' || lower(coalesce(lang, 'x')) || '@x.example' AS email, coalesce(source, 'someone') AS name, lag(doc_id) OVER (PARTITION BY package ORDER BY created_at, doc_id) AS parent FROM documents WHERE kind = 'commit')"


def _commits(spark, folder):
    """The documents of kind commit as a history: each follows the one before it of its package."""
    d = table(spark, folder, "documents").filter("kind = 'commit'").withColumn("ts", F.expr("unix_seconds(cast(created_at as timestamp))")).withColumn("item", F.struct("created_at", "doc_id"))
    sha = lambda c: F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 40)
    d = neighbours(d, "package", "ts", "item", ["before"])
    return d.select(sha("doc_id").alias("sha"), F.substring(sha("doc_id"), 1, 7).alias("short_sha"), F.col("text").alias("message"), F.coalesce("source", F.lit("someone")).alias("author_name"), F.concat(F.lit("dev-"), F.lower(F.coalesce("lang", F.lit("x"))), F.lit("@x.example")).alias("author_email"),
        F.lit(None).cast("string").alias("committer_name"), F.lit(None).cast("string").alias("committer_email"), F.col("created_at").alias("author_date"), F.col("created_at").alias("commit_date"), F.when(F.col("before").isNotNull(), F.array(sha("before.doc_id"))).otherwise(F.array().cast("array<string>")).alias("parents"), F.lit(False).alias("is_merge"))


@query("prov_activities", f"SELECT 'activity:' || substr(sha, 1, 7) AS activity, sha, {_case(S.ACTIVITY_PREFIXES, 'message', 'commit')} AS type, made AS started, email AS author_email FROM {_COMMITS}")
def prov_activities(spark, folder):
    return provenance.activities(_commits(spark, folder)).select("activity", "sha", "type", "started", "author_email")


@query("prov_communication", f"SELECT 'activity:' || substr(sha, 1, 7) AS informed, 'activity:' || substr(sha256(CAST(parent AS VARCHAR)), 1, 7) AS informant FROM {_COMMITS} WHERE parent IS NOT NULL")
def prov_communication(spark, folder):
    return provenance.communication(_commits(spark, folder))


@query("prov_agents", f"SELECT substr(sha256(email), 1, 12) AS agent, email, count(DISTINCT sha) AS activities, min(made) AS first_seen, max(made) AS last_seen FROM (SELECT email, sha, made FROM {_COMMITS} UNION ALL SELECT 'unknown@unknown', sha, made FROM {_COMMITS}) GROUP BY 1, 2")
def prov_agents(spark, folder):
    return provenance.agents(_commits(spark, folder)).select("agent", "email", "activities", "first_seen", "last_seen")


@query("prov_statements", f"SELECT p, count(*) AS n FROM (SELECT unnest(['type', 'startedAtTime', 'endedAtTime', 'activityType', 'wasAssociatedWith']) AS p FROM {_COMMITS} UNION ALL SELECT 'wasInformedBy' FROM {_COMMITS} WHERE parent IS NOT NULL UNION ALL SELECT unnest(['type', 'developerEmail']) FROM (SELECT DISTINCT email FROM {_COMMITS} UNION SELECT 'unknown@unknown') UNION ALL SELECT 'developerName' FROM (SELECT DISTINCT email FROM {_COMMITS})) GROUP BY 1")
def prov_statements(spark, folder):
    c = _commits(spark, folder)
    none = spark.createDataFrame([], "sha string, status string, path string")
    return provenance.statements(c, none).groupBy(F.regexp_extract("p", r"([^#/]+)$", 1).alias("p")).agg(F.count("*").alias("n"))


@query("resume_skip_processed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_skip_processed(spark, folder):
    done = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rollups.resume(table(spark, folder, "orders").select("o_orderkey"), done, "o_orderkey")


_RULES = [("(?i)brass", "metals"), ("^STANDARD", "standard"), ("(?i)tin$", "tin")]


@query("last_match_wins", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)tin$') THEN 'tin' WHEN regexp_matches(p_type, '^STANDARD') THEN 'standard' WHEN regexp_matches(p_type, '(?i)brass') THEN 'metals' END AS owner FROM part")
def last_match_wins(spark, folder):
    return rollups.last_match_wins(table(spark, folder, "part"), "p_type", _RULES).select("p_partkey", "owner")


@query("import_conflicts", "SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def import_conflicts(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first")).filter("n > 1")


@query("missing_callbacks", "SELECT l_orderkey, list_sort([x for x in ['A', 'N', 'R'] if NOT list_contains(have, x)]) AS missing FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1)")
def missing_callbacks(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in "ANR"]), F.collect_set("l_returnflag"))).alias("missing"))


@query("placeholder_gaps", "SELECT l_orderkey, most, list_sort([x for x in range(1, most + 1) if NOT coalesce(list_contains(have, x), false)]) AS gaps FROM (SELECT l_orderkey, max(l_linenumber) AS most, list(DISTINCT CAST(l_linenumber AS BIGINT)) FILTER (l_returnflag <> 'R') AS have FROM lineitem GROUP BY 1)")
def placeholder_gaps(spark, folder):
    have = F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("bigint")))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("most"), F.array_sort(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.max("l_linenumber").cast("bigint")), have)).alias("gaps"))


@query("interval_enclosing", "SELECT event_id, max(s) AS scope FROM (SELECT event_id, epoch_ms(ts) // 1000 // 3600 AS h, user_id FROM events) e LEFT JOIN (SELECT DISTINCT user_id AS u, epoch_ms(ts) // 1000 // 7200 * 2 AS s FROM events) o ON e.user_id = o.u AND e.h BETWEEN o.s AND o.s + 2 GROUP BY 1")
def interval_enclosing(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("h"))
    scopes = e.select("user_id", F.expr("h div 2 * 2").alias("first")).distinct().withColumn("last", F.col("first") + 2).withColumn("scope", F.col("first"))
    return rollups.enclosing(e, scopes, "user_id", "h", "first", "last", "scope", 24).select("event_id", "scope")


@query("failure_counts", "SELECT event_type AS error_type, count(*) AS n, false AS retryable FROM events WHERE user_id % 3 = 0 GROUP BY 1")
def failure_counts(spark, folder):
    e = table(spark, folder, "events").withColumn("status", F.when(F.col("user_id") % 3 == 0, "failed").otherwise("completed"))
    return rollups.failure_counts(e, "status", "event_type")


@query("run_failures", "SELECT coalesce(error, 'unknown') AS error_type, count(*) AS n, coalesce(error, 'unknown') IN ('download_error', 'timeout', 'extraction_error') AS retryable FROM analysis_run WHERE status = 'failed' GROUP BY 1, 3")
def run_failures(spark, folder):
    return rollups.failure_counts(table(spark, folder, "analysis_run"), "status", "error")


@query("progress_summary", "SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS processed, CAST(sum(coalesce(epoch_ms(finished_at) - epoch_ms(started_at), 0)) // count(*) AS BIGINT) AS mean_ms, CAST(greatest(1000000 - count(*), 0) * (sum(coalesce(epoch_ms(finished_at) - epoch_ms(started_at), 0)) // count(*)) AS BIGINT) AS rest_ms, 100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*) AS success FROM analysis_run")
def progress_summary(spark, folder):
    r = table(spark, folder, "analysis_run")
    ms = F.coalesce(F.expr("unix_millis(cast(finished_at as timestamp)) - unix_millis(cast(started_at as timestamp))"), F.lit(0))
    return rollups.progress_summary(r, "status", ms, 1_000_000)


@query("team_cross", "SELECT a.n_name AS member, b.n_name AS lead FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE b.n_nationkey % 5 = 0")
def team_cross(spark, folder):
    n = table(spark, folder, "nation")
    a, b = n.alias("a"), n.filter("n_nationkey % 5 = 0").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("member"), F.col("b.n_name").alias("lead"))


@query("jaccard_pairs", r"WITH t AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '[^\w]+')) AS w FROM eval_item), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON a.item_id < b.item_id) SELECT a, b, c / (n - c) AS similarity FROM p WHERE c / (n - c) >= 0.4")
def jaccard_pairs(spark, folder):
    """Near-equal word sets of evaluation texts."""
    d = table(spark, folder, "eval_item").select("item_id", F.split(F.lower("text"), r"[^\w]+").alias("w"))
    return rollups.jaccard_links(d, "item_id", "w", 0.4)


@query("similar_documents")
def similar_documents(spark, folder):
    """Documents with a Jaccard similarity of their five-word shingles of at least 0.8: equal ones are linked to the least of their class, of other classes the least are linked."""
    return rollups.jaccard_links(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", lambda d: rollups.shingles(d, "doc_id", "text"), 0.8)


# --- code facts ----------------------------------------------------------------------------------------------------------------------------------


_NODES: dict[tuple, object] = {}


def _nodes(spark, folder):
    """The node table of the current files, written once for all queries of a session on the same state of the table."""
    s = table(spark, folder, "source_file")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.inputFiles()[0] if s.inputFiles() else folder)
    status = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs)
    key = (spark.sparkContext.applicationId, folder, len(s.inputFiles()), status.getModificationTime(), status.getLen())
    if key not in _NODES:
        _NODES[key] = stored(facts.of_current_files(s), "nodes")
    return _NODES[key]


def _fact(name: str, f) -> None:
    @query(name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(_nodes(spark, folder))


for _n, _f in (("code_modules", facts.modules), ("code_functions", facts.functions), ("code_clauses", facts.clauses), ("code_parameters", facts.parameters), ("code_calls", facts.calls), ("code_directives", facts.directives), ("code_attributes", facts.attributes), ("code_types", facts.types), ("code_specs", facts.specs), ("code_control_flow", facts.control_flow), ("code_exceptions", facts.exceptions), ("code_structs", facts.structs), ("code_protocols", facts.protocols), ("code_behaviours", facts.behaviours), ("code_callbacks", facts.process_callbacks), ("code_anonymous", facts.anonymous_functions), ("free_variables", facts.free_variables), ("code_quotes", facts.quotes), ("code_supervisors", facts.supervisors), ("code_children", facts.child_specs), ("code_tables", facts.ets_tables), ("code_macros", facts.macro_invocations)):
    _fact(_n, _f)


_ATTR = "SELECT DISTINCT m.file_id, module, attr_name AS name, line FROM module_attribute m JOIN (SELECT file_id, max(mtime) AS mtime FROM source_file GROUP BY 1) f ON m.file_id = f.file_id AND m.file_mtime = f.mtime"


def _set_attributes(spark, folder):
    """Attributes that are set, without types and specs: what the table of another extractor lists."""
    return facts.attributes(_nodes(spark, folder)).filter("values > 0 AND attribute_kind NOT IN ('type', 'spec')")


@query("code_attribute_sites", _ATTR)
def code_attribute_sites(spark, folder):
    return _set_attributes(spark, folder).select("file_id", "module", "name", "line").distinct()


@query("code_attribute_histogram", f"SELECT name, count(*) AS n, count(DISTINCT file_id) AS files FROM ({_ATTR}) GROUP BY 1")
def code_attribute_histogram(spark, folder):
    return _set_attributes(spark, folder).select("file_id", "module", "name", "line").distinct().groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


@query("code_documented_modules", f"SELECT file_id, module, count(*) FILTER (name = 'doc') AS docs, bool_or(name = 'moduledoc') AS has_moduledoc, min(line) AS first_line FROM ({_ATTR}) GROUP BY 1, 2")
def code_documented_modules(spark, folder):
    a = _set_attributes(spark, folder).select("file_id", "module", "name", "line").distinct()
    return a.groupBy("file_id", "module").agg(F.count_if(F.col("name") == "doc").alias("docs"), F.bool_or(F.col("name") == "moduledoc").alias("has_moduledoc"), F.min("line").alias("first_line"))


@query("code_adopted_behaviours", "SELECT DISTINCT m.file_id, module, attr_value AS behaviour FROM module_attribute m JOIN (SELECT file_id, max(mtime) AS mtime FROM source_file GROUP BY 1) f ON m.file_id = f.file_id AND m.file_mtime = f.mtime WHERE attr_name = 'behaviour' AND attr_value IS NOT NULL")
def code_adopted_behaviours(spark, folder):
    """Behaviours by attribute; where the other extractor's table lost a value, it cannot be held against anything."""
    lost = table(spark, folder, "module_attribute").filter("attr_name = 'behaviour'").groupBy("file_id", "module", "line").agg(F.max("attr_value").alias("v")).filter("v IS NULL")
    a = _set_attributes(spark, folder).filter("name = 'behaviour'")
    return a.join(lost, ["file_id", "module", "line"], "left_anti").select("file_id", "module", F.col("value").alias("behaviour")).distinct()


def _sample(name: str) -> None:
    @query(f"sample_{name}", sample.stated_sql(name))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        """A fact on the literal table of sources: contents, parsed, against stated rows."""
        if name == "parse_errors":
            return facts.of_current_files(sample.sources(spark), errors=True)
        key = (spark.sparkContext.applicationId, "sample")
        if key not in _NODES:
            _NODES[key] = stored(facts.of_current_files(sample.sources(spark)), "nodes")
        return getattr(facts, name)(_NODES[key]).drop("pre", "post")


for _n in sample.STATED:
    _sample(_n)


@query("code_graph")
def code_graph(spark, folder):
    q = facts.build(_nodes(spark, folder))
    return q.select(F.col("s.value").alias("s"), "p", F.col("o.value").alias("o"))


@query("code_parse_errors")
def code_parse_errors(spark, folder):
    return facts.of_current_files(table(spark, folder, "source_file"), errors=True)


@query("code_statistics")
def code_statistics(spark, folder):
    s = table(spark, folder, "source_file")
    # lines are counted where contents are read, and the current state is chosen over the counts
    size = F.size(F.split(F.coalesce("content", F.lit("")), "\n"))
    lines = s.groupBy("file_id").agg(F.max(F.struct("mtime", F.xxhash64("content", F.col("content").isNull(), "path"), size.alias("lines"), "path")).alias("c")).select("file_id", "c.path", "c.lines")
    return facts.snapshot_statistics(lines, _nodes(spark, folder))
