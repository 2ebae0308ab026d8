import pytest
from pyspark.sql import functions as F

from quadrille.functions import scalars as S
from quadrille.operators import facts, rollups

SRC = '''defmodule Top.One do
  use GenServer
  alias Foo.{Bar, Baz}
  import Enum, only: [map: 2]
  @behaviour Plug
  @type t(a) :: {a, integer}
  @spec run(a, b) :: c
  @doc "Runs."
  def run(x, y \\\\ 1) when x > y do
    k = 3
    out = Enum.map(x, fn z -> z + k end)
    if out, do: help(out), else: raise "no"
  end
  def run(_, _), do: nil
  defp help(%{v: v} = m), do: apply(m, :go, [v])
  def init(arg), do: {:ok, arg}
  defmodule Inner do
    defstruct [:a, b: 1]
    defmacro w(q), do: quote(do: unquote(q))
  end
end
'''


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame([(1, "lib/a.ex", SRC, "x"), (2, "b.ex", "def (", "x"), (3, "c.ex", None, "x"), (4, "d.py", "x", "x"), (None, "e.ex", "x = 1", "x")], "file_id bigint, path string, content string, kind string")
    return df, facts.ast_nodes(df).cache()


def test_interval_table(nodes):
    df, n = nodes
    rows = n.filter("file_id = 1").collect()
    by = {r.pre: r for r in rows}
    assert sorted(by) == list(range(len(rows))) == sorted(r.post for r in rows)
    for r in rows:
        if r.parent >= 0:
            p = by[r.parent]
            assert p.pre < r.pre and p.post > r.post and p.depth < r.depth
    assert [r.file_id for r in facts.parse_errors(df).collect()] == [2]
    fn = n.filter("kind = 'fn'")
    assert facts.descendants(n, fn).count() == n.filter("kind = 'fn'").join(n.withColumnRenamed("pre", "p2").select("file_id", "p2", F.col("post").alias("q2")), "file_id").filter("p2 > pre and q2 < post").count()


def test_facts(nodes):
    _, n = nodes
    assert {(r.name, r.parent) for r in facts.modules(n).collect()} == {("Top.One", None), ("Top.One.Inner", "Top.One")}
    f = {(r.module, r.name, r.arity): (r.clauses, r.min_arity) for r in facts.functions(n).collect()}
    assert f == {("Top.One", "run", 2): (2, 1), ("Top.One", "help", 1): (1, 1), ("Top.One", "init", 1): (1, 1), ("Top.One.Inner", "w", 1): (1, 1)}
    assert {(r.name, r.position, r.parameter_kind) for r in facts.parameters(n).filter("name = 'run' and line = 9").collect()} == {("run", 0, "simple"), ("run", 1, "default")}
    assert {(r.fun, r.call_kind, r.name) for r in facts.calls(n).collect()} == {("run", "remote", "Enum.map"), ("run", "local", "help"), ("help", "dynamic", "apply")}
    assert {(r.directive, r.target) for r in facts.directives(n).collect()} == {("use", "GenServer"), ("alias", "Foo.Bar"), ("alias", "Foo.Baz"), ("import", "Enum")}
    assert {(r.name, r.arity) for r in facts.types(n).collect()} == {("t", 1)}
    assert {r.name for r in facts.specs(n).collect()} == {"run"}
    assert {r.behaviour for r in facts.behaviours(n).collect()} == {"Plug", "GenServer"}
    assert {r.name for r in facts.process_callbacks(n).collect()} == {"init"}
    assert {r.construct for r in facts.control_flow(n).collect()} == {"if"}
    assert {r.construct for r in facts.exceptions(n).collect()} == {"raise"}
    assert {r.name: r.uses for r in facts.free_variables(n).collect()} == {"k": 1}
    assert {tuple(r.fields) for r in facts.structs(n).collect()} == {("a", "b")}
    assert {r.construct for r in facts.quotes(n).collect()} == {"quote", "unquote"}
    q = facts.build(n)
    assert q.count() == q.distinct().count() and q.filter(F.col("p").endswith("callsFunction")).count() == 2


def test_nothing_from_nothing(nodes):
    _, n = nodes
    for f in (facts.modules, facts.functions, facts.parameters, facts.calls, facts.directives, facts.free_variables, facts.build):
        assert f(n.limit(0)).count() == 0


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


@pytest.mark.parametrize("name,code", [("a b*c~d!'()", "a%20b%2Ac%7Ed%21%27%28%29"), ("Ä/ü.x-y_z", "%C3%84%2F%C3%BC.x-y_z"), ("", ""), (None, None)])
def test_names(spark, name, code):
    assert one(spark, name, "string", S.escape_name(F.col("x"))) == code
    assert one(spark, code, "string", S.unescape_name(F.col("x"))) == name


@pytest.mark.parametrize("url,parts", [("https://github.com/a/b.git", ("github.com", "a", "b")), ("git@gitlab.com:g/s/r.git", ("gitlab.com", "g/s", "r")), ("ssh://git@h.example:22/o/r", ("h.example", "o", "r")), ("git://h/o/r.git", ("h", "o", "r")), ("nonsense", None), (None, None)])
def test_remotes(spark, url, parts):
    r = one(spark, url, "string", S.remote(F.col("x")))
    assert (tuple(r) if r else None) == parts


@pytest.mark.parametrize("m,t", [("feat(x)!: y", "feature"), ("foo: y", "unknown"), ("Fix the bug", "bugfix"), ("Add docs", "docs"), ("hello", "unknown"), (None, None)])
def test_commit_types(spark, m, t):
    r = one(spark, m, "string", S.classify_commit(F.col("x")))
    assert (r and r.type) == t


def test_versions(spark):
    df = spark.createDataFrame([(v,) for v in ("1.2.0", "1.10.0", "1.10.0-rc.1", "v2.0.0", "x", "1.2")], "v string")
    assert [r.v for r in df.orderBy(S.semver_key(F.col("v")).desc()).collect()][:4] == ["v2.0.0", "1.10.0", "1.10.0-rc.1", "1.2.0"]


def test_paths_and_owners(spark):
    assert one(spark, "lib/foo_bar/baz.ex", "string", S.module_of_path(F.col("x"))) == "FooBar.Baz"
    assert one(spark, "a/../b:c*", "string", S.safe_file_name(F.col("x"))) == "a___b_c"
    for glob, path, hit in (("*.ex", "lib/a.ex", True), ("/docs/", "docs/x.md", True), ("/docs/", "a/docs/x", False), ("lib/**/x.ex", "lib/a/b/x.ex", True)):
        ok = spark.createDataFrame([(glob, path)], "g string, p string").select(F.rlike("p", S.owner_pattern(F.col("g"), compat=False))).first()[0]
        assert ok is hit, glob


def test_similar_sets_equal_brute_force(spark):
    import random

    rnd = random.Random(1)
    sets = [(i, None if i == 0 else [] if i == 1 else [f"t{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 9))]) for i in range(60)] + [(100, ["a", "b"]), (101, ["b", "a", "a"])]
    df = spark.createDataFrame(sets, "k bigint, t array<string>")
    for limit in (0.5, 0.8):
        got = {(r.a, r.b): r.similarity for r in rollups.jaccard_links(df, "k", "t", limit).collect()}
        cls = {}
        for i, t in sets:
            if t:
                cls.setdefault(frozenset(t), []).append(i)
        reps = sorted((min(v), k) for k, v in cls.items())
        want = {(a, b): len(x & y) / len(x | y) for n, (a, x) in enumerate(reps) for b, y in reps[n + 1:] if len(x & y) / len(x | y) >= limit}
        want |= {(min(v), i): 1.0 for v in cls.values() for i in v if i != min(v)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_empty_histories(spark):
    e = spark.createDataFrame([], "status string, kind string, ms bigint")
    r = rollups.progress_summary(e, "status", F.col("ms"), 10).first()
    assert (r.processed, r.mean_ms, r.success) == (0, 0, 0.0)
    assert rollups.failure_counts(e, "status", "kind").count() == 0


OTP = '''defmodule App.Sup do
  use Supervisor
  def init(_) do
    children = [App.Worker, {App.InnerSupervisor, [a: 1]}]
    :ets.new(:cache, [:named_table, :bag, :public, read_concurrency: true])
    Logger.info("up")
    Supervisor.init(children, strategy: :rest_for_one, max_restarts: 10)
  end
end
'''


def test_processes(spark):
    n = facts.ast_nodes(spark.createDataFrame([(1, "a.ex", OTP)], "file_id bigint, path string, content string")).cache()
    s = facts.supervisors(n).first()
    assert (s.module, s.behaviour, s.strategy, s.max_restarts, s.max_seconds, s.high) == ("App.Sup", "Supervisor", "rest_for_one", 10, 5, True)
    assert {(r.child, r.position, r.type) for r in facts.child_specs(n).collect()} == {("App.Worker", 0, "worker"), ("App.InnerSupervisor", 1, "supervisor")}
    t = facts.ets_tables(n).first()
    assert (t.table, t.type, t.access, t.named, t.read_concurrency) == ("cache", "bag", "public", True, True)
    assert ("Logger.info", "Logger") in {(r.macro, r.library) for r in facts.macro_invocations(n).collect()}
    assert facts.find(n, "module").count() == 1 and facts.find(n, "literal").count() > 5
    q = facts.build(n)
    assert q.filter(F.col("p").endswith("supervises")).count() == 2 == q.filter(F.col("p").endswith("supervisedBy")).count()


def test_long_texts_are_whole(spark):
    points = ", ".join(f"{{{i}, {i}}}" for i in range(1000))
    fields = ", ".join(f":field_{i}" for i in range(500))
    children = ", ".join(f"{{Worker, {i}}}" for i in range(500))
    src = f"defmodule Long do\n  @points [{points}]\n  defstruct [{fields}]\n  def start, do: Supervisor.start_link([{children}], strategy: :rest_for_one, max_restarts: 9)\nend\n"
    n = facts.ast_nodes(spark.createDataFrame([(1, "l.ex", src)], "file_id bigint, path string, content string")).cache()
    text = facts.attributes(n).filter("name = 'points'").first().text
    assert len(text) > 4000 and text.endswith("{999, 999}]") and text.count("{") == 1000
    assert facts.structs(n).first().fields == [f"field_{i}" for i in range(500)]
    s = facts.supervisors(n).first()
    assert (s.strategy, s.max_restarts) == ("rest_for_one", 9)


def test_similar_documents_equal_brute_force(spark, tmp_path):
    import random
    import re

    from quadrille.queries import QUERIES

    rnd = random.Random(2)
    base = [[f"w{rnd.randrange(50)}é" for _ in range(60)] for _ in range(4)]
    texts = [None, "", "!?", "short text", "Short, text!", *(" ".join(b) for b in base for _ in range(2))]
    for b in base * 6:
        t = list(b)
        t[rnd.randrange(60)] = "changed"
        texts.append(", ".join(t))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        if w:
            sets.setdefault(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))), []).append(i)
    want = {(v[0], i) for v in sets.values() for i in v[1:]}
    reps = sorted((v[0], k) for k, v in sets.items())
    want |= {(a, b) for n, (a, x) in enumerate(reps) for b, y in reps[n + 1:] if len(x & y) / len(x | y) >= 0.8}
    got = [(r.a, r.b) for r in QUERIES["similar_documents"](spark, str(tmp_path)).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_similar_documents_shuffle_no_tokens(spark, sf):
    from quadrille.queries import QUERIES

    plan = QUERIES["similar_documents"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan


def test_similar_sets_at_the_very_threshold(spark):
    sets = [(1, list(range(100))), (2, list(range(55)))]
    for kind in ("bigint", "string"):
        df = spark.createDataFrame(sets, "k bigint, t array<bigint>").selectExpr("k", f"cast(t as array<{kind}>) AS t")
        assert [tuple(r) for r in rollups.jaccard_links(df, "k", "t", 0.55).collect()] == [(1, 2, 0.55)]


def test_deep_files_give_facts(spark):
    deep = "x = " + '"#{' * 2000 + "1" + '}"' * 2000
    nested = "x = " + "[" * 3000 + "1" + "]" * 3000
    df = spark.createDataFrame([(1, "a.ex", deep, 1), (2, "b.ex", nested, 1)], "file_id bigint, path string, content string, mtime bigint")
    assert facts.of_current_files(df, errors=True).count() == 0 and {r.file_id for r in facts.of_current_files(df).select("file_id").distinct().collect()} == {1, 2}


def test_current_states(spark):
    df = spark.createDataFrame([(1, "a.ex", "defmodule A do\nend", 1), (1, "a.ex", "defmodule B do\nend", 2), (1, "a.ex", "defmodule B do\nend", 2), (2, "b.ex", "defmodule C do\nend", None), (None, "c.ex", "defmodule D do\nend", 1), (None, "c.ex", "defmodule E do\nend", 3), (3, "d.ex", "def (", 1), (3, "d.ex", None, 2)], "file_id bigint, path string, content string, mtime bigint")
    assert {(r.file_id, r.name) for r in facts.modules(facts.of_current_files(df)).collect()} == {(1, "B"), (2, "C"), (None, "E")}
    assert facts.of_current_files(df, errors=True).count() == 0
    assert facts.of_current_files(df.filter("file_id = 3 and mtime = 1"), errors=True).count() == 1


def test_texts_of_any_length(spark):
    values = ", ".join(f'"value number {i}"' for i in range(1000))
    fields = ", ".join(f":field{i}" for i in range(1000))
    src = f"defmodule A do\n  @points [{values}]\n  defstruct [{fields}, z: 1]\n  def f(a), do: fn x, b when x > a -> c = x + b; fn a -> a + c + d end end\nend\n"
    n = facts.of_current_files(spark.createDataFrame([(1, "a.ex", src, 1)], "file_id bigint, path string, content string, mtime bigint"))
    assert "value number 999" in facts.attributes(n).filter("name = 'points'").first().value
    got = facts.structs(n).first().fields
    assert got[-1] == "z" and len(got) == 1001
    assert sorted((r.line, r.name, r.uses) for r in facts.free_variables(n).collect()) == [(4, "a", 1), (4, "c", 1), (4, "d", 1), (4, "d", 1)]
