from pyspark.sql import functions as F

from quadrille.operators import provenance
from quadrille.sources import files, git_text

LOG = "\x1e".join("\x1f".join(x) for x in [
    ("a" * 40, "aaaaaaa", "Ann", "ann@x.example", "2024-01-01T00:00:00Z", "Ann", "ann@x.example", "2024-01-02T00:00:00Z", "t" * 40, "", "feat: one\n\nbody\nReviewed-by: Bob <BOB@x.example>\n"),
    ("b" * 40, "bbbbbbb", "", "", "2024-01-03T00:00:00Z", "Bot", "x[bot]@y", "2024-01-03T00:00:00Z", "t" * 40, "a" * 40, "Merge"),
]) + "\x1e\n"
NAMES = f"commit {'b' * 40}\n\nM\tlib/a.ex\nR090\told.ex\tnew.ex\nD\tz.ex\nA\ty.ex\njunk\ncommit {'a' * 40}\n\nA\tlib/a.ex\n"


def test_commits(spark):
    c = git_text.commits(spark.createDataFrame([(LOG,), ("",), (None,)], "value string"))
    got = {r.short_sha: r for r in c.collect()}
    assert set(got) == {"aaaaaaa", "bbbbbbb"} and got["bbbbbbb"].author_email is None and got["bbbbbbb"].parents == ["a" * 40]
    assert got["aaaaaaa"].subject == "feat: one" and not got["aaaaaaa"].is_merge
    assert [(r.role, r.name, r.email) for r in git_text.review_trailers(c).collect()] == [("reviewed", "Bob", "bob@x.example")]
    f = git_text.commit_files(spark.createDataFrame([("r", NAMES)], "repo string, value string"))
    assert {(r.sha[0], r.status, r.path, r.old_path, r.similarity) for r in f.collect()} == {("b", "M", "lib/a.ex", None, None), ("b", "R", "new.ex", "old.ex", 90), ("b", "D", "z.ex", None, None), ("b", "A", "y.ex", None, None), ("a", "A", "lib/a.ex", None, None)}
    u = {(r.role, r.entity) for r in provenance.usage(c, f).filter("activity = 'activity:bbbbbbb'").collect()}
    assert u == {("used", "lib/a.ex@aaaaaaa"), ("used", "new.ex@aaaaaaa"), ("used", "z.ex@aaaaaaa"), ("generated", "lib/a.ex@bbbbbbb"), ("generated", "new.ex@bbbbbbb"), ("generated", "y.ex@bbbbbbb"), ("invalidated", "lib/a.ex@aaaaaaa"), ("invalidated", "new.ex@aaaaaaa")}
    assert [(r.informed, r.informant) for r in provenance.communication(c).collect()] == [("activity:bbbbbbb", "activity:aaaaaaa")]
    ag = {r.email: (r.type, r.activities) for r in provenance.agents(c).collect()}
    assert ag == {"ann@x.example": ("developer", 1), "unknown@unknown": ("developer", 1), "x[bot]@y": ("bot", 1)}
    q = provenance.statements(c, f)
    assert q.count() == q.distinct().count() > 10


def test_blame(spark):
    t = f"{'a' * 40} 1 1 2\nauthor Ann\nauthor-mail <ann@x>\nauthor-time 100\n\tline one\n{'a' * 40} 2 2\n\tline two\n{'0' * 40} 3 3 1\nauthor Not Committed Yet\nauthor-mail <n@n>\nauthor-time 200\n\tx\n"
    got = {(r.line_number, r.author_name, r.author_email, r.content, r.committed) for r in git_text.blame(spark.createDataFrame([("f", t)], "path string, value string")).collect()}
    assert got == {(1, "Ann", "ann@x", "line one", True), (2, "Ann", "ann@x", "line two", True), (3, "Not Committed Yet", "n@n", "x", False)}


def test_diff_and_deprecations(spark):
    d = f"commit {'c' * 40}\n\ndiff --git a/lib/a.ex b/lib/b.ex\nsimilarity index 80%\n--- a/lib/a.ex\n+++ b/lib/b.ex\n@@ -1,3 +1,4 @@\n keep\n-old(1)\n+@deprecated \"use g\"\n+def f(x) do\n end\n"
    x = git_text.diff_lines(spark.createDataFrame([("r", d)], "repo string, value string"))
    assert {(r.sign, r.line_no, r.text, r.file, r.old_file, r.similarity) for r in x.collect()} == {("-", 2, "old(1)", "lib/b.ex", "lib/a.ex", 80), ("+", 2, '@deprecated "use g"', "lib/b.ex", "lib/a.ex", 80), ("+", 3, "def f(x) do", "lib/b.ex", "lib/a.ex", 80)}
    assert [(r.message, r.element) for r in provenance.deprecations(x).collect()] == [("use g", "f")]


def test_owners(spark):
    o = git_text.code_owners(spark.createDataFrame([("r", "# c\n*.ex @a @b\n\nnobody\n/docs/ x@y\n")], "repo string, value string"))
    assert [(r.line_number, r.pattern, r.owners) for r in o.orderBy("line_number").collect()] == [(2, "*.ex", ["@a", "@b"]), (5, "/docs/", ["x@y"])]


def test_refactorings(spark):
    s = "sha string, file string, name string, arity int, body string"
    old = spark.createDataFrame([("c", "a.ex", "load", 1, "x = read(path) parse(x) keep(x)"), ("c", "a.ex", "same", 0, "one two")], s)
    new = spark.createDataFrame([("c", "a.ex", "fetch", 1, "x = read(path) parse(x) keep(x)"), ("c", "b.ex", "same", 0, "one two"), ("d", "b.ex", "same", 0, "one two")], s)
    assert {(r.kind, r.old_name, r.new_name, r.new_file) for r in provenance.refactorings(old, new).collect()} == {("rename_function", "load", "fetch", "a.ex"), ("move_function", "same", "same", "b.ex")}


def test_source_tree_and_outputs(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "test").mkdir()
    (tmp_path / "lib" / "a.ex").write_bytes("﻿x = 1\n".encode())
    (tmp_path / "test" / "t.exs").write_text("y")
    (tmp_path / "lib" / "n.md").write_text("z")
    got = [(r.path, r.content, r.size) for r in files.source_tree(spark, str(tmp_path)).collect()]
    assert got == [("lib/a.ex", "x = 1\n", 9)]
    df = spark.createDataFrame([("a/b", "1.0", 1), ("c", "2", None)], "name string, version string, x int")
    files.write_packages(df, str(tmp_path / "out"))
    files.write_packages(df.filter("name = 'c'").withColumn("x", F.lit(5)), str(tmp_path / "out"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 5]
    assert files.render(df.select("name", "x"), "csv") == "name,x\na/b,1\nc,\n"
    assert '"x": null' in files.render(df, "json") and "name" in files.render(df)


def test_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text('[{"name": "a"}, {"name": "b"}]')
    (tmp_path / "p2.json").write_text("[]")
    spark.dataSource.register(files.PagedJson)
    df = spark.read.format("paged_json").option("path", str(tmp_path / "p{page}.json")).option("pages", "3").load()
    assert {(r.page, r.n) for r in df.select("page", F.get_json_object("item", "$.name").alias("n")).collect()} == {(1, "a"), (1, "b")}


def test_unpack(spark):
    import io
    import tarfile

    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name, body in (("lib/a.ex", b"x = 1"), ("../evil", b"y"), ("/abs", b"z")):
            i = tarfile.TarInfo(name)
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    df = spark.createDataFrame([("a", bytearray(buf.getvalue())), ("b", bytearray(b"junk")), ("c", None)], "path string, content binary")
    got = {(r.archive, r.member, r.text, r.error) for r in files.unpack(df).collect()}
    assert {x for x in got if x[0] == "a"} == {("a", "lib/a.ex", "x = 1", None), ("a", "../evil", None, "path_traversal"), ("a", "/abs", None, "absolute_path"), ("a", "l", None, "unsafe_link")}
    assert ("b", None, None, "invalid_archive") in got


def test_file_history_follows_renames(spark):
    commits = spark.createDataFrame([(f"c{i}", f"2024-01-0{i}") for i in range(1, 7)], "sha string, d string").selectExpr("sha", "cast(d as timestamp) as commit_date")
    files_ = spark.createDataFrame([("c1", "A", "a.ex", None), ("c2", "M", "a.ex", None), ("c3", "R", "b.ex", "a.ex"), ("c4", "R", "c.ex", "b.ex"), ("c5", "M", "c.ex", None), ("c6", "A", "z.ex", None)], "sha string, status string, path string, old_path string")
    got = [(r.path, r.position, r.sha, r.path_then) for r in provenance.file_history(files_, commits).orderBy("path", "position").collect()]
    assert got == [("c.ex", 0, "c5", "c.ex"), ("c.ex", 1, "c4", "c.ex"), ("c.ex", 2, "c3", "b.ex"), ("c.ex", 3, "c2", "a.ex"), ("c.ex", 4, "c1", "a.ex"), ("z.ex", 0, "c6", "z.ex")]
