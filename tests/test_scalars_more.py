from pyspark.sql import functions as F

from quadrille.functions import scalars as S
from quadrille.sources import files, git_text


def one(spark, c, *rows):
    """The values of a column expression over texts in ``x``."""
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(c).collect()]


def test_issues(spark):
    x = F.col("x")
    texts = ["Fixes #12 and closes GH-3, see #7 and ABC-4, fixed", "resolved abc#5 GL-9", None, ""]
    assert one(spark, S.closed_issues(x), *texts) == [["#12", "GH-3"], [], [], []]
    assert one(spark, S.mentioned_issues(x), *texts) == [["#7", "ABC-4"], ["GL-9"], [], []]
    assert one(spark, S.tracker_of(x), "#1", "GH-1", "GL-2", "AB-3") == ["generic", "github", "gitlab", "jira"]
    assert one(spark, S.is_breaking(x), "BREAKING: x", "a Breaking thing", "unbreaking", None) == [True, True, False, None]


def test_files_types(spark):
    rows = [(["a/test/b.ex", "c_test.exs"],), (["docs/x", "README", "y.md"],), (["mix.lock", "mix.exs"],), (["mix.exs"],), ([".github/w.yml"],), (["lib/a.ex", "y.md"],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>").select(S.files_type(F.col("p"))).collect()]
    assert got == ["test", "docs", "deps", "deps", "ci", "unknown", "unknown", "unknown"]


def test_agents_by_message(spark):
    x = F.col("x")
    assert one(spark, S.agent_type_of_commit(F.lit("a@b"), F.lit("n"), x), "Co-authored-by: some Copilot", "AI-assisted", "plain", None) == ["llm", "llm", "developer", "developer"]
    assert one(spark, S.agent_type_of_commit(F.lit("dependabot@b"), F.lit("n"), x), "AI-assisted") == ["bot"]


def test_paths_and_references(spark):
    x = F.col("x")
    assert one(spark, S.normal_path(x), "a\\\\b//c/", "./a/./b", "/", "a/././b", None) == ["a/b/c", "a/b", "/", "a/b", None]
    assert one(spark, S.safe_path(x), "a/b", "../a", "/a", "a//b", None) == [True, False, False, False, False]
    assert one(spark, S.without_traversal(x), "../../etc/passwd", "a/../b") == ["etc/passwd", "a//b"]
    assert one(spark, S.relative_path(x, F.lit("/r/p")), "/r/p/lib/a.ex", "/r/p", "/r/px/a", "lib/a.ex", "../x") == ["lib/a.ex", ".", None, "lib/a.ex", None]
    assert one(spark, S.valid_ref(x), "HEAD", "HEAD~2", "refs/heads/a-b/c", "HEAD; rm", "v1.2", None) == [True, True, True, False, True, False]
    assert one(spark, S.valid_sha(x, True), "abcdef1", "abcde", None) == [True, False, False]


def test_texts(spark):
    x = F.col("x")
    n = x.cast("bigint")
    assert one(spark, S.bytes_text(n), "5", "1280", "1572864", "3221225472", None) == ["5 bytes", "1.3 KB", "1.5 MB", "3.0 GB", None]
    assert one(spark, S.duration_text(n), "5", "1500", "90000") == ["5ms", "1.5s", "1m 30s"]
    assert one(spark, S.error_type(x), "HTTP 500", "timeout after 3 s", "disk full", "odd", None) == ["download_error", "timeout", "output_error", "unknown", "unknown"]
    got = one(spark, S.replacement(x), "Use new_func/2 instead", "See MyModule.other/1 for details", "Use Ab.c", "use :c", "none", None)
    assert [tuple(r) if r else None for r in got] == [(None, "new_func", 2), ("MyModule", "other", 1), ("Ab", "c", None), (None, "c", None), None, None]


def test_names_of_resources(spark):
    x = F.col("x")
    iris = ["b#A.B/f%3F/2/clause/1/param/0", "b#A.B/f/2", "b#A.B", "b#file/a/L1-2", "b#repo/ab12/commit/cd", "none", None]
    assert one(spark, S.module_from(x), *iris) == ["A.B", "A.B", "A.B", None, None, None, None]
    assert [tuple(r) if r else None for r in one(spark, S.function_from(x), *iris)] == [("A.B", "f?", 2), ("A.B", "f", 2), None, None, None, None, None]
    assert [(r.kind, r.parts) if r else None for r in one(spark, S.iri_parts(x), *iris)][:3] == [("parameter", ["b#A.B/f%3F/2", "1", "0"]), ("function", ["b#", "A.B", "f", "2"]), ("module", ["b#", "A.B"])]


def test_messages_and_owners_of_any_length(spark):
    long = "\x1f".join(["h", "s", "n", "e", "2024-01-01", "c", "d", "2024-01-01", "t", "", *[f"part{i}" for i in range(1500)]]) + "\x1e"
    m = git_text.commits(spark.createDataFrame([(long,)], "value string")).first().message
    assert m.endswith("part1499") and m.count("\x1f") == 1499
    owners = git_text.code_owners(spark.createDataFrame([("r", "*.ex " + " ".join(f"@o{i}" for i in range(12_000)))], "repo string, value string")).first().owners
    assert len(owners) == 12_000


def test_pages_until_one_is_empty(spark, tmp_path):
    import pytest

    for i in (1, 2):
        (tmp_path / f"p{i}.json").write_text('[{"a": %d}, {"a": 9}]' % i)
    (tmp_path / "p4.json").write_text('[{"a": 4}]')
    spark.dataSource.register(files.PagedJson)
    df = spark.read.format("paged_json").option("path", str(tmp_path / "p{page}.json")).load()
    assert sorted(r.page for r in df.collect()) == [1, 1, 2, 2]
    bad = spark.read.format("paged_json").option("path", "http://127.0.0.1:9/{page}").option("pages", "1").option("retries", "1").load()
    with pytest.raises(Exception):
        bad.collect()
    assert files.retry_after(429, {"Retry-After": "7"}, 0, 0.0) == 7.0 and files.retry_after(429, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "50"}, 0, 20.0) == 30.0
    assert (files.retry_after(429, {}, 1, 0.0), files.retry_after(500, {}, 2, 0.0)) == (20.0, 4.0)
    with pytest.raises(ValueError):
        files.render(spark.range(5), limit=4)
