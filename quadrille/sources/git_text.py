"""Version-control text to tables.  The text is written once by plain git commands (see ``COMMANDS``); Spark parses the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What to run in a repository for each parser below; fields of a commit are separated by 0x1f, commits by 0x1e.
COMMANDS = {
    "commits": "git log --format=%H%x1f%h%x1f%an%x1f%ae%x1f%aI%x1f%cn%x1f%ce%x1f%cI%x1f%T%x1f%P%x1f%B%x1e",
    "files": "git log --format=commit %H --name-status",
    "blame": "git blame --porcelain PATH",
    "diff": "git show --format=commit %H -M",
    "tags": "git for-each-ref refs/tags --format=%(refname:short)%09%(objectname)%09%(creatordate:iso-strict)",
}
_FIELDS = ["sha", "short_sha", "author_name", "author_email", "author_date", "committer_name", "committer_email", "commit_date", "tree_sha", "parents", "message"]


def commits(texts: DataFrame, text: str = "value") -> DataFrame:
    """One row per commit; texts that lack fields give no row, empty names and addresses are null."""
    rec = texts.select(F.explode(F.split(text, "\x1e")).alias("r")).select(F.split(F.regexp_replace("r", r"^\s+", ""), "\x1f").alias("f")).filter(F.size("f") >= 11)
    blank = lambda c: F.when(c != "", c)
    cols = [blank(F.col("f")[i]).alias(n) for i, n in enumerate(_FIELDS[:9])]
    out = rec.select(*cols, F.filter(F.split(F.col("f")[9], " "), lambda p: p != "").alias("parents"), F.regexp_replace(F.array_join(F.slice("f", F.lit(11), F.size("f")), "\x1f"), r"\s+$", "").alias("message"))
    out = out.withColumn("author_date", F.col("author_date").try_cast("timestamp")).withColumn("commit_date", F.col("commit_date").try_cast("timestamp"))
    return out.withColumn("subject", F.substring_index("message", "\n", 1)).withColumn("body", F.trim(F.substr("message", F.length("subject") + 1))).withColumn("is_merge", F.size("parents") > 1)


def _carry(lines: DataFrame, source: str, at: str, value: Column, out: str) -> DataFrame:
    """Forward fill within a source."""
    w = Window.partitionBy(source).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(out, F.last(value, ignorenulls=True).over(w))


def numbered(texts: DataFrame, source: str, text: str = "value") -> DataFrame:
    return texts.select(source, F.posexplode(F.split(text, "\n")).alias("at", "line"))


def commit_files(texts: DataFrame, source: str = "repo", text: str = "value") -> DataFrame:
    """(repo, sha, status, path, old_path, similarity) of name-status text; unknown lines are left out."""
    lines = numbered(texts, source, text)
    head = F.when(F.startswith("line", F.lit("commit ")), F.substr("line", F.lit(8)))
    parts = F.split("line", "\t")
    status = F.substring(parts[0], 1, 1)
    rows = _carry(lines, source, "at", head, "sha").filter(F.col("line").rlike(r"^([AMDT]\t[^\t]+|[RC]\d*\t[^\t]+\t[^\t]+)$"))
    renamed = status.isin("R", "C")
    return rows.select(source, "sha", status.alias("status"), F.when(renamed, parts[2]).otherwise(parts[1]).alias("path"), F.when(renamed, parts[1]).alias("old_path"), F.substr(parts[0], F.lit(2)).try_cast("int").alias("similarity"))


def blame(texts: DataFrame, source: str = "path", text: str = "value") -> DataFrame:
    """(path, line_number, sha, content, author_name, author_email, author_time) of porcelain blame text.

    A commit's header stands only at its first line, so it is found by commit within the file and joined to the later lines.
    """
    lines = numbered(texts, source, text)
    head = F.when(F.col("line").rlike(r"^[0-9a-f]{40} \d+ \d+"), F.col("at"))
    rows = _carry(lines, source, "at", head, "entry")
    part = lambda prefix: F.max(F.when(F.startswith("line", F.lit(prefix)), F.substr("line", F.lit(len(prefix) + 1))))
    e = rows.filter("entry is not null").groupBy(source, "entry").agg(F.min_by("line", "at").alias("h"), part("author ").alias("n"), part("author-mail ").alias("m"), part("author-time ").alias("t"), part("\t").alias("content"))
    e = e.select(source, F.substring("h", 1, 40).alias("sha"), F.regexp_extract("h", r"^\S+ \d+ (\d+)", 1).cast("int").alias("line_number"), "content", "n", "m", "t")
    w = Window.partitionBy(source, "sha")
    known = lambda c: F.max(c).over(w)
    return e.select(source, "line_number", "sha", "content", known("n").alias("author_name"), F.regexp_replace(known("m"), "^<|>$", "").alias("author_email"), F.timestamp_seconds(known("t").try_cast("bigint")).alias("author_time"), (F.col("sha") != "0" * 40).alias("committed"))


def diff_lines(texts: DataFrame, source: str = "repo", text: str = "value") -> DataFrame:
    """(repo, sha, file, old_file, similarity, sign, line_no, text) of added and removed lines."""
    lines = numbered(texts, source, text)
    start = F.when(F.startswith("line", F.lit("commit ")), F.substr("line", F.lit(8)))
    x = _carry(lines, source, "at", start, "sha")
    name = F.when(F.col("line").rlike(r"^diff --git a/.+ b/.+$"), F.struct(F.regexp_extract("line", r"^diff --git a/(.+) b/(.+)$", 2).alias("new"), F.regexp_extract("line", r"^diff --git a/(.+) b/(.+)$", 1).alias("old"), F.col("at").alias("at")))
    x = _carry(x, source, "at", name, "f")
    x = _carry(x, source, "at", F.when(F.col("line").rlike(r"^similarity index \d+%"), F.struct(F.regexp_extract("line", r"(\d+)%", 1).cast("int").alias("s"), F.col("f.at").alias("f"))), "sim")
    x = _carry(x, source, "at", F.when(F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+"), F.struct(F.regexp_extract("line", r"\+(\d+)", 1).cast("int").alias("new"), F.regexp_extract("line", r"^@@ -(\d+)", 1).cast("int").alias("old"), F.col("at").alias("at"))), "hunk")
    x = x.filter(F.col("hunk").isNotNull() & (F.col("hunk.at") > F.col("f.at")) & (F.col("at") > F.col("hunk.at")) & F.col("line").rlike(r"^[ +-]"))
    w = Window.partitionBy(source, "hunk.at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    plus, minus = F.count_if(~F.startswith("line", F.lit("-"))).over(w), F.count_if(~F.startswith("line", F.lit("+"))).over(w)
    sign = F.substring("line", 1, 1)
    x = x.withColumn("line_no", F.when(sign == "-", F.col("hunk.old") + minus - 1).otherwise(F.col("hunk.new") + plus - 1))
    return x.filter(sign != " ").select(source, "sha", F.col("f.new").alias("file"), F.col("f.old").alias("old_file"), F.when(F.col("sim.f") == F.col("f.at"), F.col("sim.s")).alias("similarity"), sign.alias("sign"), "line_no", F.substr("line", F.lit(2)).alias("text"))


def code_owners(texts: DataFrame, source: str = "repo", text: str = "value") -> DataFrame:
    """(repo, line_number, pattern, owners) of ownership files; comments, blank lines and patterns without owners are left out."""
    lines = numbered(texts, source, text).select(source, (F.col("at") + 1).alias("line_number"), F.split(F.trim("line"), r"\s+").alias("p"))
    return lines.filter((F.size("p") > 1) & ~F.startswith(F.col("p")[0], F.lit("#"))).select(source, "line_number", F.col("p")[0].alias("pattern"), F.slice("p", F.lit(2), F.size("p")).alias("owners"))


def review_trailers(commits_df: DataFrame, key: str = "sha", message: str = "message") -> DataFrame:
    """(sha, role, name, email) of review trailers in messages."""
    lines = commits_df.select(key, F.explode(F.split(message, "\n")).alias("line"))
    pattern = r"(?i)^\s*(Reviewed|Approved|Acked|Signed-off|Co-authored)-by:\s*([^<]*?)\s*(?:<([^>]*)>)?\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.filter(F.col("line").rlike(pattern)).select(key, F.lower(part(1)).alias("role"), F.when(part(2) != "", part(2)).alias("name"), F.when(part(3) != "", F.lower(part(3))).alias("email"))
