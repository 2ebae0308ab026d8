"""Provenance of code: activities, agents, entities and their relations as tables and as statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import terms as T
from .graph import reachable


def entity_id(path: Column, short_sha: Column) -> Column:
    return F.concat(path, F.lit("@"), short_sha)


def activities(commits: DataFrame) -> DataFrame:
    """One activity per commit, started at the author's and ended at the committer's date."""
    return commits.select(F.concat(F.lit("activity:"), "short_sha").alias("activity"), "sha", S.activity_type(F.col("message"), F.col("is_merge")).alias("type"), F.col("author_date").alias("started"), F.col("commit_date").alias("ended"), "author_email")


def usage(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(activity, entity, role): used = modified or deleted at the first parent, generated = added or modified, invalidated = modified only.

    A rename counts as a modification of the new path; a commit without parents uses nothing.
    """
    c = commits.select("sha", F.concat(F.lit("activity:"), "short_sha").alias("activity"), "short_sha", F.substring(F.get("parents", F.lit(0)), 1, 7).alias("parent"))
    f = files.select("sha", F.when(F.col("status") == "R", "M").otherwise(F.col("status")).alias("status"), "path").join(c, "sha")
    old, new = entity_id(F.col("path"), F.col("parent")), entity_id(F.col("path"), F.col("short_sha"))
    roles = F.array(
        F.struct(F.when(F.col("status").isin("M", "D"), old).alias("entity"), F.lit("used").alias("role")), F.struct(F.when(F.col("status").isin("A", "M"), new).alias("entity"), F.lit("generated").alias("role")), F.struct(F.when(F.col("status") == "M", old).alias("entity"), F.lit("invalidated").alias("role"))
    )
    return f.select("activity", F.explode(roles).alias("r")).select("activity", "r.entity", "r.role").filter("entity is not null")


def communication(commits: DataFrame) -> DataFrame:
    """(informed, informant) for every parent; the inverse is the same table read the other way."""
    return commits.select(F.concat(F.lit("activity:"), "short_sha").alias("informed"), F.explode(F.transform("parents", lambda p: F.concat(F.lit("activity:"), F.substring(p, 1, 7)))).alias("informant"))


def agents(commits: DataFrame) -> DataFrame:
    """Agents by address in lower case, authors and committers; a missing address is ``unknown@unknown``."""
    side = lambda n, e, d: commits.select(F.col(n).alias("name"), F.lower(F.coalesce(F.col(e), F.lit("unknown@unknown"))).alias("email"), F.col(d).alias("at"), "sha")
    both = side("author_name", "author_email", "author_date").unionByName(side("committer_name", "committer_email", "commit_date"))
    g = both.groupBy("email").agg(F.max_by("name", F.struct("at", "sha")).alias("name"), F.array_sort(F.collect_set("name")).alias("names"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count_distinct("sha").alias("activities"))
    return g.select(S.agent_id(F.col("email")).alias("agent"), "*", S.agent_type(F.col("email"), F.col("name")).alias("type"))


def file_history(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, sha, position, path_then, status): the history of each path that is the last name of a file, newest first, through its renames.

    A rename links the new name to the old one as of its commit; names are followed back by the closure of these links, so a chain of any length takes
    as many rounds as its logarithm.  Changes of an older name count up to the rename that ended it.
    """
    at = files.join(commits.select("sha", "commit_date"), "sha").select("sha", "path", "old_path", "status", "commit_date")
    renames = at.filter("status = 'R' AND old_path IS NOT NULL").groupBy("old_path", "path").agg(F.max("commit_date").alias("until"))
    pairs = reachable(renames.select(F.col("path").alias("a"), F.col("old_path").alias("b")))
    names = at.select("path").distinct().join(renames.select(F.col("old_path").alias("path")), "path", "left_anti")
    older = pairs.join(names.select(F.col("path").alias("a")), "a", "left_semi").join(renames.groupBy(F.col("old_path").alias("b")).agg(F.max("until").alias("until")), "b")
    every = names.select("path", F.col("path").alias("path_then"), F.lit(None).cast("timestamp").alias("until")).unionByName(older.select(F.col("a").alias("path"), F.col("b").alias("path_then"), F.col("until").cast("timestamp").alias("until")))
    changes = every.join(at.withColumnRenamed("path", "path_then"), "path_then").filter(F.col("until").isNull() | (F.col("commit_date").cast("timestamp") < F.col("until")))
    w = Window.partitionBy("path").orderBy(F.col("commit_date").desc(), "sha")
    return changes.withColumn("position", F.row_number().over(w) - 1).select("path", "sha", "position", "path_then", "status")


#: Forms of the deprecation note, the first that matches wins.
DEPRECATION = [r'@deprecated\s+"([^"]+)"', r"@deprecated\s+'([^']+)'", r"@deprecated\s+~[sS]\[([^\]]+)\]", r"@deprecated\s+~[sS]/([^/]+)/", r"@deprecated\s+~[sS]\(([^)]+)\)", r"@deprecated\s+~[sS]\{([^}]+)\}"]


def deprecations(diff: DataFrame, source: str = "repo") -> DataFrame:
    """(repo, sha, file, message, element, line_no): an added deprecation and the next added definition of the file."""
    added = diff.filter("sign = '+'")
    found = [F.when(F.rlike("text", F.lit(p)), F.regexp_extract("text", p, 1)) for p in DEPRECATION]
    note = F.coalesce(*found, F.when(F.rlike("text", F.lit(r"@deprecated\s+true")), "Deprecated"))
    name = F.when(F.rlike("text", F.lit(r"\b(?:defp?|defmacrop?)\s+([a-z_]\w*[!?]?)")), F.regexp_extract("text", r"\b(?:defp?|defmacrop?)\s+([a-z_]\w*[!?]?)", 1))
    w = Window.partitionBy(source, "sha", "file").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    return added.withColumn("message", note).withColumn("element", F.first(name, ignorenulls=True).over(w)).filter("message is not null").select(source, "sha", "file", "message", "element", "line_no")


#: Words of the language that say nothing about a function's likeness.
_STOP = ["def", "defp", "do", "end", "if", "else", "case", "fn", "when", "true", "false"]


def code_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(text, r"[^\w]+"), lambda x: x != "")), F.array(*[F.lit(x) for x in _STOP]))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def refactorings(removed: DataFrame, added: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Renames and moves of functions within a commit.

    Both sides are (sha, file, name, arity, body).  Rename: another name, the same arity and a likeness above ``threshold``; move: the same name and
    arity in another file.  Both join by commit and arity, moves by the name as well, with the likeness as residual condition.
    """
    a = removed.select("sha", F.col("file").alias("old_file"), F.col("name").alias("old_name"), "arity", code_tokens(F.col("body")).alias("old_tokens"))
    b = added.select("sha", F.col("file").alias("new_file"), F.col("name").alias("new_name"), "arity", code_tokens(F.col("body")).alias("new_tokens"))
    j = a.join(b, ["sha", "arity"])
    like = jaccard(F.col("old_tokens"), F.col("new_tokens"))
    renamed = j.filter((F.col("old_name") != F.col("new_name")) & (like > threshold)).withColumn("kind", F.lit("rename_function"))
    named = a.join(b.withColumn("old_name", F.col("new_name")), ["sha", "arity", "old_name"])
    moved = named.filter(F.col("old_file") != F.col("new_file")).withColumn("kind", F.lit("move_function"))
    return renamed.unionByName(moved).select("sha", "kind", "old_file", "old_name", "new_file", "new_name", "arity", like.alias("likeness"))


def statements(commits: DataFrame, files: DataFrame, base: str = T.DATA) -> DataFrame:
    """Statements (g, s, p, o) of activities, agents and entities."""
    iri = lambda c: T.iri(F.concat(F.lit(base), S.escape_name(c)))

    def rows(df: DataFrame, s: Column, pairs) -> DataFrame:
        return df.select(iri(s).alias("s"), F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs])).alias("t")).select(F.lit("").alias("g"), "s", "t.p", "t.o").filter(F.col("o").isNotNull())

    act, u = activities(commits), usage(commits, files)
    when = lambda c: T.literal(T.lexical(F.col(c), "timestamp"), T.XSD + "dateTime")
    link = F.when(F.col("role") == "used", T.PROV + "used").when(F.col("role") == "generated", T.PROV + "generated").otherwise(T.PROV + "invalidated")
    parts = [
        rows(act, F.col("activity"), [(T.RDF_TYPE, T.constant(("iri", T.PROV + "Activity"))), (T.PROV + "startedAtTime", when("started")), (T.PROV + "endedAtTime", when("ended")), (T.EVO + "activityType", T.literal(F.col("type"))), (T.PROV + "wasAssociatedWith", iri(F.concat(F.lit("agent:"), S.agent_id(F.col("author_email")))))]),
        u.select(F.lit("").alias("g"), iri(F.col("activity")).alias("s"), link.alias("p"), iri(F.col("entity")).alias("o")),
        communication(commits).select(F.lit("").alias("g"), iri(F.col("informed")).alias("s"), F.lit(T.PROV + "wasInformedBy").alias("p"), iri(F.col("informant")).alias("o")),
        rows(agents(commits), F.concat(F.lit("agent:"), F.col("agent")), [(T.RDF_TYPE, T.constant(("iri", T.PROV + "Agent"))), (T.EVO + "developerName", T.literal(F.col("name"))), (T.EVO + "developerEmail", T.literal(F.col("email")))]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
