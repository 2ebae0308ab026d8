"""Scalar functions as Column expressions: identifiers, versions, commit messages, agents, links and paths.  All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- identifiers ---------------------------------------------------------------------------------------------------------------------------------


def escape_name(c: Column) -> Column:
    """Percent-encode everything but letters, digits, underscore, dot and hyphen."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def unescape_name(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def short_hash(c: Column, length: int = 12) -> Column:
    """First hex digits of the SHA-256 of a text; 64 and more give all of it."""
    h = F.sha2(c, 256)
    return h if length >= 64 else F.substring(h, 1, length)


def agent_id(email: Column) -> Column:
    return short_hash(F.lower(F.trim(email)), 12)


def content_id(content: Column) -> Column:
    """Hash of a text with runs of white space as one blank."""
    return short_hash(F.trim(F.regexp_replace(content, r"\s+", " ")), 16)


def iri_module(base: Column, module: Column) -> Column:
    return F.concat(base, escape_name(module))


def iri_function(base: Column, module: Column, name: Column, arity: Column) -> Column:
    return F.concat(base, escape_name(module), F.lit("/"), escape_name(name), F.lit("/"), arity.cast("string"))


def iri_child(parent: Column, *parts: Column) -> Column:
    """Child of a resource, such as ``parent/clause/0``."""
    return F.concat_ws("/", parent, *[p.cast("string") for p in parts])


def iri_file(base: Column, path: Column) -> Column:
    return F.concat(base, F.lit("file/"), F.array_join(F.transform(F.split(path, "/"), escape_name), "/"))


def iri_location(file_iri: Column, first: Column, last: Column) -> Column:
    return F.concat(file_iri, F.lit("/L"), first.cast("string"), F.lit("-"), last.cast("string"))


def iri_repository(base: Column, url: Column) -> Column:
    return F.concat(base, F.lit("repo/"), short_hash(url, 8))


def iri_commit(repository: Column, sha: Column) -> Column:
    return F.concat(repository, F.lit("/commit/"), sha)


#: Forms of resource names, the first that matches wins.
IRI_FORMS = [
    ("parameter", r"^(.+)/clause/(\d+)/param/(\d+)$"),
    ("clause", r"^(.+)/(\d+)/clause/(\d+)$"),
    ("location", r"^(.+)/L(\d+)-(\d+)$"),
    ("commit", r"^(.+#repo/[a-f0-9]+)/commit/([a-f0-9]+)$"),
    ("repository", r"^(.+#)repo/([a-f0-9]+)$"),
    ("file", r"^(.+#)file/(.+)$"),
    ("function", r"^(.+#)([A-Za-z_][A-Za-z0-9_.%]*)/([^/]+)/(\d+)$"),
    ("module", r"^(.+#)([A-Za-z_][A-Za-z0-9_.%]*)$"),
]


def iri_parameter(clause: Column, n: Column) -> Column:
    return iri_child(clause, F.lit("param"), n)


def iri_clause(function: Column, n: Column) -> Column:
    """Clauses count from 0."""
    return iri_child(function, F.lit("clause"), n)


def iri_type(base: Column, module: Column, name: Column, arity: Column) -> Column:
    return iri_child(iri_module(base, module), F.lit("type"), escape_name(name), arity)


def iri_within(parent: Column, kind: str, *parts: Column) -> Column:
    """Resource within a module, function or other context by its kind and place: ``invocation/m/i``, ``attribute/a``, ``attribute/a/i``, ``quote/i``,
    ``unquote/i``, ``hygiene/i``, ``alias/i``, ``import/i``, ``require/i``, ``use/i``, ``option/i``, ``anon/i``, ``clause/i``, ``capture/v``, ``&/i`` and
    ``child/id/i``.  Parts that are texts are escaped."""
    if kind not in IRI_WITHIN or len(parts) not in IRI_WITHIN[kind]:
        raise ValueError(f"no resource {kind} with {len(parts)} parts")
    return iri_child(parent, F.lit(kind), *[escape_name(p.cast("string")) for p in parts])


#: Kinds of resources within others and how many parts their names have.
IRI_WITHIN = {"invocation": (2,), "attribute": (1, 2), "quote": (1,), "unquote": (1,), "hygiene": (1,), "alias": (1,), "import": (1,), "require": (1,), "use": (1,), "option": (1,), "anon": (1,), "clause": (1,), "capture": (1,), "&": (1,), "child": (2,)}


def iri_tree(base: Column, application: Column) -> Column:
    return F.concat(base, F.lit("tree/"), escape_name(application))


def iri_call(base: Column, caller: Column, n: Column) -> Column:
    return F.concat_ws("/", F.concat(base, F.lit("call")), escape_name(caller), n.cast("string"))


def iri_parts(c: Column) -> Column:
    """struct<kind, parts> of a resource name: the groups of its form, in order; null where no form matches."""
    out = F.lit(None).cast("struct<kind: string, parts: array<string>>")
    for kind, pattern in reversed(IRI_FORMS):
        groups = F.array(*[F.regexp_extract(c, pattern, i + 1) for i in range(pattern.count("(") - pattern.count("(?"))])
        out = F.when(F.rlike(c, F.lit(pattern)), F.struct(F.lit(kind).alias("kind"), groups.alias("parts"))).otherwise(out)
    return F.when(c.isNotNull(), out)


def module_from(c: Column) -> Column:
    """Name of the module that a module's, function's, clause's or parameter's resource belongs to; null for others."""
    return F.when(iri_kind(c).isin("module", "function", "clause", "parameter"), unescape_name(F.regexp_extract(c, r"#([^/]+)", 1)))


def function_from(c: Column) -> Column:
    """struct<module, name, arity> of the function of a function's, clause's or parameter's resource; null for others."""
    pattern = r"#([^/]+)/([^/]+)/(\d+)(?:/clause/.*)?$"
    part = lambda i: unescape_name(F.regexp_extract(c, pattern, i))
    return F.when(iri_kind(c).isin("function", "clause", "parameter"), F.struct(part(1).alias("module"), part(2).alias("name"), F.regexp_extract(c, pattern, 3).cast("int").alias("arity")))


def iri_kind(c: Column) -> Column:
    out = F.when(c.isNull(), None)
    for kind, pattern in IRI_FORMS:
        out = out.when(F.rlike(c, F.lit(pattern)), kind)
    return out


# --- versions ------------------------------------------------------------------------------------------------------------------------------------

SEMVER = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def semver(c: Column) -> Column:
    """struct<major, minor, patch, pre, build>; null for a text that is no version."""
    part = lambda i: F.regexp_extract(c, SEMVER, i)
    text = lambda i: F.when(part(i) != "", part(i))
    return F.when(F.rlike(c, F.lit(SEMVER)), F.struct(part(1).try_cast("int").alias("major"), part(2).try_cast("int").alias("minor"), part(3).try_cast("int").alias("patch"), text(4).alias("pre"), text(5).alias("build")))


def semver_key(c: Column) -> Column:
    """Sort key: numbers first, a release above its pre-releases, texts that are no versions by themselves below all."""
    v = semver(c)
    return F.struct(v["major"].alias("a"), v["minor"].alias("b"), v["patch"].alias("c"), v["pre"].isNull().alias("d"), F.coalesce(v["pre"], F.lit("")).alias("e"), c.alias("f"))


def latest_stable(explicit: Column, latest: Column, releases: Column) -> Column:
    """Explicit stable version, else the first release without a pre-release part, else the latest version, else the first release."""
    stable = F.filter(releases, lambda r: ~F.contains(r["version"], F.lit("-")))
    return F.coalesce(explicit, F.get(stable, 0)["version"], latest, F.get(releases, 0)["version"])


# --- commit messages -----------------------------------------------------------------------------------------------------------------------------

CONVENTIONAL = r"(?s)^(\w+(?:-\w+)*)(?:\(([^)]*)\))?(!)?\s*:\s*(.+)$"
#: Prefixes of conventional commits and their types.
PREFIX_TYPES = {
    "feat": "feature", "feature": "feature", "fix": "bugfix", "bugfix": "bugfix", "hotfix": "bugfix", "refactor": "refactor", "docs": "docs", "doc": "docs", "test": "test", "tests": "test", "chore": "chore", "build": "chore", "style": "style",
    "format": "style", "perf": "perf", "performance": "perf", "ci": "ci", "revert": "revert", "deps": "deps", "dep": "deps", "release": "release", "wip": "wip",
}
#: Word patterns of commit types, the first that matches wins.
KEYWORD_TYPES = [
    ("revert", r"(?i)^revert\b"),
    ("docs", r"(?i)\b(doc|docs|documentation|readme|comment|comments|javadoc|typedoc|moduledoc)\b"),
    ("test", r"(?i)\b(test|tests|testing|spec|specs|coverage)\b"),
    ("perf", r"(?i)\b(perf|performance|optimize|optimized|optimization|speed|faster|cache|caching)\b"),
    ("bugfix", r"(?i)\b(fix|fixed|fixing|bug|bugfix|repair|resolve|resolved|resolves|closes?|closed)\b"),
    ("refactor", r"(?i)\b(refactor|refactored|refactoring|restructure|reorganize|cleanup|clean up|simplify)\b"),
    ("chore", r"(?i)\b(chore|build|tooling|config|configure|setup|maintenance)\b"),
    ("style", r"(?i)\b(style|format|formatting|lint|linting|prettier|credo)\b"),
    ("ci", r"(?i)\b(ci|cd|pipeline|github actions|travis|circle|jenkins|workflow)\b"),
    ("deps", r"(?i)\b(deps|dependency|dependencies|upgrade|update|bump|version)\s+(mix\.exs|package\.json|gemfile)"),
    ("release", r"(?i)\b(release|version|v?\d+\.\d+\.\d+|bump version|prepare release)\b"),
    ("wip", r"(?i)\b(wip|work in progress|todo|fixme|hack)\b"),
    ("feature", r"(?i)\b(add|added|adding|implement|implemented|implementing|new|create|created|introduce|introduced)\b"),
]
BREAKING = r"(?i)\bbreaking\b"


def subject(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def conventional(message: Column) -> Column:
    """struct<type, scope, breaking, description> of a message's first line; null where it is not of that form."""
    s = subject(message)
    part = lambda i: F.regexp_extract(s, CONVENTIONAL, i)
    return F.when(F.rlike(s, F.lit(CONVENTIONAL)), F.struct(F.lower(part(1)).alias("type"), F.when(part(2) != "", part(2)).alias("scope"), (part(3) == "!").alias("breaking"), F.trim(part(4)).alias("description")))


def _first(pairs, c: Column, otherwise) -> Column:
    out = None
    for name, pattern in pairs:
        hit = F.rlike(c, F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def classify_commit(message: Column) -> Column:
    """struct<type, method, confidence>: by prefix, else by the first keyword pattern; a prefix that is not listed stays unknown."""
    s = subject(message)
    is_conventional = F.rlike(s, F.lit(CONVENTIONAL))
    prefix = F.lower(F.regexp_extract(s, CONVENTIONAL, 1))
    table = F.create_map(*[F.lit(x) for kv in PREFIX_TYPES.items() for x in kv])
    by_word = _first(KEYWORD_TYPES, s, "unknown")
    kind = F.when(is_conventional, F.coalesce(F.try_element_at(table, prefix), F.lit("unknown"))).otherwise(by_word)
    method = F.when(is_conventional, "conventional_commit").otherwise("keyword")
    confidence = F.when(is_conventional, "high").when(by_word != "unknown", "medium").otherwise("low")
    return F.when(message.isNotNull(), F.struct(kind.alias("type"), method.alias("method"), confidence.alias("confidence")))


#: Prefixes that the activity model knows; case matters, and only ``(`` or ``:`` may follow.
ACTIVITY_PREFIXES = [("feature", "^(feat|feature)[(:]"), ("bugfix", "^(fix|bugfix)[(:]"), ("refactor", "^refactor[(:]"), ("docs", "^docs[(:]"), ("test", "^test[(:]"), ("chore", "^(chore|build)[(:]"), ("style", "^style[(:]"), ("perf", "^perf[(:]"), ("ci", "^ci[(:]"), ("revert", "^revert[(:]"), ("deps", "^(deps|dep)[(:]"), ("release", "^release[(:]")]


def activity_type(message: Column, is_merge: Column | None = None) -> Column:
    other = F.lit("commit") if is_merge is None else F.when(is_merge, "merge").otherwise("commit")
    return _first(ACTIVITY_PREFIXES, message, other)


def is_breaking(text: Column) -> Column:
    """Whether a message announces a breaking change, by its markers or by the word."""
    return F.contains(text, F.lit("BREAKING CHANGE")) | F.contains(text, F.lit("BREAKING:")) | F.rlike(text, F.lit(BREAKING))


#: References to issues of trackers, after a verb that closes them and anywhere.
ISSUE_CLOSED = r"(?i:\b(?:fix(?:es)?|close[sd]?|resolve[sd]?)\s+)((?i:#\d+|GH-\d+|GL-\d+)|[A-Z][A-Z0-9]+-\d+)"
ISSUE_NUMBER, ISSUE_KEY = r"(?:^|[^A-Za-z])(#\d+)", r"\b((?i:GH-\d+|GL-\d+)|[A-Z][A-Z0-9]+-\d+)"


def closed_issues(text: Column) -> Column:
    """References that a text closes, such as #12, GH-3 or ABC-4, each once and in order of text; empty for a null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ISSUE_CLOSED), 1), F.upper))), F.array().cast("array<string>"))


def mentioned_issues(text: Column) -> Column:
    """References that a text makes without closing them."""
    found = F.concat(F.regexp_extract_all(text, F.lit(ISSUE_NUMBER), 1), F.regexp_extract_all(text, F.lit(ISSUE_KEY), 1))
    return F.coalesce(F.array_sort(F.array_except(F.transform(found, F.upper), closed_issues(text))), F.array().cast("array<string>"))


def tracker_of(reference: Column) -> Column:
    return F.when(F.startswith(reference, F.lit("#")), "generic").when(F.startswith(reference, F.lit("GH-")), "github").when(F.startswith(reference, F.lit("GL-")), "gitlab").otherwise("jira")


def files_type(paths: Column) -> Column:
    """Type of a commit by its files alone: tests, documentation, dependencies or pipelines where all of them are such; unknown otherwise and for none."""
    ends = lambda p, *xs: _any([F.endswith(p, F.lit(x)) for x in xs])
    begins = lambda p, *xs: _any([F.startswith(p, F.lit(x)) for x in xs])
    # fixed values: places and endings of files of each type
    is_test = lambda p: F.contains(p, F.lit("/test/")) | ends(p, "_test.exs", "_test.ex", ".test.js", ".spec.js")
    is_doc = lambda p: ends(p, ".md", ".txt", ".rst") | begins(p, "docs/") | p.isin("README", "CHANGELOG")
    is_ci = lambda p: begins(p, ".github/", ".circleci/", ".travis") | p.isin(".gitlab-ci.yml", "Jenkinsfile")
    every = lambda f: (F.size(paths) > 0) & F.forall(paths, f)
    mix = F.array_sort(paths).isin(F.array(F.lit("mix.exs")), F.array(F.lit("mix.exs"), F.lit("mix.lock")))
    return F.when(every(is_test), "test").when(every(is_doc), "docs").when(mix, "deps").when(every(is_ci), "ci").otherwise("unknown")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def issue_url(tracker: Column, repo: Column, number: Column) -> Column:
    n = number.cast("string")
    return F.when(tracker == "github", F.concat(repo, F.lit("/issues/"), n)).when(tracker == "gitlab", F.concat(repo, F.lit("/-/issues/"), n)).when(tracker == "jira", F.concat(repo, F.lit("/browse/"), n))


# --- agents --------------------------------------------------------------------------------------------------------------------------------------

#: Patterns of automated agents.
BOTS = r"(?i)\[bot\]@|dependabot|renovate|greenkeeper|snyk-bot|semantic-release-bot|release-bot|mergify|codecov|coveralls|bors\[bot\]|allcontributors"
CI = r"(?i)action@github\.com|noreply@github\.com|gitlab-ci@|jenkins@|travis@|circleci@|azure-pipelines|bitbucket-pipelines"
ASSISTANTS = r"(?i)copilot|cursor|codeium|tabnine"


#: Traces of assistants in messages.
ASSISTED = r"(?i)Co-authored-by:.*(copilot|cursor|claude|anthropic)|Generated by.*AI|AI-assisted"


def agent_type_of_commit(email: Column, name: Column, message: Column) -> Column:
    """Type of an agent; one who is still a developer counts as assisted where the message says so."""
    base = agent_type(email, name)
    return F.when((base == "developer") & F.coalesce(F.rlike(message, F.lit(ASSISTED)), F.lit(False)), "llm").otherwise(base)


def agent_type(email: Column, name: Column) -> Column:
    who = F.concat_ws(" ", name, email)
    return F.when(F.rlike(who, F.lit(BOTS)), "bot").when(F.rlike(email, F.lit(CI)), "ci").when(F.rlike(who, F.lit(ASSISTANTS)), "llm").otherwise("developer")


# --- repositories and paths ----------------------------------------------------------------------------------------------------------------------

REMOTE = r"^(?:https?://|ssh://(?:[^@/]+@)?|git://|[^@/\s]+@)([^/:]+)(?::\d+)?[/:](.+?)(?:\.git)?/?$"


def remote(url: Column) -> Column:
    """struct<host, owner, repo> of a remote address; null for other texts."""
    path = F.regexp_extract(url, REMOTE, 2)
    return F.when(F.rlike(url, F.lit(REMOTE)), F.struct(F.regexp_extract(url, REMOTE, 1).alias("host"), F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("owner"), F.regexp_extract(path, r"([^/]+)$", 1).alias("repo")))


def platform(host: Column, custom: dict[str, str] | None = None) -> Column:
    out = None
    for name, kind in {**(custom or {}), "github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}.items():
        hit = (host == name) | F.endswith(host, F.lit("." + name))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def permalink(kind: Column, base: Column, commit: Column, path: Column, line: Column) -> Column:
    n = line.cast("string")
    return (
        F.when(kind == "github", F.concat(base, F.lit("/blob/"), commit, F.lit("/"), path, F.lit("#L"), n))
        .when(kind == "gitlab", F.concat(base, F.lit("/-/blob/"), commit, F.lit("/"), path, F.lit("#L"), n))
        .when(kind == "bitbucket", F.concat(base, F.lit("/src/"), commit, F.lit("/"), path, F.lit("#lines-"), n))
    )


def module_of_path(path: Column) -> Column:
    """Module that a source path suggests: lib/ and the ending dropped, parts in camel case."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^(lib|test)/", ""), r"\.exs?$", ""), "/")
    camel = lambda x: F.replace(F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.array_join(F.transform(parts, camel), ".")


def safe_file_name(c: Column) -> Column:
    """Characters that file systems forbid, and doubled dots, as underscores; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r'[/\\:*?"<>|]|\.\.', "_"), "^_+|_+$", "")


def owner_pattern(glob: Column, compat: bool = True) -> Column:
    """Regular expression of an ownership glob; compat keeps the rewriting of the second star of ``**``."""
    escaped = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    if compat:
        body = F.regexp_replace(F.replace(escaped, F.lit("**"), F.lit(".*")), r"\*", "[^/]*")
    else:
        body = F.replace(F.regexp_replace(F.replace(escaped, F.lit("**"), F.lit("\u0001")), r"\*", "[^/]*"), F.lit("\u0001"), F.lit(".*"))
    anchored = F.when(F.startswith(glob, F.lit("/")), F.concat(F.lit("^"), F.substr(body, F.lit(2)))).otherwise(F.concat(F.lit("(^|/)"), body))
    return F.concat(F.regexp_replace(anchored, "/$", ""), F.lit("($|/)"))


def valid_sha(c: Column, short: bool = False) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"(?i)^[0-9a-f]{7,40}$" if short else r"(?i)^[0-9a-f]{40}$")), F.lit(False))


#: Forms of references that are safe to hand on.
SAFE_REF = r"^(?:HEAD|HEAD~\d+|HEAD\^\d*|[0-9a-fA-F]{7,40}|refs/(?:heads|tags|remotes)/[a-zA-Z0-9_\-./]+|[a-zA-Z][a-zA-Z0-9_\-.]*)$"


def valid_ref(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(SAFE_REF)), F.lit(False))


def safe_path(c: Column) -> Column:
    """Whether a path is relative and stays below its root; false for a null."""
    return F.coalesce(~F.rlike(c, F.lit(r"\.\.|\x00|^/|//")), F.lit(False))


def normal_path(c: Column) -> Column:
    """Forward slashes, none doubled or at the end, no single dots."""
    p = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))
    return F.regexp_replace(F.regexp_replace(p, r"/(?:\./)+", "/"), r"^\./", "")


def without_traversal(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.\.+", ""), "^/+", "")


def relative_path(path: Column, root: Column) -> Column:
    """Path below a root; ``.`` for the root itself, null for paths elsewhere."""
    p, r = normal_path(path), normal_path(root)
    below = F.concat(r, F.lit("/"))
    return F.when(p == r, ".").when(F.startswith(p, below), F.substr(p, F.length(below) + 1)).when(~F.startswith(p, F.lit("/")) & safe_path(p), p)


def anonymous(email: Column) -> Column:
    return F.sha2(email, 256)


def replacement(text: Column) -> Column:
    """struct<module, name, arity> of the function that a note names as replacement; null where it names none.  The fullest form counts."""
    full, call, local, atom = r"([A-Z][\w.]+)\.([a-z_][a-z0-9_]*[!?]?)/(\d+)", r"([A-Z][\w.]+)\.([a-z_][a-z0-9_]*[!?]?)\b", r"\b([a-z_][a-z0-9_]*[!?]?)/(\d+)", r":([a-z_][a-z0-9_]*)\b"
    x = lambda p, i: F.regexp_extract(text, p, i)
    row = lambda m, n, a: F.struct(m.alias("module"), n.alias("name"), a.alias("arity"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("int")
    return F.when(F.rlike(text, F.lit(full)), row(x(full, 1), x(full, 2), x(full, 3).cast("int"))).when(F.rlike(text, F.lit(call)), row(x(call, 1), x(call, 2), no)).when(F.rlike(text, F.lit(local)), row(none, x(local, 1), x(local, 2).cast("int"))).when(F.rlike(text, F.lit(atom)), row(none, x(atom, 1), no))


#: Types of failures by what their texts say, the first that matches wins.
ERROR_TYPES = [("download_error", r"(?i)not.found|rate.?limit|http|connection|download"), ("extraction_error", r"(?i)tar|extract|archive|checksum"), ("not_elixir", r"(?i)not.elixir|no.elixir"), ("output_error", r"(?i)disk|write|output|enospc"), ("timeout", r"(?i)time.?out|timed out"), ("analysis_error", r"(?i)analy|parse|memory|killed|raise|exception")]


def error_type(text: Column) -> Column:
    """One of seven types of failure; unknown for other texts and for a null."""
    return _first(ERROR_TYPES, text, "unknown")


def _tenths(n: Column, unit: int) -> Column:
    """n in units with one decimal, halves up, in whole-number arithmetic."""
    t = F.floor((n.cast("bigint") * 10 + unit // 2) / unit)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def bytes_text(n: Column) -> Column:
    of = lambda unit, name: F.concat(_tenths(n, unit), F.lit(name))
    return F.when(n >= 1 << 30, of(1 << 30, " GB")).when(n >= 1 << 20, of(1 << 20, " MB")).when(n >= 1024, of(1024, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def duration_text(ms: Column) -> Column:
    minutes = F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), F.floor(ms % 60_000 / 1000).cast("string"), F.lit("s"))
    return F.when(ms >= 60_000, minutes).when(ms >= 1000, F.concat(_tenths(ms, 1000), F.lit("s"))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def line_age(written: Column, now: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(written)) / 86_400)
