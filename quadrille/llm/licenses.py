"""License of each code file and package.

The opening comment of a code file, the license files of its package and the package's licence list name licenses in full, by short name or by text.

* Texts: TF-IDF vectors over word three-grams of the license bodies; the corpus gives the document frequencies.  The vectors of a batch of texts, as
  sparse rows, are multiplied with the templates by the postings of their n-grams.  A text is accepted by cosine, by its margin over the next
  template and by how much of the template it covers; what it took is subtracted, and the rest is compared again.
* Names: every window of up to six words around a distinctive word of a license's name is compared in the same way with the names that follow by rule
  from a license's id and title (their words, initials, and first word with version or number).  Distinctive are the words of the id, the initials and
  the first word of the title.

A file's license is the one all sources agree on, ``conflict`` if they name different ones and ``unknown`` if none names any; the same holds for a
directory with all that lies below it, and for a package.  Null and empty texts name none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from .syntax import language_of, normal
from .common import analyse, current, source_files

LICENSE_FILE = r"(?i)(^|/)(licen[cs]es?|copying|unlicense)([-.][\w-]+)?$"
COSINE, MARGIN, COVER, LEAST_GRAMS = 0.6, 0.02, 0.6, 8
NAME_COSINE, NAME_MARGIN, WINDOW = 0.97, 0.04, 6
#: Templates are compared in memory; a reference table beyond this many characters is refused.
MAX_TEMPLATE_CHARS = 20_000_000
_FILLER = frozenset("license licence licensed licenses version v ver the new old of a an identifier terms".split())
_NUMBERS = dict(zip("zero one two three four five six seven eight nine ten".split(), "0 1 2 3 4 5 6 7 8 9 10".split()))
_WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")


def name_words(text: str) -> list[str]:
    """Words of a name: small, number words as digits, versions without a trailing .0, fillers left out."""
    text = re.sub(r"(?<=\d)_(?=\d)", ".", text)
    out = []
    for w in _WORD.findall(text.lower()):
        w = _NUMBERS.get(w, w)
        if w[0].isdigit():
            w = re.sub(r"(?:\.0)+$", "", w)
        if w not in _FILLER:
            out.append(w)
    return out


def name_forms(license_id: str, title: str) -> list[tuple[str, ...]]:
    """Names of a license by rule."""
    ident, words = name_words(license_id), name_words(title)
    raw = [w for w in re.findall(r"[^\W\d_]+", title) if w.lower() not in ("version", "the", "of", "two", "three", "one", "zero")]
    numbers = [w for w in ident if w[0].isdigit()]
    letters = [w for w in ident if not w[0].isdigit()]
    initials = "".join(w[0] for w in raw if w.lower() not in _NUMBERS).lower()
    forms = {tuple(ident), tuple(words)}
    if numbers:
        forms |= {(initials, *numbers), (words[0], *numbers)}
        if len(letters) > 1:
            forms |= {(letters[0][0] + "".join(letters[1:]), *numbers), (letters[0], "".join(letters[1:]), *numbers)}
        # the title without its kind word at the end
        forms.add(tuple(w for w in words if w not in ("dedication", "agreement")))
    return sorted(f for f in forms if len(f) > 1)


def grams(text: str, n: int = 3) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]


@dataclass
class Weights:
    """Inverse document frequencies, and the norm and the sum of each template under them."""

    idf: np.ndarray
    norm: np.ndarray
    total: np.ndarray


class Templates:
    """Template vectors by the postings of their n-grams; ids are positions in ``licenses``, ``vocabulary`` maps a word n-gram to its position."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.licenses = [r[0] for r in rows]
        counts = [Counter(grams(b or "")) for _, _, b in rows]
        self.vocabulary = {g: i for i, g in enumerate(sorted({g for c in counts for g in c}))}
        entries = sorted((self.vocabulary[g], k, n) for k, c in enumerate(counts) for g, n in c.items())
        self.gram, self.holder, self.count = (np.asarray([e[i] for e in entries], dtype=np.int64) for i in range(3))
        self.begin = np.searchsorted(self.gram, np.arange(len(self.vocabulary) + 1))
        self.forms = [(k, f) for k, (i, t, _) in enumerate(rows) for f in name_forms(i, t or i)]
        owners: dict[str, set] = {}
        for k, f in self.forms:
            for w in f:
                owners.setdefault(w, set()).add(k)
        self.weight = {w: math.log(1 + len(rows) / len(ks)) for w, ks in owners.items()}
        tails = {w for i, t, _ in rows for w in name_words(t or "")[1:]} - {w for i, t, _ in rows for w in (*name_words(i), *name_words(t or "")[:1])}
        self.keys = {w for w in owners if not w[0].isdigit() and len(w) > 2 and w not in tails}
        self.form_vectors = [(k, Counter(f), math.sqrt(sum((self.weight[w] * n) ** 2 for w, n in Counter(f).items()))) for k, f in self.forms]

    def names_in(self, text: str) -> list[int]:
        """Licenses named in a text: for each key word the best window around it, if it is clear."""
        words = name_words(text)
        found = set()
        for i, w in enumerate(words):
            if w not in self.keys:
                continue
            best: dict[int, tuple[float, int]] = {}
            for a in range(max(0, i - WINDOW + 1), i + 1):
                for b in range(i + 1, min(len(words), a + WINDOW) + 1):
                    c = Counter(words[a:b])
                    norm = math.sqrt(sum((self.weight.get(x, 2.0) * n) ** 2 for x, n in c.items()))
                    for k, f, fn in self.form_vectors:
                        if w not in f:
                            continue
                        dot = sum(self.weight[x] ** 2 * n * c[x] for x, n in f.items() if x in c)
                        s = (dot / norm / fn, b - a)
                        if s > best.get(k, (0, 0)):
                            best[k] = s
            if best:
                # of equal cosines the longer window is the fuller name
                ranked = sorted(((round(s, 4), n, k) for k, (s, n) in best.items()), reverse=True)
                top = ranked[0]
                if top[0] >= NAME_COSINE and (len(ranked) == 1 or (top[0], top[1]) > (ranked[1][0] + NAME_MARGIN, 0) or top[0] == ranked[1][0] and top[1] > ranked[1][1]):
                    found.add(top[2])
        return sorted(found)

    def known_grams(self, text: str) -> list[int]:
        v = self.vocabulary
        return [v[g] for g in grams(text) if g in v]

    def weigh(self, idf: np.ndarray) -> Weights:
        w = self.count * idf[self.gram]
        return Weights(idf, np.sqrt(np.bincount(self.holder, w * w, len(self.licenses))), np.bincount(self.holder, w, len(self.licenses)))

    def texts_in(self, texts: list[list[int]], weights: Weights) -> list[list[int]]:
        """Licenses whose bodies stand in each of a batch of texts, given their n-grams of the vocabulary: one sparse product a round for all texts."""
        found: list[list[int]] = [[] for _ in texts]
        size, k = len(self.vocabulary), len(self.licenses)
        pairs, tf = np.unique(np.concatenate([np.asarray(t, dtype=np.int64) + i * size for i, t in enumerate(texts)] or [np.empty(0, np.int64)]), return_counts=True)
        text, gram, tf = pairs // max(size, 1), pairs % max(size, 1), tf.astype(float)
        for _ in range(k):
            alive = np.bincount(text, tf, len(texts))[text] >= LEAST_GRAMS if len(text) else np.zeros(0, bool)
            text, gram, tf = text[alive & (tf > 0)], gram[alive & (tf > 0)], tf[alive & (tf > 0)]
            if not len(text):
                break
            x = tf * weights.idf[gram]
            norm = np.sqrt(np.bincount(text, x * x, len(texts)))
            # every entry of a text meets the postings of its n-gram
            many = self.begin[gram + 1] - self.begin[gram]
            entry = np.repeat(np.arange(len(text)), many)
            post = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[gram], many)
            w = self.count[post] * weights.idf[gram[entry]]
            cell, inverse = np.unique(text[entry] * k + self.holder[post], return_inverse=True)
            row, column = cell // k, cell % k
            cosine = np.bincount(inverse, x[entry] * w) / norm[row] / weights.norm[column]
            cover = np.bincount(inverse, w) / weights.total[column]
            order = np.lexsort((column, -cosine, row))
            row, column, cosine, cover = row[order], column[order], cosine[order], cover[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            second = np.minimum(first + 1, len(row) - 1)
            margin = cosine[first] - np.where((second > first) & (row[second] == row[first]), cosine[second], 0.0)
            good = first[(cosine[first] >= COSINE) & (cover[first] >= COVER) & (margin >= MARGIN)]
            taken = np.full(len(texts), -1)
            taken[row[good]] = column[good]
            for r in row[good]:
                found[r].append(int(taken[r]))
            mine = self.holder[post] == taken[text[entry]]
            tf = np.maximum(0.0, tf - np.bincount(entry[mine], self.count[post[mine]], len(text)))
            tf[taken[text] < 0] = 0.0
        return found


_OPENING = {
    "elixir": re.compile(r"(?:#!.*\n)?(?:\s|#[^\n]*(?:\n|$))*"),
    "python": re.compile(r"(?:#!.*\n)?(?:\s|#[^\n]*(?:\n|$))*"),
    "erlang": re.compile(r"(?:#!.*\n)?(?:\s|%[^\n]*(?:\n|$))*"),
    "javascript": re.compile(r"(?:#!.*\n)?(?:\s|//[^\n]*(?:\n|$)|/\*(?:[^*]|\*(?!/))*(?:\*/|$))*"),
}


def opening_comment(path: str | None, text: str) -> str:
    lang = language_of(path)
    if lang not in _OPENING:
        return ""
    m = _OPENING[lang].match(text)
    return re.sub(r"(?m)^[ \t]*(?:#+!?|%+|//+|/\*+!?|\*+/?)+[ \t]?|\*+/[ \t]*$", "", m.group()).strip()


def evidence(files: DataFrame, templates: Templates) -> DataFrame:
    """(file_id, package, path, is_file, names, terms) of the current state of every file; is_file: a license file."""

    def look(path: str | None, content: str | None) -> tuple:
        text = normal(content)
        is_file = bool(re.search(LICENSE_FILE, path or ""))
        s = text if is_file else opening_comment(path, text)
        return is_file, templates.names_in(s) if s else [], templates.known_grams(s) if s else []

    rows = analyse(files, look, "struct<is_file boolean, names array<int>, terms array<int>>", None, keep="package string, path string")
    return current(rows, "package", "path", "result").select("file_id", "package", "path", "result.*")


def licenses_of(files: DataFrame, packages: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Licenses named (arrays of ids) by each file itself, (file_id, package, path, is_file, own), and by each package, (package, named)."""
    if (reference.agg(F.sum(F.length("body"))).first()[0] or 0) > MAX_TEMPLATE_CHARS:
        raise ValueError("the reference table of licenses is too large to be compared in memory")
    t = Templates([tuple(r) for r in reference.select("license_id", "title", "body").orderBy("license_id").collect()])
    seen = stored(evidence(files, t), "licenses")
    with_text = seen.filter(F.size("terms") > 0)
    # document frequencies over the whole corpus; one row per n-gram of the templates comes back
    df = np.zeros(len(t.vocabulary))
    total = 1
    for term, n in with_text.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().collect():
        df[term] = n
    total = max(1, with_text.count())
    weights = t.weigh(np.log((1 + total) / (1 + df)) + 1)
    ids = t.licenses

    @F.pandas_udf("array<string>")
    def named(names: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([sorted({ids[k] for k in (*a, *b)}) for a, b in zip(names, t.texts_in([list(x) for x in terms], weights))])

    own = seen.select("file_id", "package", "path", "is_file", named("names", "terms").alias("own"))
    by_files = own.filter("is_file").select("package", F.explode("own").alias("license"))

    @F.pandas_udf("array<string>")
    def from_list(lists: pd.Series) -> pd.Series:
        return pd.Series([sorted({ids[k] for s in (x if x is not None else ()) if s for k in t.names_in(s)}) for x in lists])

    meta = packages.groupBy("name").agg(F.max_by("meta.licenses", F.struct("updated_at", F.to_json("meta.licenses"))).alias("l"))
    by_meta = meta.select(F.col("name").alias("package"), F.explode(from_list("l")).alias("license"))
    per_package = by_files.unionByName(by_meta).groupBy("package").agg(F.collect_set("license").alias("named"))
    return own, per_package


def _verdict(found) -> F.Column:
    return F.when(F.size(found) == 0, "unknown").when(F.size(found) > 1, "conflict").otherwise(found[0])


def file_licenses(files: DataFrame, packages: DataFrame, reference: DataFrame) -> DataFrame:
    """(file_id, license) of every current file."""
    own, per_package = licenses_of(files, packages, reference)
    j = own.join(per_package, "package", "left")
    # license files count through their package
    every = F.array_distinct(F.concat(F.when(F.col("is_file"), F.array().cast("array<string>")).otherwise(F.col("own")), F.coalesce("named", F.array().cast("array<string>"))))
    return j.select("file_id", _verdict(every).alias("license"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return file_licenses(source_files(spark, folder), table(spark, folder, "package"), table(spark, folder, "license_ref"))


def p6_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(package, license, files, disagreeing): verdict of each package and how many of its files name a license that it does not."""
    own, per_package = licenses_of(source_files(spark, folder), table(spark, folder, "package"), table(spark, folder, "license_ref"))
    j = own.join(per_package, "package", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    other = F.size(F.array_except("own", "named")) > 0
    return j.groupBy("package").agg(_verdict(F.max("named")).alias("license"), F.count("*").alias("files"), F.count_if(other).alias("disagreeing"))


def directory_licenses(own: DataFrame) -> DataFrame:
    """(package, directory, license, files, naming): verdict of each directory over all that lies in and below it; the package's own is empty.

    The files of a directory are reduced to its set of licenses before its ancestors are formed, so that a file is not repeated for each of them.
    """
    at = F.regexp_replace(F.regexp_replace(F.coalesce("path", F.lit("")), "/+", "/"), r"^(?:\./)+|^/", "")
    each = own.select("package", F.regexp_replace(at, "(^|/)[^/]*$", "").alias("directory"), "own")
    many = each.groupBy("package", "directory").agg(F.count("*").alias("files"), F.count_if(F.size("own") > 0).alias("naming"))
    sets = each.select("package", "directory", F.explode("own").alias("license")).groupBy("package", "directory").agg(F.collect_set("license").alias("named"))
    local = many.join(sets, many["package"].eqNullSafe(sets["package"]) & (many["directory"] == sets["directory"]), "left").select(many["package"], many["directory"], "files", "naming", "named")
    steps = F.split("directory", "/")
    above = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    up = local.select("package", F.explode(above).alias("directory"), "files", "naming", F.coalesce("named", F.array().cast("array<string>")).alias("named"))
    # of the licenses below a directory the least and the greatest tell whether they agree
    g = up.groupBy("package", "directory").agg(F.sum("files").alias("files"), F.sum("naming").alias("naming"), F.min(F.array_min("named")).alias("a"), F.max(F.array_max("named")).alias("b"))
    return g.select("package", "directory", F.when(F.col("a").isNull(), "unknown").when(F.col("a") != F.col("b"), "conflict").otherwise(F.col("a")).alias("license"), "files", "naming")


def p6_directories(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses of the directories of each package, with conflicts."""
    own, _ = licenses_of(source_files(spark, folder), table(spark, folder, "package"), table(spark, folder, "license_ref"))
    return directory_licenses(own)
