"""Sources and sinks of files: source trees, package pages, package outputs and query results."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as S


def source_tree(spark: SparkSession, root: str, pattern: str = "*.{ex,exs}", tests: bool = False) -> DataFrame:
    """(path, content, size, mtime, checksum) of the files below a folder that match, without ``test/`` by default; a mark at the start is dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rel = F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
    out = raw.select(rel.alias("path"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("content"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("checksum"))
    return out if tests else out.filter(~F.startswith("path", F.lit("test/")))


class _Page(InputPartition):
    def __init__(self, place: str, first: int, last: int | None):
        self.place, self.first, self.last = place, first, last


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        first, last = int(self.options.get("startPage", 1)), self.options.get("pages")
        if last is None:  # the list ends where a page is empty, which only reading tells
            return [_Page(self.options["path"], first, None)]
        return [_Page(self.options["path"], n, n) for n in range(first, int(last) + 1)]

    def page(self, place: str) -> list:
        """Items of one page, tried again as the server asks; a page that stays unreadable is an error, never an empty page."""
        if "://" not in place:
            try:
                with open(place, encoding="utf-8") as f:
                    return json.loads(f.read() or "[]")
            except FileNotFoundError:
                return []
        import time
        import urllib.error
        import urllib.request

        tries = int(self.options.get("retries", 4))
        for attempt in range(tries):
            try:
                with urllib.request.urlopen(place, timeout=30) as r:
                    return json.loads(r.read().decode() or "[]")
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return []
                last, wait = e, retry_after(e.code, e.headers, attempt, time.time())
            except (urllib.error.URLError, TimeoutError, ValueError) as e:
                last, wait = e, float(2**attempt)
            if attempt + 1 < tries:
                time.sleep(wait)
        raise OSError(f"page {place} could not be read") from last

    def read(self, partition: _Page) -> Iterator[tuple]:
        n = partition.first
        while partition.last is None or n <= partition.last:
            items = self.page(partition.place.replace("{page}", str(n)))
            if not items and partition.last is None:
                return
            for item in items:
                yield (n, json.dumps(item))
            n += 1


def retry_after(code: int, headers, attempt: int, now: float) -> float:
    """Seconds to wait: what the server's headers say, else longer with each attempt, and ten times as long where it limits the rate."""
    if headers.get("Retry-After", "").isdigit():
        return float(headers["Retry-After"])
    if headers.get("X-RateLimit-Remaining") == "0" and headers.get("X-RateLimit-Reset", "").isdigit():
        return max(0.0, float(headers["X-RateLimit-Reset"]) - now)
    return (10.0 if code == 429 else 1.0) * 2**attempt


class PagedJson(DataSource):
    """Pages of a JSON list as rows (page, item): options path with {page}, startPage, pages, retries.

    With ``pages`` they are read in parallel, else one after the other until one is empty.  A missing page is empty; one that cannot be read fails the
    query.  Local paths must be readable where the tasks run.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> _PageReader:
        return _PageReader(self.options)


def write_packages(df: DataFrame, folder: str, name: str = "name", version: str = "version") -> None:
    """One partition per package and version; only the partitions of this run are replaced."""
    out = df.withColumn("package", F.concat(S.safe_file_name(F.col(name)), F.lit("-"), S.safe_file_name(F.col(version))))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package").parquet(folder)


def render(df: DataFrame, form: str = "table", limit: int = 1000) -> str:
    """A small result as text: table, json or csv.  A result of more than ``limit`` rows is refused: it belongs into a file."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them to a file or raise the limit")
    if form == "json":
        return json.dumps([r.asDict(recursive=True) for r in rows], default=str, ensure_ascii=False)
    cells = [[("" if v is None else str(v)) for v in r] for r in rows]
    if form == "csv":
        quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
        return "\n".join(",".join(map(quote, line)) for line in [df.columns, *cells]) + "\n"
    widths = [max(len(x[i]) for x in [df.columns, *cells]) for i in range(len(df.columns))]
    line = lambda x: " | ".join(v.ljust(w) for v, w in zip(x, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, cells)]) + "\n"


def unpack(archives: DataFrame, name: str = "path", content: str = "content", max_member: int = 50_000_000) -> DataFrame:
    """(archive, checksum, member, size, text, error) of tar archives held as bytes, one row per member.

    Absolute paths, paths that lead out of the archive, links and members over ``max_member`` bytes give an error row and no text; an archive that
    cannot be read gives one error row.
    """
    import pandas as pd

    def run(batches):
        import hashlib
        import io
        import posixpath
        import tarfile

        for b in batches:
            rows = []
            for n, data in zip(b["n"], b["c"]):
                data = bytes(data or b"")
                digest = hashlib.sha256(data).hexdigest()
                try:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        for m in t:
                            if m.isdir():
                                continue
                            clean = posixpath.normpath(m.name)
                            bad = "absolute_path" if m.name.startswith("/") else "path_traversal" if clean.startswith("..") else "unsafe_link" if m.islnk() or m.issym() else "too_large" if m.size > max_member else None
                            body = None if bad else t.extractfile(m).read().decode("utf-8", "replace")
                            rows.append((n, digest, clean, m.size, body, bad))
                except (tarfile.TarError, EOFError, OSError):
                    rows.append((n, digest, None, None, None, "invalid_archive"))
            yield pd.DataFrame(rows, columns=["archive", "checksum", "member", "size", "text", "error"]).astype({"size": "Int64"})

    return archives.select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(run, "archive string, checksum string, member string, size bigint, text string, error string")
