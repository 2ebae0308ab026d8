"""Evaluation texts inside training texts.

Texts become sequences of words (runs of letters, digits and underscores; case, punctuation, white space, markup and invisible characters do not
count).  Each batch of documents is a shard with its own suffix array: the suffixes are sorted by their first ten words, and every suffix of every
test item is found in it by binary search.  Hits are extended to the longest verbatim match.  Only suffixes whose first ten words all occur in test
items can match and are kept in the array; that leaves out no match.  Test items are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

#: Consecutive words that make a leak, and the words of test items compared at once (the size bound of what is sent to the executors).
WORDS, BLOCK_WORDS = 10, 2_000_000
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e007f]")
_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]{0,300}>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});|\]\([^()\s]*\)", re.S)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Words of a text; null and empty texts have none.  Underscores around a word are markup, those within it belong to it."""
    if not text:
        return []
    t = _INVISIBLE.sub("", text)
    if "<" in t or "&" in t or "](" in t:
        t = _MARKUP.sub(" ", t)
    return [x for w in _WORD.findall(t.lower()) if (x := w.strip("_"))]


class Items:
    """Words of test items as numbers, and all their suffixes of at least ``WORDS`` words as sortable keys."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        seqs = []
        for item, text in rows:
            seqs.append((item, [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]))
        # one word between items that no text has
        flat: list[int] = []
        owner, at = [], []
        for item, s in seqs:
            for i in range(len(s) - WORDS + 1):
                owner.append(item)
                at.append(len(flat) + i)
            flat.extend(s)
            flat.append(-1)
        self.flat = np.asarray(flat, dtype=np.int64)
        self.owner, self.at = np.asarray(owner, dtype=np.int64), np.asarray(at, dtype=np.int64)
        self.keys = keys_at(self.flat, self.at)


def keys_at(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings that sort like the WORDS numbers from each position on."""
    if not len(at):
        return np.empty(0, dtype=f"S{4 * WORDS}")
    m = flat[at[:, None] + np.arange(WORDS)].astype(">u4")
    return np.ascontiguousarray(m).view(f"S{4 * WORDS}").ravel()


def search(texts: list[list[str]], items: Items) -> list[tuple[int, int, int, int]]:
    """(text number, item, first word, longest match in words) over one shard, the longest of each text and item."""
    number = items.number
    flat: list[int] = []
    doc: list[int] = []
    begins: list[int] = []
    for d, ws in enumerate(texts):
        begins.append(len(flat))
        flat.extend([number.get(w, 0) for w in ws])
        flat.append(0)
        doc.extend([d] * (len(ws) + 1))
    a = np.asarray(flat, dtype=np.int64)
    if len(a) < WORDS or not len(items.at):
        return []
    run = np.concatenate([[0], np.cumsum(a == 0)])
    at = np.flatnonzero(run[WORDS:] == run[:-WORDS])
    if not len(at):
        return []
    keys = keys_at(a, at)
    order = np.argsort(keys, kind="stable")  # the suffix array of the shard
    keys, at = keys[order], at[order]
    lo, hi = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.keys, "right")
    best: dict[tuple[int, int], tuple[int, int]] = {}
    docs = np.asarray(doc)
    for s in np.flatnonzero(hi > lo):
        x = items.at[s]
        for p in at[lo[s]:hi[s]]:
            n = WORDS
            while p + n < len(a) and x + n < len(items.flat) and a[p + n] == items.flat[x + n] and a[p + n] > 0:
                n += 1
            key = (int(docs[p]), int(items.owner[s]))
            if n > best.get(key, (0, 0))[0]:
                best[key] = (n, int(p - begins[key[0]]))
    return [(d, i, first, n) for (d, i), (n, first) in best.items()]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, words): the longest verbatim match of each document and test item of at least ``WORDS`` words."""
    spark = docs.sparkSession
    sized = items.select("item_id", "text").filter(F.length("text") > 0)
    # blocks of items by the number of their words; a block is what is broadcast
    total = sized.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    src = spread(docs.select("doc_id", "text").filter(F.length("text") > 0))
    out = None
    for k in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else sized
        held = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in part.collect()]))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids = b["doc_id"].to_numpy()
                got = search([words_of(t) for t in b["text"]], held.value)
                yield pd.DataFrame([(ids[d], i, f, n) for d, i, f, n in got], columns=["doc_id", "item_id", "first_word", "words"]).astype("int64")

        one = src.mapInPandas(run, "doc_id bigint, item_id bigint, first_word bigint, words bigint")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "first_word")).alias("m")).select("doc_id", "item_id", "m.first_word", "m.words")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents left after removal of those that hold test items."""
    docs = table(spark, folder, "documents")
    hit = leaks(docs, table(spark, folder, "eval_item")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select("doc_id")
