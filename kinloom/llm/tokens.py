"""Distinct name words of a table and the common words that rare ones stand for.

A word that is rare beside another within few edits is taken as a respelling of it: records then meet
under the common word, its *head*. Only distinct words are compared, by a symmetric-delete index, so the
work follows the vocabulary and not the rows. A head stands as its number or as its bit vector of grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.text import deletes, sound
from kinloom.session import parallelism, store

RARE = 5  # a head is at least so many times as frequent as its respellings
WIDTH = 63
MAX_BROADCAST = 4_000_000  # words; a larger vocabulary is joined
RESOLVED = ("token", "head", "prefix", "n", "first")


def listed(column: pa.Array) -> list:
    """Values of a flat column; several times as fast as ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def number(text: str) -> int:
    """64-bit signed number of a text."""
    n = xxhash.xxh64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


def gram_bits(word: str, width: int = WIDTH) -> int:
    """Bit vector of the padded two-letter grams of a word."""
    padded, out = f"^{word}$", 0
    for i in range(len(padded) - 1):
        out |= 1 << xxhash.xxh32_intdigest(padded[i : i + 2]) % width
    return out


def vocabulary(facts: DataFrame) -> DataFrame:
    """``token, skeleton, n``: how often each sounded name word occurs in ``given``, ``family`` and ``kin``."""
    words = facts.select(F.explode(F.split(F.translate(F.concat_ws(" ", "given", "family", "kin"), ";", " "), " ")).alias("word")).where(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("n"))

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            skeletons = [sound(w) for w in listed(b.column("word"))]
            yield pa.RecordBatch.from_arrays([pa.array(map(number, skeletons), pa.int64()), pa.array(skeletons, pa.string()), b.column("n")], ["token", "skeleton", "n"])

    return store(words.mapInArrow(heard, "token long, skeleton string, n long").groupBy("token").agg(F.min("skeleton").alias("skeleton"), F.sum("n").alias("n")))


def _heads(pairs: DataFrame) -> DataFrame:
    """``token, head, skeleton, n`` of the nearest heads, from ``token, a, head, skeleton, n``; swapped letters are one edit."""
    reach = F.when(F.length("a") >= 7, 2).otherwise(1)
    d = F.levenshtein("a", "skeleton", 2)
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    near = pairs.withColumn("d", F.when((d == 2) & (letters("a") == letters("skeleton")), 1).otherwise(d)).where((F.col("d") >= 0) & (F.col("d") <= reach))
    return near.groupBy("token").agg(F.min("d").alias("d"), F.collect_set(F.struct("d", "head", "skeleton", "n")).alias("all")).select("token", F.explode(F.expr("filter(all, x -> x.d = d)")).alias("h")).select("token", "h.head", "h.skeleton", "h.n")


def by_deletes(words: DataFrame) -> DataFrame:
    """Heads by shared deletion variants; of each variant's words the most frequent is the head."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], []
            for i, s in enumerate(listed(b.column("skeleton"))):
                # words over 64 letters keep their own form only: no list of names holds such words
                got = {s} if len(s) > 64 else deletes(s, 2 if len(s) >= 7 else 1 if len(s) >= 3 else 0)
                keys += map(number, got)
                at += [i] * len(got)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("token").take(rows), b.column("n").take(rows)], ["variant", "token", "n"])

    variants = words.repartition(parallelism(words.sparkSession)).mapInArrow(spread, "variant long, token long, n long")
    top = variants.groupBy("variant").agg(F.max(F.struct("n", "token")).alias("top"))
    met = variants.join(top, "variant").where(F.col("top.n") >= RARE * F.col("n")).select("token", F.col("top.token").alias("head")).distinct()
    met = met.join(words.select("token", F.col("skeleton").alias("a")), "token").join(words.select(F.col("token").alias("head"), "skeleton", "n"), "head")
    return _heads(met)


def resolved(words: DataFrame, heads: DataFrame, vectors: bool) -> DataFrame:
    """``token, head, prefix, n, first``: every word with its heads, or with itself.

    ``head`` and ``prefix`` (the head's first three letters) are bit vectors of grams, or numbers; ``first`` is the
    place of the head's first letter. With ``vectors`` a word also keeps its own beginning beside its heads, and words of
    one vector count as often as the most frequent of them.
    """
    own = words.join(heads.select("token").distinct(), "token", "left_anti").select("token", F.col("token").alias("head"), "skeleton", "n", F.col("skeleton").alias("start"))
    starts = [heads.withColumn("start", F.col("skeleton"))]
    if vectors:
        starts.append(heads.join(words.select("token", F.col("skeleton").alias("start")), "token").select(*starts[0].columns))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = gram_bits if vectors else number
        for b in batches:
            skeletons, begun = listed(b.column("skeleton")), listed(b.column("start"))
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(map(make, skeletons), pa.int64()), pa.array([make(s[:3]) for s in begun], pa.int64()), b.column("n"), pa.array([ord(s[0]) - 97 if s else 0 for s in begun], pa.int64())], list(RESOLVED))

    for rows in starts:
        own = own.unionByName(rows)
    out = own.mapInArrow(code, "token long, head long, prefix long, n long, first long")
    return out.withColumn("n", F.max("n").over(Window.partitionBy("head"))) if vectors else out


class Lookup:
    """Heads of words as arrays sorted by word."""

    def __init__(self, token: np.ndarray, head: np.ndarray, prefix: np.ndarray, n: np.ndarray, first: np.ndarray):
        order = np.lexsort((first, prefix, head, token))
        columns = [c[order] for c in (token, head, prefix, first)]
        once = np.ones(len(order), bool)
        once[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)  # heads of one vector may begin differently
        self.token, self.head, self.prefix, self.first = (c[once] for c in columns)
        self.n = n[order][once]

    def expand(self, at: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``at`` and places of all heads of their ``tokens``."""
        first, last = np.searchsorted(self.token, tokens, "left"), np.searchsorted(self.token, tokens, "right")
        times = last - first
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), np.repeat(first, times) + inside
