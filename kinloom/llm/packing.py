"""Documents packed into containers of one capacity, measured in tokens of a public tokenizer.

Texts are tokenized once and only their lengths stay. The histogram of lengths (at most ``capacity``
numbers) is packed on the driver: patterns of few documents over length classes get repeat counts by
non-negative least squares, rounded down; what remains goes best-fit-decreasing into the room left. The
plan is a list of runs ``(length, first rank, count) -> containers``, so every document finds its
container from its length and its rank among equal lengths, without anyone holding the documents.

Only texts longer than the capacity are split: into full containers and a remainder.

Defined results: null and empty texts have no tokens and go nowhere; repeated ids are packed as they are.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the tokenizer's file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens``: whole texts, or full pieces and a remainder of longer ones.

    ``tokenizer`` is a file of the driver's machine; it is sent to the executors with the job.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rpartition("/")[2]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": n})

    kind = documents.schema[doc_id].dataType.simpleString()
    lengths = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(measure, f"doc_id {kind}, n long").where("n > 0")
    cut_ = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int")), lambda i: F.struct(i.alias("piece"), (i * capacity).cast("long").alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n") - i * capacity).alias("n_tokens")))
    return lengths.select("doc_id", F.explode(cut_).alias("p")).select("doc_id", "p.*")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 1e-12).all():
                x = z
                break
            low = free & (z <= 1e-12)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(classes: int, most: int = 4) -> list[tuple[int, ...]]:
    """Class tuples of up to ``most`` documents that fill a container but for one class."""
    out: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        if parts and left <= 1:
            out.append(parts)
        if len(parts) < most:
            for k in range(min(left, parts[-1] if parts else classes), 0, -1):
                grow((*parts, k), left - k)

    grow((), classes)
    return out


def plan(histogram: dict[int, int], capacity: int, classes: int = 48, filler: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a container, how many such containers)``; sizes depend on the capacity, not on the counts.

    The shortest ``filler`` classes stay out of the patterns, to fill what these leave.
    """
    width = -(-capacity // classes)
    classes = -(-capacity // width)
    left = {n: c for n, c in histogram.items() if c > 0}
    target = np.zeros(classes + 1)
    for n, c in left.items():
        target[-(-n // width)] += c
    usable = [p for p in patterns(classes) if all(target[k] and k > filler for k in p) and sum(p) * width <= capacity + width - 1]
    usable = [p for p in usable if sum(p) * width <= capacity or classes * width == capacity]
    groups: list[list] = []  # lengths, count
    if usable:
        a = np.zeros((classes + 1, len(usable)))
        for j, p in enumerate(usable):
            for k in p:
                a[k, j] += 1
        stock = defaultdict(list)  # class -> lengths, longest last
        for n in sorted(left):
            stock[-(-n // width)].append(n)
        lengths_left = sorted(left)
        fitted = nnls(a, target)
        for x, p in sorted(zip(fitted, usable), key=lambda y: (-sum(k * k for k in y[1]), y[1])):
            want = int(x)
            while want > 0:
                take: list[int] = []
                for k in p[:-1]:
                    have = [n for n in stock[k] if left[n] > take.count(n)]
                    if not have:
                        break
                    take.append(have[-1])
                else:
                    # the class of the last document only bounds it from below: the longest that fits is taken
                    at = bisect_right(lengths_left, capacity - sum(take))
                    while at and left[lengths_left[at - 1]] <= take.count(lengths_left[at - 1]):
                        at -= 1
                    if at and -(-lengths_left[at - 1] // width) >= p[-1]:
                        take.append(lengths_left[at - 1])
                if len(take) < len(p):
                    break
                m = min(want, *(left[n] // take.count(n) for n in take))
                if m == 0:
                    break
                for n in take:
                    left[n] -= m
                for n in set(take):
                    if not left[n]:
                        stock[-(-n // width)].remove(n)
                        lengths_left.remove(n)
                groups.append([tuple(take), m])
                want -= m
    rooms: dict[int, list] = defaultdict(list)
    order: list[int] = []

    def put(lengths: tuple[int, ...], m: int) -> None:
        room = capacity - sum(lengths)
        if room not in rooms or not rooms[room]:
            insort(order, room)
        rooms[room].append((lengths, m))

    for lengths, m in groups:
        put(lengths, m)
    for n in sorted((n for n in left if left[n]), reverse=True):
        c = left[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                per = min(c, capacity // n)
                put((n,) * per, c // per)
                c -= c // per * per
                continue
            room = order[at]
            lengths, m = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            fit = min(room // n, c)
            k = min(m, c // fit)
            if m > k:
                put(lengths, m - k)
            put((*lengths, *(n,) * fit), k)
            c -= k * fit
    return [g for room in sorted(rooms) for g in rooms[room]]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """``length, start, per, base``: rank ``r`` of a length from ``start`` on lies in container ``base + (r - start) // per``."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, m in packed:
        for n in sorted(set(lengths)):
            per = lengths.count(n)
            rows.append((n, used[n], per, base))
            used[n] += per * m
        base += m
    return pd.DataFrame(rows, columns=["length", "start", "per", "base"]).sort_values(["length", "start"], ignore_index=True)


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``container_id, doc_id, piece, first_token, n_tokens``."""
    spark = documents.sparkSession
    # the partition of a row is part of its rank, so the lengths are written once and read from there
    pieces = cut(token_pieces(documents, doc_id, text, capacity, tokenizer, pattern)).withColumn("part", F.spark_partition_id())
    counts = pieces.groupBy("n_tokens", "part").agg(F.count("*").alias("n"))
    histogram = {r.n_tokens: r.n for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(plan(histogram, capacity))
    held = spark.sparkContext.broadcast({n: (g["start"].to_numpy(), g["per"].to_numpy(), g["base"].to_numpy()) for n, g in table.groupby("length")})
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("n_tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("r", F.row_number().over(within)).join(offsets, ["n_tokens", "part"]).withColumn("rank", F.col("offset") + F.col("r") - 1).drop("part", "r", "offset")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for n, at in b.groupby("n_tokens").indices.items():
                start, per, base = held.value[n]
                rank = b["rank"].to_numpy()[at]
                k = np.searchsorted(start, rank, "right") - 1
                out[at] = base[k] + (rank - start[k]) // per[k]
            yield pd.DataFrame({"container_id": out, "doc_id": b["doc_id"], "piece": b["piece"], "first_token": b["first_token"], "n_tokens": b["n_tokens"]})

    kind = documents.schema[doc_id].dataType.simpleString()
    return ranked.mapInPandas(place, f"container_id long, doc_id {kind}, piece int, first_token long, n_tokens long").withColumnRenamed("doc_id", doc_id)
