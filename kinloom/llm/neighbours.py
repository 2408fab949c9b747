"""Most similar vectors of every vector: multi-index hashing over learned binary codes, floats reranked.

Vectors are centred, rotated (rotations learned on a bounded sample) and cut to signs. The code is split
into ``m`` substrings, each a table of its own: codes within Hamming distance ``m - 1`` of each other
agree in one substring at least, so the equal-key join finds every one of them, and nearly all a little
farther; ``m`` follows from the recall wanted at the lowest similarity asked for. A filter on the whole
code, the true cosine and a ranking per vector follow.

Buckets above ``HOT`` rows are not joined row by row: they are searched in blocks by matrix products of
which only the best stay, which is exact. Equal vectors are searched once, for the whole class.

Defined results: null, empty, short, long, non-finite and all-zero vectors are unusable and give no row;
of repeated ids one row counts; ties go to the smaller id. Vectors are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.session import parallelism, store

SAMPLE = 20_000
HOT = 4_096
_BLOCK = 2_048


def usable(rows: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """``id, v``: the usable rows; repeated ones stay, ``nearest`` and ``exact`` count an id once."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(key).alias("id"), v.cast("array<float>").alias("v"), good.alias("good")).where("good and id is not null").drop("good")


class Codes:
    """Centre and rotations learned from a sample; substrings of ``bits`` bits in ``tables`` tables."""

    def __init__(self, sample: np.ndarray, rows: int, least: float, recall: float, seed: int = 7):
        u = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centre = u.mean(0)
        d = u.shape[1]
        x = u - self.centre
        spread = max(float((x * x).sum(1).mean()), 1e-9)
        angle = math.acos(max(-1.0, min(1.0, 1 - (1 - least) / spread)))
        keep = 1 - angle / math.pi
        self.bits = max(4, min(30, round(math.log2(max(rows, 2))) - 4))
        self.tables = max(4, math.ceil(math.log(1 - recall) / math.log(1 - keep**self.bits)))
        total = self.bits * self.tables
        rng = np.random.default_rng(seed)
        parts = []
        for _ in range(-(-total // d)):
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            for _ in range(8):  # turn the rotation towards signs that lose little
                a, _, b = np.linalg.svd(np.sign(x @ r).T @ x)
                r = (a @ b).T
            parts.append(r)
        self.rotation = np.concatenate(parts, 1)[:, :total]
        n = min(total, 126)
        self.words = 2
        self.checked = n
        flips = angle / math.pi * n
        self.radius = int(math.ceil(flips + 4 * math.sqrt(max(flips * (1 - flips / n), 1))))

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table keys (rows x tables) and the checked bits in 63-bit words."""
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        s = ((u - self.centre) @ self.rotation) > 0
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        keys = (s.reshape(len(v), self.tables, self.bits) * weights).sum(2)
        c = np.zeros((len(v), self.words * 63), np.int64)
        c[:, : self.checked] = s[:, : self.checked]
        return keys, (c.reshape(len(v), self.words, 63) << np.arange(63, dtype=np.int64)).sum(2)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = _stack(a), _stack(b)
    return pd.Series((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)))


def _block_pairs(hot: DataFrame, k: int, least: float) -> DataFrame:
    """Exact search inside hot buckets: rows ``t, key, n, id, v`` by pairs of blocks; the best ``k`` a row and block pair stay."""
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    sides = hot.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = sides.select("t", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        a, b = pdf[pdf["own"] == x], pdf[pdf["own"] == y]
        out = []
        if len(a) and len(b):
            p, q = _stack(a["v"]), _stack(b["v"])
            p /= np.linalg.norm(p, axis=1, keepdims=True)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            for one, two, u, w in ((a, b, p, q), (b, a, q, p)):
                s = u @ w.T
                ids, others = np.array(one["id"].tolist(), object), np.array(two["id"].tolist(), object)
                s[ids[:, None] == others[None, :]] = -2
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(ids)), top.shape[1])
                good = s[rows, top.ravel()] >= least
                out += zip(ids[rows[good]], others[top.ravel()[good]])
        return pd.DataFrame({"id1": pd.Series([x for x, _ in out], dtype=object), "id2": pd.Series([x for _, x in out], dtype=object)})

    kind = hot.schema["id"].dataType.simpleString()
    return spread.groupBy("t", "key", "x", "y").applyInPandas(search, f"id1 {kind}, id2 {kind}")


def nearest(vectors: DataFrame, k: int = 5, least: float = 0.98, recall: float = 0.95) -> DataFrame:
    """``id, other, similarity, rank``: of every vector the ``k`` most similar with cosine ``least`` or more.

    ``vectors`` has ``id, v`` as ``usable`` gives them. ``recall`` is the share of pairs at exactly ``least``
    that must be found; closer pairs are found more often.
    """
    spark = vectors.sparkSession
    n = parallelism(spark)
    # equal vectors have one number and are searched once; the vectors themselves move once, to be reranked
    rows = vectors.select("id", "v", F.xxhash64("v").alias("h"))
    ids = store(rows.groupBy("id").agg(F.min("h").alias("h")))
    count = ids.count()
    if count == 0:
        return vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    sample = rows.select("v").orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()
    codes = Codes(_stack(sample["v"]), count, least, recall)
    held = spark.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            if len(v):
                keys, words = held.value.encode(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float))
                tables = keys.shape[1]
                # table and substring in one number; words of the code to compare before any vector is read
                bucket = (np.arange(tables, dtype=np.int64) << np.int64(40)) | keys
                h = np.repeat(b.column("h").to_numpy(), tables)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(h), *(pa.array(np.repeat(words[:, i], tables)) for i in range(2))], ["bucket", "h", "c0", "c1"])

    stored = store(rows.select("h", "v").repartition(n).mapInArrow(encode, "bucket long, h long, c0 long, c1 long"))
    # by bucket first, so the same exchange serves to drop repeats and to join
    index = stored.repartition(n, "bucket").dropDuplicates(["bucket", "h"])
    hot_keys = _crowded(stored, n)
    hot = hot_keys.head(1)
    warm = stored.join(hot_keys, "bucket", "left_anti").repartition(n, "bucket").dropDuplicates(["bucket", "h"]) if hot else index
    a, b = warm.alias("a"), warm.alias("b")
    apart = sum((F.bit_count(F.col(f"a.c{i}").bitwiseXOR(F.col(f"b.c{i}"))) for i in range(2)), F.lit(0))
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.h") < F.col("b.h")) & (apart <= codes.radius)).select(F.col("a.h").alias("h1"), F.col("b.h").alias("h2"))
    each = rows.select("h", "v").dropDuplicates(["h"])
    if hot:
        members = stored.select("bucket", "h").distinct().join(hot_keys, "bucket").join(each, "h").select(F.lit(0).alias("t"), F.col("bucket").alias("key"), "n", F.col("h").alias("id"), "v")
        found = _block_pairs(members, k, least)
        pairs = pairs.unionByName(found.select(F.least("id1", "id2").alias("h1"), F.greatest("id1", "id2").alias("h2")))
    one, two = (each.select(F.col("h").alias(f"h{i}"), F.col("v").alias(f"v{i}")) for i in (1, 2))
    scored = store(pairs.distinct().join(one, "h1").join(two, "h2").select("h1", "h2", cosine("v1", "v2").alias("similarity")).where(F.col("similarity") >= least))
    # of every vector the first k + 1 ids, and the vectors near it: itself where several have it
    first = ids.withColumn("at", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("at") <= k + 1).select(F.col("h").alias("h2"), F.col("id").alias("other"))
    several = ids.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    links = scored.unionByName(scored.select(F.col("h2").alias("h1"), F.col("h1").alias("h2"), "similarity")).unionByName(several.select(F.col("h").alias("h1"), F.col("h").alias("h2"), F.lit(1.0).alias("similarity")))
    to = links.join(first, "h2").withColumn("r", F.row_number().over(Window.partitionBy("h1").orderBy(F.desc("similarity"), "other"))).where(F.col("r") <= k + 1).select(F.col("h1").alias("h"), "other", "similarity")
    directed = ids.join(to, "h").where("id <> other").select("id", "other", "similarity")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return directed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _crowded(stored: DataFrame, parts: int) -> DataFrame:
    """``bucket, n`` of the buckets with more than ``HOT`` rows.

    Such a bucket has its share of them in one of the tasks at least, so only these are counted.
    """
    tasks = max(1, stored.rdd.getNumPartitions())
    share = max(1, HOT // tasks)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = [b.column("bucket").to_numpy() for b in batches]
        if all_:
            bucket, n = np.unique(np.concatenate(all_), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[n >= share])], ["bucket"])

    likely = store(stored.select("bucket").mapInArrow(often, "bucket long").distinct())
    counted = stored.select("bucket").join(likely, "bucket", "left_semi").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    return store(counted)


def exact(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 1_000, part: int = 5_000) -> DataFrame:
    """``id, other, similarity, rank``: the true ``k`` nearest of the ``queries``, a stated set, against all rows.

    Queries stand in blocks; every part of the rows meets every block and only the best ``k`` of a query leave it.
    """
    vectors, queries = (t.groupBy("id").agg(F.min("v").alias("v")) for t in (vectors, queries))
    n, parts = max(1, -(-queries.count() // block)), max(8, -(-vectors.count() // part))
    kind = vectors.schema["id"].dataType.simpleString()
    asked = queries.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "v", F.lit(True).alias("asked"))
    rows = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v", F.lit(False).alias("asked"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["asked"]], pdf[~pdf["asked"]].sort_values("id")
        if not len(q) or not len(r):
            return pd.DataFrame({"id": q["id"][:0], "other": q["id"][:0], "similarity": np.zeros(0)})
        x, y = _stack(q["v"]), _stack(r["v"])
        s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        s[q["id"].to_numpy()[:, None] == r["id"].to_numpy()[None, :]] = -2
        top = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(q)), top.shape[1])
        value = s[at, top.ravel()]
        good = value > -2
        return pd.DataFrame({"id": q["id"].to_numpy()[at[good]], "other": r["id"].to_numpy()[top.ravel()[good]], "similarity": value[good]})

    best = asked.unionByName(rows).groupBy("block", "part").applyInPandas(search, f"id {kind}, other {kind}, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall_against_blocks(vectors: DataFrame, found: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.98) -> DataFrame:
    """``pairs, hits, recall``: the true ``k`` nearest of the ``queries`` at ``least`` or more, and how many ``found`` has."""
    true = exact(queries, vectors, k).where(F.col("similarity") >= least)
    met = true.join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("hits"))
    return met.withColumn("recall", F.coalesce(F.try_divide("hits", "pairs"), F.lit(1.0)))
