"""Vector arithmetic and calibration of similarities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Middle and spread of the calibrated curve, default background, distance curve.
MIDPOINT, SPREAD, MEAN, SD = 0.72, 0.295, 0.78, 0.093


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def l2(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), F.sqrt(dot(a, a))))


def calibrated(similarity: Column, mean: float | Column = MEAN, sd: float | Column = SD) -> Column:
    """0 to 100 from how far a similarity stands out of the background."""
    return 100 / (1 + F.exp(-(z_score(similarity, mean, sd) - MIDPOINT) / SPREAD))


def distance_score(d: Column) -> Column:
    return 100 / (1 + F.exp((d - 0.6) / 0.12))


def z_score(similarity: Column, mean: float | Column = MEAN, sd: float | Column = SD) -> Column:
    """How many standard deviations a similarity stands above unrelated ones."""
    return (similarity - mean) / F.greatest(F.lit(sd) if isinstance(sd, float) else sd, F.lit(1e-6))


def compare(a: Column, b: Column, mean: float | Column = MEAN, sd: float | Column = SD) -> Column:
    """``struct<similarity, cosine, z_above_background>``; null where the lengths differ."""
    c = cosine(a, b)
    return F.when(F.size(a) == F.size(b), F.struct(F.bround(calibrated(c, mean, sd), 1).alias("similarity"), F.bround(c, 4).alias("cosine"), F.bround(z_score(c, mean, sd), 2).alias("z_above_background")))


def usable(rows: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """``key, v``: one finite vector of the right length, not all zero, a key."""
    v = F.col(vector)
    good = F.coalesce((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.where(good & F.col(key).isNotNull()).groupBy(key).agg(F.min(vector).alias("v"))


def _sums(df: DataFrame, tag: str) -> DataFrame:
    """Count, sum and second moments of the unit vectors ``v``, by place ``i`` of one flat list; combined in every task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, None, None
        for b in batches:
            rows = [x for x in b.column("v").to_pylist() if x]
            if rows:
                x = np.array(rows, float)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                n, first, second = n + len(x), x.sum(0) + (0 if first is None else first), x.T @ x + (0 if second is None else second)
        if n:
            flat = np.concatenate([[n], first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    return df.select("v").mapInArrow(add, "i long, x double").groupBy("i").agg(F.sum("x").alias(tag))


def calibrate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and spread of all dot products of unit vectors of two sides (``v``), without forming a pair.

    The mean follows from the sum vectors and the mean square from the second moments of either side, so the
    cost is linear in the rows. Null and empty vectors are left out; without a pair there is no row.
    """
    # both lists are laid out alike: count, sums, second moments
    both = _sums(a, "x").join(_sums(b, "y"), "i").select("i", "x", "y").withColumn("xy", F.col("x") * F.col("y"))
    n, terms = F.max(F.when(F.col("i") == 0, F.col("xy"))), F.count("*") - 1
    size = F.floor((F.sqrt(1 + 4 * terms.cast("double")) - 1) / 2)  # terms = d + d * d
    rows = both.agg(n.alias("pairs"), size.alias("d"), F.sort_array(F.collect_list(F.struct("i", "xy"))).alias("all"))
    s1 = F.aggregate(F.filter("all", lambda r: (r["i"] >= 1) & (r["i"] <= F.col("d"))), F.lit(0.0), lambda s, r: s + r["xy"])
    s2 = F.aggregate(F.filter("all", lambda r: r["i"] > F.col("d")), F.lit(0.0), lambda s, r: s + r["xy"])
    out = rows.where("pairs > 0").select(F.col("pairs").cast("long").alias("sample_pairs"), (s1 / F.col("pairs")).alias("background_mean"), (s2 / F.col("pairs")).alias("square"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.pow("background_mean", F.lit(2))))
    return out.select("sample_pairs", "background_mean", F.when(sd == 0, 0.05).otherwise(sd).alias("background_sd"))


def rank_one(queries: DataFrame, rows: DataFrame, block: int = 1_000, size: int = 10_000) -> DataFrame:
    """``id, other, similarity``: the nearest other vector of every query (``id, v``), searched exactly.

    Queries stand in blocks of about ``block``; every part of the rows meets every block, and only the best of a
    query leaves a task, so no list of pairs is formed. Ties go to the smaller id.
    """
    n, parts = max(1, -(-queries.count() // block)), max(8, -(-rows.count() // size))
    left = queries.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "v", F.lit(True).alias("asked"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v", F.lit(False).alias("asked"))
    kind = queries.schema["id"].dataType.simpleString()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["asked"]], pdf[~pdf["asked"]].sort_values("id")
        if not len(q) or not len(r):
            return pd.DataFrame({"id": q["id"][:0], "other": q["id"][:0], "similarity": np.zeros(0)})
        x, y = (np.stack(t["v"].to_numpy()).astype(float) for t in (q, r))
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        s = x @ y.T
        s[q["id"].to_numpy()[:, None] == r["id"].to_numpy()[None, :]] = -2
        best = s.argmax(1)
        value = s[np.arange(len(q)), best]
        good = value > -2
        return pd.DataFrame({"id": q["id"].to_numpy()[good], "other": r["id"].to_numpy()[best[good]], "similarity": value[good]})

    found = left.unionByName(right).groupBy("block", "part").applyInPandas(search, f"id {kind}, other {kind}, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
