"""Measures against planted truth; truth never reaches the scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (40, 50, 55, 60, 65, 70, 75, 80)


def outcomes(top: DataFrame, truth: DataFrame) -> DataFrame:
    """Top-1 rows ``a_record_id, b_record_id, score`` beside ``truth`` (``a_record_id, b_true``)."""
    return top.join(truth, "a_record_id", "left")


def confusion(rows: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 at every threshold, in one pass."""
    t = rows.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))))
    claimed, right, real = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)), F.coalesce(F.col("b_record_id") == F.col("b_true"), F.lit(False)), F.col("b_true").isNotNull()
    g = t.groupBy("threshold").agg(F.count_if(claimed & right).alias("tp"), F.count_if(claimed & ~right).alias("fp"), F.count_if(real & ~(claimed & right)).alias("fn"), F.count_if(~claimed & ~real).alias("tn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return g.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)})


def topk_recall(ranked: DataFrame, truth: DataFrame, ks=(1, 2, 3)) -> DataFrame:
    """Share of the true pairs among the first k."""
    found = truth.join(ranked.select("a_record_id", "b_record_id", "rank"), (truth["a_record_id"] == ranked["a_record_id"]) & (truth["b_true"] == ranked["b_record_id"]), "left").select("rank")
    return found.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("k").agg(F.avg(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("double")).alias("recall"))


def error_kinds(rows: DataFrame, threshold: float = 75.0) -> DataFrame:
    claimed, right = F.coalesce(F.col("score") >= threshold, F.lit(False)), F.coalesce(F.col("b_record_id") == F.col("b_true"), F.lit(False))
    kind = F.when(claimed & ~right & F.col("b_true").isNotNull(), "wrong-person").when(claimed & ~right, "false-claim").when(~claimed & F.col("b_true").isNotNull(), "missed")
    return rows.withColumn("kind", kind).where("kind is not null")


def best_threshold(scores: DataFrame, buckets: int = 1_000) -> DataFrame:
    """``threshold, accuracy`` of the best single cut of ``score`` against ``same``; the lowest cut wins ties.

    Scores are counted first. Running sums go over ``buckets`` ranges of scores, and inside each range by itself,
    so no task holds all distinct scores.
    """
    by = scores.where("score is not null and same is not null").groupBy("score").agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("n"))
    ends = by.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.least(F.floor((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * buckets), F.lit(buckets - 1))
    by = by.crossJoin(F.broadcast(ends)).withColumn("bucket", at).drop("lo", "hi")
    sums = by.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over ``buckets`` rows at most
    whole = Window.partitionBy()
    sums = sums.select("bucket", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("before_n"), F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("before_p"), F.sum("bp").over(whole).alias("all_p"), F.sum("bn").over(whole).alias("all_n"))
    below = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    cut = by.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0))).withColumn("lost", F.coalesce(F.sum("p").over(below), F.lit(0))).join(F.broadcast(sums), "bucket")
    acc = ((F.col("all_p") - F.col("lost") - F.col("before_p") + F.col("under") + F.col("before_n")) / (F.col("all_p") + F.col("all_n"))).alias("accuracy")
    return cut.select(F.col("score").alias("threshold"), acc).agg(F.max_by(F.struct("threshold", "accuracy"), F.struct("accuracy", (-F.col("threshold")).alias("t"))).alias("b")).where("b is not null").select("b.*")


def difficulty(notes: Column, hard: tuple[str, ...]) -> Column:
    """``easy``, ``moderate`` or ``hard`` by how many things differ and how many of them are ``hard``."""
    n, h = F.size(F.coalesce(notes, F.array().cast("array<string>"))), F.size(F.filter(F.coalesce(notes, F.array().cast("array<string>")), lambda x: x.isin(*hard)))
    return F.when((h >= 2) | (n >= 5), "hard").when((h >= 1) | (n >= 2), "moderate").otherwise("easy")


def difficulty_histogram(truth: DataFrame) -> DataFrame:
    return truth.groupBy("difficulty").agg(F.count("*").alias("pairs"))


def recall_by_difficulty(ranked: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """``difficulty, found, pairs, recall`` among the first ``k``, from easy to hard."""
    hits = ranked.where(F.col("rank") <= k).select("a_record_id", F.col("b_record_id").alias("b_true"), F.lit(1).alias("hit"))
    rows = truth.join(hits, ["a_record_id", "b_true"], "left").groupBy("difficulty").agg(F.count("hit").alias("found"), F.count("*").alias("pairs"))
    order = F.array_position(F.array(*map(F.lit, ("easy", "moderate", "hard"))), F.col("difficulty"))
    return rows.withColumn("recall", F.col("found") / F.col("pairs")).orderBy(order)


def showcase(truth: DataFrame, names: DataFrame, limit: int = 6) -> DataFrame:
    """The hard pairs in which most differs: ``a_record_id, display_name, obstacle_count, headline``; ``names``: ``a_record_id, display_name``."""
    hard = truth.where("difficulty = 'hard'").select("a_record_id", F.size("divergences").alias("obstacle_count"), F.coalesce(F.try_element_at("divergences", F.lit(1)), F.lit("")).alias("headline"))
    return hard.join(names, "a_record_id").orderBy(F.desc("obstacle_count"), "a_record_id").limit(limit)


def demo_pair(truth: DataFrame, scored: DataFrame, least: float = 85.0) -> DataFrame:
    """The hard pair with relatives on both sides that still scores ``least``, with most divergences; the smaller id wins ties."""
    kin = (F.size("a_family_members") > 0) & (F.size("b_family_members") > 0)
    met = truth.where("difficulty = 'hard'").join(scored.where(kin & (F.col("score") >= least)), (F.col("b_true") == F.col("b_record_id")) & (truth["a_record_id"] == scored["a_record_id"])).drop(scored["a_record_id"])
    return met.orderBy(F.desc(F.size("divergences")), "a_record_id").limit(1)


def reveal(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Ranked candidates with the planted partner beside them; joined after ranking, so it cannot influence it."""
    known = truth.select("a_record_id", F.lit(True).alias("has_true_partner"), "b_true", "difficulty", "divergences")
    return ranked.join(known, "a_record_id", "left").withColumn("has_true_partner", F.coalesce("has_true_partner", F.lit(False)))


def rank_one_accuracy(nearest: DataFrame, labels: DataFrame) -> DataFrame:
    """``queries, right``: how often the nearest (``id, other``) has the label (``id, label``) of the query."""
    mine, theirs = labels.toDF("id", "mine"), labels.toDF("other", "theirs")
    return nearest.join(mine, "id").join(theirs, "other").agg(F.count("*").alias("queries"), F.count_if(F.col("mine") == F.col("theirs")).alias("right"))


def separation(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(F.when(F.col("same"), F.col("score"))).alias("mean_same"), F.avg(F.when(~F.col("same"), F.col("score"))).alias("mean_different"))


def balanced(rows: DataFrame, label: str, n: int, order: str) -> DataFrame:
    """The first ``n / 2`` rows of either label."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("_r") <= n // 2).drop("_r")


def parity(one: DataFrame, two: DataFrame) -> DataFrame:
    """Agreement of two scorers over the same pairs; ``parity_problems`` names what is wrong with it."""
    j = one.select("a_record_id", "b_record_id", F.col("score").alias("x"), F.col("band").alias("p")).join(two.select("a_record_id", "b_record_id", F.col("score").alias("y"), F.col("band").alias("q")), ["a_record_id", "b_record_id"])
    d = F.abs(F.col("x") - F.col("y"))
    return j.agg(F.count("*").alias("pairs"), F.count_if(d == 0).alias("exact"), F.max(d).alias("largest"), F.avg(d).alias("mean"), F.count_if(F.col("p") != F.col("q")).alias("bands_differ"))


def parity_problems(stats: DataFrame, largest: float = 5.0) -> DataFrame:
    """The statistics of ``parity`` with ``failed``: no pairs, a band that differs, or a difference beyond ``largest``."""
    why = F.array_compact(F.array(F.when(F.col("pairs") == 0, "no pairs"), F.when(F.col("bands_differ") > 0, "bands differ"), F.when(F.col("largest") > largest, "a score differs too much")))
    return stats.withColumn("failed", why)
