"""Vectors enrolled for comparison: a log of who was enrolled, forgotten or cleared, and looks against what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators import vectors


def enrolled(log: DataFrame) -> DataFrame:
    """``name, v`` that stand after all events ``at, action, name, v``.

    ``enrol`` sets a vector, ``forget`` drops a name, ``clear`` drops everything before it. Later events win, at one
    time ``forget`` over ``enrol``; events of other actions, without a time or (but for ``clear``) a name count for nothing.
    """
    events = log.where("at is not null")
    cleared = events.where("action = 'clear'").agg(F.max("at").alias("cleared"))
    own = events.where("action in ('enrol', 'forget') and name is not null")
    last = own.groupBy("name").agg(F.max(F.struct("at", "action", "v")).alias("e")).crossJoin(F.broadcast(cleared))
    return last.where("e.action = 'enrol' and e.v is not null and (cleared is null or e.at > cleared)").select("name", "e.v")


def looks(seen: DataFrame, known: DataFrame, mean: float = vectors.MEAN, sd: float = vectors.SD) -> DataFrame:
    """Vectors ``look_id, v`` (a batch or a stream) beside every enrolled ``name, v``: cosine, calibrated similarity, distance score.

    The enrolled are few by nature (people before one camera); lengths that differ give no row.
    """
    both = seen.select("look_id", F.col("v").alias("_a")).join(known.select("name", F.col("v").alias("_b")), F.size("_a") == F.size("_b"))
    unit = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * vectors.cosine(F.col("_a"), F.col("_b"))))
    return both.select("look_id", "name", vectors.compare(F.col("_a"), F.col("_b"), mean, sd).alias("c"), F.bround(vectors.distance_score(unit), 1).alias("distance_score")).select("look_id", "name", "c.*", "distance_score")


def best_look(compared: DataFrame) -> DataFrame:
    """The enrolled name most like each look; ties go to the smaller name."""
    order = Window.partitionBy("look_id").orderBy(F.desc("cosine"), "name")
    return compared.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def embed_pair(request: DataFrame, held: DataFrame) -> DataFrame:
    """Answers of requests ``request_id, images``: exactly two references whose base name, without ``.png``, is held (``record_id, v``).

    ``problem`` says what is wrong, and then there are no vectors.
    """
    base = F.transform("images", lambda x: F.regexp_replace(F.element_at(F.split(x, "/"), -1), r"\.png$", ""))
    rows = request.select("request_id", F.coalesce(F.size("images"), F.lit(0)).alias("n"), F.posexplode_outer(base).alias("at", "record_id")).join(held, "record_id", "left")
    out = rows.groupBy("request_id").agg(F.max("n").alias("n"), F.count("v").alias("found"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("embeddings"))
    problem = F.when(F.col("n") != 2, "exactly two images are compared").when(F.col("found") < 2, "an image is not of this corpus")
    return out.select("request_id", problem.alias("problem"), F.when(problem.isNull(), F.col("embeddings")).alias("embeddings"))


def with_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests beside what the embedding service answered (``request_id, embeddings``); unanswered ones keep a null."""
    return requests.join(replies.select("request_id", "embeddings").dropDuplicates(["request_id"]), "request_id", "left")
