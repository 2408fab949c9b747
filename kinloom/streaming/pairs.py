"""Pair requests as a stream: read, checked, scored by the same operator as the batch, notified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import review, scoring, vectors
from kinloom.sources import registry

_RECORD = f"struct<{', '.join(c.replace(' ', ': ', 1) for c in registry.SCHEMA.replace('array<struct<name: string, relation: string>>', 'KIN').split(', '))}, face_embedding: array<float>, notes: string>".replace("KIN", "array<struct<name: string, relation: string>>")
REQUEST = f"record_a {_RECORD}, record_b {_RECORD}, options struct<review_threshold: double, face_calibration: struct<background_mean: double, background_sd: double>>"


def read_requests(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """A stream of JSON requests, one a line, that arrive as files in a folder."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).json(folder)


def checked(requests: DataFrame) -> DataFrame:
    """Requests with ``problems`` of either record; good ones have none."""

    def of(record: str) -> Column:
        return F.transform(registry.problem_tests(lambda c: F.col(f"{record}.{c}")), lambda m: F.concat(F.lit(f"{record}: "), m))

    return requests.withColumn("problems", F.concat(of("record_a"), of("record_b")))


def score_requests(requests: DataFrame, places: DataFrame | None = None, nations: DataFrame | None = None) -> DataFrame:
    """Scores of a batch of good requests, with the threshold each asked for (60 where it asked for none)."""
    good = checked(requests).where("size(problems) = 0")
    ids = [F.col(f"record_{s}.record_id").alias(f"{s}_record_id") for s in "ab"]
    asked = good.select(*ids, F.coalesce("options.review_threshold", F.lit(60.0)).alias("review_threshold"), "record_a", "record_b", "options").dropDuplicates(["a_record_id", "b_record_id"])
    mean, sd = (F.coalesce(f"options.face_calibration.background_{x}", F.lit(v)) for x, v in (("mean", vectors.MEAN), ("sd", vectors.SD)))
    faces = asked.where("record_a.face_embedding is not null and record_b.face_embedding is not null").select("a_record_id", "b_record_id", vectors.compare(F.col("record_a.face_embedding"), F.col("record_b.face_embedding"), mean, sd)["similarity"].alias("face_score")).where("face_score is not null")
    sides = [asked.select(f"record_{s}.*") for s in "ab"]
    scored = scoring.score_pairs(asked, *sides, faces=faces, places=places, nations=nations)
    return scored.join(asked.select("a_record_id", "b_record_id", "review_threshold"), ["a_record_id", "b_record_id"]).withColumn("needs_review", F.col("score") >= F.col("review_threshold"))


def serve(requests: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, send: Callable | None = None, seconds: float = 15.0, **lists):
    """Start-able writer: every micro-batch is scored and written; pairs for review are sent if ``send`` is given.

    Notices that fail are dropped and never stop the stream. The rows sent are those of one micro-batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        scored = score_requests(df, **lists)
        write(scored, number)
        if send is not None:
            review.notify((r.asDict() for r in scored.where("needs_review").select("a_record_id", "b_record_id", "score", "band", "explanation").toLocalIterator()), send, seconds)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
