"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.timestamps import normalize_timestamps
from kinloom.session import table


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    desks = table(spark, sf_dir, "source_desks").select(F.col("source_org").alias("source"), F.col("iana_zone").alias("zone"), F.col("date_order").alias("order"))
    return normalize_timestamps(table(spark, sf_dir, "registry_a"), desks, "record_id", "birth_date_raw", "source_org")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).where("status = 'ok'").select(F.col("key").alias("record_id"), "normal_form")


def p3_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values ended in each status."""
    return _normalized(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_values"))


QUERIES = {"p3_found": p3_found, "p3_open": p3_open}
ORACLES: dict[str, str] = {}
