"""Registry files: JSON arrays in, JSON, CSV and Parquet out; truth, vectors and calibration; search, validation and payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "record_id string, registry string, given_name string, family_name string, sex string, birth_date_raw string, origin_place string, last_seen_place string, "
    "nationality string, family_members array<struct<name: string, relation: string>>, source_org string, intake_date date, face_image string"
)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def require(spark: SparkSession, *paths: str) -> None:
    """Raise with all missing files and what makes them."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}; kinloom.operators.synth.registries makes registries and truth, write_json stores them")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records with its order in ``ord``; a missing file raises with a hint."""
    require(spark, path)
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, blanks kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Planted pairs (``a_record_id, b_true, difficulty, divergences``) out of one JSON object with a list ``pairs``."""
    require(spark, path)
    kind = "pairs array<struct<pair_id: string, person_id: string, a_record_id: string, b_record_id: string, difficulty: string, divergences: array<string>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("pairs").alias("p")).select("p.*")
    return rows.withColumnRenamed("b_record_id", "b_true")


def write_calibration(calibration: DataFrame, path: str, backend: str) -> None:
    """One row: background mean and spread to six places, the number of pairs, the backend."""
    calibration.select(F.lit(backend).alias("backend"), "sample_pairs", *(F.round(c, 6).alias(c) for c in ("background_mean", "background_sd")), F.lit("how far pairs stand above unrelated ones; not a probability").alias("note")).coalesce(1).write.mode("overwrite").json(path)


def read_calibration(spark: SparkSession, path: str, backend: str, mean: float, sd: float) -> tuple[float, float]:
    """Stored background mean and spread of ``backend``, or the given ones where the file is missing or of another backend."""
    if exists(spark, path):
        rows = spark.read.schema("backend string, background_mean double, background_sd double").json(path).where(F.col("backend") == backend).head(1)
        if rows:
            return rows[0].background_mean, rows[0].background_sd
    return mean, sd


def write_report(path: str, **tables: DataFrame) -> None:
    """Measures as JSON, a folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def materialise(answers: DataFrame, key: str, path: str, folders: int = 256) -> None:
    """Prepared answers as JSON in ``folders`` folders by a hash of ``key``, so a lookup reads one of them.

    Overwriting sweeps stale answers.
    """
    answers.withColumn("part", F.pmod(F.xxhash64(key), F.lit(folders))).repartition("part").write.mode("overwrite").partitionBy("part").json(path)


def answer(spark: SparkSession, path: str, schema: str, key: str, value: str, folders: int = 256) -> DataFrame:
    """The prepared answers of one key."""
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(folders)).alias("p")).first().p
    return spark.read.schema(schema + ", part long").json(path).where((F.col("part") == part) & (F.col(key) == value)).drop("part")


def flatten_family(members: Column) -> Column:
    """``relation: name; ...``"""
    return F.array_join(F.transform(F.coalesce(members, F.array().cast("array<struct<name:string,relation:string>>")), lambda m: F.concat(F.coalesce(m["relation"], F.lit("")), F.lit(": "), F.coalesce(m["name"], F.lit("")))), "; ")


def write_csv(df: DataFrame, path: str) -> None:
    df.withColumn("family_members", flatten_family(F.col("family_members"))).write.mode("overwrite").option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors rounded to five places."""
    df.withColumn("embeddings", F.transform("embeddings", lambda x: F.round(x, 5).cast("float"))).write.mode("overwrite").parquet(path)


def read_vectors(df: DataFrame, backend: str, others: str = "raise") -> DataFrame:
    """Vectors of one backend. Those of another ``raise`` or are left out (``skip``): their numbers mean other things."""
    if others == "raise":
        foreign = df.where(F.col("backend").isNotNull() & (F.col("backend") != backend)).select("backend").head(1)
        if foreign:
            raise ValueError(f"vectors of backend {foreign[0].backend!r} beside {backend!r}; embed them again or skip them")
    return df.where(F.col("backend") == backend)


def search(records: DataFrame, text: str) -> DataFrame:
    """Records whose joined fields contain the text; an empty text finds all."""
    needle = text.strip().lower()
    fields = ["record_id", "given_name", "family_name", "nationality", "origin_place", "last_seen_place", "source_org"]
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in fields)))
    return records.where(joined.contains(needle)) if needle else records


def page(rows: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows with the count of all and whether some are left out.

    Two narrow passes over the input, a count and a top-n, are cheaper than a window that would shuffle all rows.
    """
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(order).limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def point(records: DataFrame, record_id: str) -> DataFrame:
    found = records.where(F.col("record_id") == record_id)
    if not found.take(1):
        raise KeyError(record_id)
    return found


def problem_tests(column: Callable[[str], Column]) -> Column:
    """Everything wrong with a record whose fields ``column`` gives."""
    blank = lambda c: F.trim(F.coalesce(column(c), F.lit(""))) == ""
    tests = [(blank("record_id"), "record_id is missing"), (blank("given_name") & blank("family_name"), "no name"), (blank("birth_date_raw"), "no birth date"), (F.coalesce(F.size(column("family_members")), F.lit(-1)) < 1, "no relatives")]
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in tests)))


def problems(requests: DataFrame) -> DataFrame:
    """Requests with everything wrong about them; ``problems`` is empty for a good one."""
    return requests.withColumn("problems", problem_tests(F.col))


def pair_payload(pairs: DataFrame, a: DataFrame, b: DataFrame, vectors: DataFrame | None, calibration: tuple[float, float] | None, threshold: float = 60.0, image_base: str | None = None) -> DataFrame:
    """``a_record_id, b_record_id, payload``: both records without their picture, with vector or picture address, and options."""
    p = pairs.select("a_record_id", "b_record_id")
    for side, t in (("a", a), ("b", b)):
        r = t.where("record_id is not null").dropDuplicates(["record_id"])
        keep = [c for c in r.columns if c != "face_image"]
        if vectors is not None:
            r = r.join(vectors.select("record_id", F.col("embeddings").alias("face_embedding")), "record_id", "left")
            keep.append("face_embedding")
        elif image_base and "face_image" in r.columns:
            r = r.withColumn("face_image_url", F.concat(F.lit(image_base), F.col("face_image")))
            keep.append("face_image_url")
        p = p.join(r.select(F.col("record_id").alias(f"{side}_record_id"), F.struct(*keep).alias(f"record_{side}")), f"{side}_record_id")
    options = [F.lit(float(threshold)).alias("review_threshold")]
    if calibration:
        options.append(F.struct(F.lit(calibration[0]).alias("background_mean"), F.lit(calibration[1]).alias("background_sd")).alias("face_calibration"))
    return p.select("a_record_id", "b_record_id", F.to_json(F.struct("record_a", "record_b", F.struct(*options).alias("options"))).alias("payload"))


def payload(a: DataFrame, vectors: DataFrame) -> DataFrame:
    """``record_id, payload``: the record without its picture, with its vector."""
    keep = [c for c in a.columns if c != "face_image"]
    v = vectors.select("record_id", F.col("embeddings").alias("face_embedding"))
    return a.select(keep).join(v, "record_id", "left").select("record_id", F.to_json(F.struct(*keep, "face_embedding")).alias("payload"))


def first_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")
