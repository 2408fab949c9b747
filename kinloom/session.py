"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a context, so that their Python finds it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_kinloom_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="kinloom-")) / "kinloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._kinloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "kinloom-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table of which later reads take the columns they need.

    The table lies in the shared folder until the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def remove() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the context is gone and with it the right to delete
            pass

    atexit.register(remove)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``store`` before the end, and what ``release`` deletes."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Delete the shuffles that nothing reads any more."""
    gc.collect()
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Tasks for CPU-bound Python stages over few bytes: as many as shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
