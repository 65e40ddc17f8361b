"""Scratch tables in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where it is unset and all tasks run on one machine.

    Elsewhere an unset folder is an error: executors would not see one another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor never loses these rows, and later readers
    see one fixed version of them, with column pruning and size statistics.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.__dict__["_scratch_path"] = path
    return kept


def materialize_count(df: DataFrame, label: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """As :func:`materialize`, with the number of rows, or another aggregate, found as they are written."""
    seen = Observation()
    kept = materialize(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")), label)
    return kept, seen.get["n"]


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, after the scratch table of ``old`` is gone; for rounds of a loop, of which none but the last is read again.

    ``new`` must be written already.  A frame that :func:`materialize` did not
    return is left alone.
    """
    path = old.__dict__.get("_scratch_path")
    if path and path != new.__dict__.get("_scratch_path"):
        spark = old.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return new
