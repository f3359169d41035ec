"""What a session needs: the package where Python workers run, and a folder that all executors share."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's files, unless PYTHONPATH leads the workers to it or it was added before."""
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or getattr(spark.sparkContext, "_palimpsest", False):
        return spark
    where = tempfile.mkdtemp(prefix="palimpsest-")
    shutil.copytree(ROOT / "palimpsest", f"{where}/src/palimpsest", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{where}/palimpsest", "zip", f"{where}/src"))
    spark.sparkContext._palimpsest = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a temporary one serves in local mode; on a
    cluster that raises an error, as executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="palimpsest-")
        shared_dir.local = where
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends. It has its scheme, also where spark.checkpoint.dir has none:
    what writes files by other means than Spark's takes a local path without one for a folder on each executor's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder: what reads it twice reads the same rows, and a lost executor costs nothing that
    came before."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
