"""The session's shared folder: where tables go that must outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, one of our own if all runs in this machine's process (tests); a cluster must name one."""
    base = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{KEY} isn't set: executors need a folder that all of them see")
        base = getattr(spark, "_kithbase_dir", None)
        if base is None:
            own = tempfile.mkdtemp(prefix="kithbase-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = spark._kithbase_dir = f"file://{own}"
    return base.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/kithbase/{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: tasks lost later are redone from the table, which
    all executors see, and nothing above it runs twice.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kithbase_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that stash() gave, once nothing that is still to run reads them. Other frames are left alone."""
    for df in tables:
        path = getattr(df, "_kithbase_path", None)
        if path is not None:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
