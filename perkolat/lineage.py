"""Written cuts of the lineage in the folder that driver and executors share, and checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. One is set only where none is, and only on a local master, as in tests."""
    sc = spark.sparkContext
    if not (at := sc.getCheckpointDir()):
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="perkolat-checkpoint-")
            atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/perkolat-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here and a lost executor costs no recomputation.

    Unlike checkpoint(), which computes its input twice, a table is computed once and can be scanned by column."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.scratch)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans, broadcasts and shuffle files that nothing refers to go, and the heap gives memory back, which it
    else does not before it is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else df, for a shuffled join. df should be written."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
