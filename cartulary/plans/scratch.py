"""Tables in the shared folder that cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: list[str] = []
_KEPT_UNTIL_EXIT: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share; all of an
    application's lie in one folder, which goes when the driver's Python ends.

    Where the setting is missing, a local master (tests) gets one temporary
    folder of its own; a real cluster must name a shared folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="spark-cartulary-"))
        base = _LOCAL_SCRATCH[0]
    home = f"{base.rstrip('/')}/cartulary-{spark.sparkContext.applicationId}"
    if home not in _KEPT_UNTIL_EXIT:
        _KEPT_UNTIL_EXIT.add(home)
        atexit.register(_drop_home, spark, home)
    return f"{home}/{uuid.uuid4().hex}"


def _drop_home(spark: SparkSession, home: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session has not been stopped before
        drop_path(spark, home)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no plan refers to any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
