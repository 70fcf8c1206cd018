"""A Spark session with the settings the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch in which rows go to Python workers.
ARROW_BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python workers a few megabytes at a time: texts are long, and a worker should hold few."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def local_session(name: str = "cartulary", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive execution, no user interface."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
