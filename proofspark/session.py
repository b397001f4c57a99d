"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", name: str = "proofspark") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster use the cluster's own."""
    partitions = 8 if cpus == "*" else int(cpus)
    return pin_utc(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> SparkSession:
    """Readings hold UTC wall-clock timestamps, so dates and hours are taken in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
