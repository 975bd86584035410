"""Session factory and the few settings that operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "plumage", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, ANSI, AQE and Arrow on. ``master`` is left to spark-submit when None."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that all executors share and read it back.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is unset and Spark runs inside one
    process (tests) a temporary folder is set. Nothing is kept on a single executor, so its loss costs nothing.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="plumage-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes (of the rows written out as JSON).

    At most ``max_rows + 1`` rows are read. A ``df`` that is dear to compute should have its lineage cut before.
    """
    some = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).limit(max_rows + 1)
    rows, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """``broadcast(df)`` if it is proven to be small, else ``df`` unhinted."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, its rows spread evenly where it would run as fewer tasks than the cluster has cores.

    For operators that spend far more time on a row than its transfer takes: files of few row groups are read by as few
    tasks. Inputs of many splits are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
