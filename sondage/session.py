"""Session helpers shared by all operators: reading, checked broadcasts, lineage cuts, parallelism."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of its columns as text, that an operator broadcasts; above it the same join shuffles.
BROADCAST_BYTES = 32 << 20


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sondage")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SONDAGE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` stored as Parquet under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def width(df: DataFrame) -> int:
    """Total bytes of ``df`` written as text: one aggregate over the table."""
    size = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(1)) for c in df.columns), F.lit(0))
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit``, else ``df`` itself (the join then shuffles)."""
    return F.broadcast(df) if width(df) <= limit else df


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """A scanned table over at least one partition a core; one that already has them isn't shuffled. Not for plans with shuffles: asking for their partitions runs them."""
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="sondage-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch(spark: SparkSession) -> str:
    """This session's own folder in the shared one; it is deleted when the driver ends, as its tables are needed no longer."""
    own = f"{shared_folder(spark)}/sondage-{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH.add(own)
        atexit.register(_delete, spark, own)
    return own


_SCRATCH: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    """What is left of a session; nothing if its JVM has ended before."""
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001
        return


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: its lineage is cut, its size known, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
