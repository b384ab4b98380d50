"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and coalesces small ones; UTC keeps epoch arithmetic exact.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, name: str = "flowsift", memory: str = "12g",
                  shared: str | None = None) -> SparkSession:
    """Single-JVM session for tests and the benchmark; ``shared`` is its folder for written tables, which
    Spark takes at the start only."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # Recording the Python call site of every column expression costs more than building it.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a folder under the system's
    temporary directory. On a cluster the setting is taken as given: a folder that is mounted on all machines
    may be named without a scheme or with ``file:``.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), "flowsift-shared")
    os.makedirs(fallback, exist_ok=True)
    return fallback


def scratch_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


# Written tables that an enclosing ``intermediates`` block owns, innermost last.
_owned: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that ``materialise`` writes inside the block and drops them at its end.

    Results must be written or collected within the block, as they still read these tables.
    """
    _owned.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _owned.pop():
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def materialise(df: DataFrame, stem: str = "stage", outer: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage before a table is used by several jobs. The result survives the loss of
    executors because it is a table, not executor storage. It stays until the enclosing
    ``intermediates`` block ends; without one, the folder's owner removes it. ``outer`` gives it to the block around
    that one, as the result for which the inner block's tables were made.
    """
    path = scratch_path(df.sparkSession, stem)
    owners = _owned[:-1] if outer else _owned
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
