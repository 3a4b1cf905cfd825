"""Session helpers: a tuned local session for tests/bench, and the shared scratch folder.

Library functions never create sessions; they take DataFrames. These helpers exist for
tests, the bench and the query catalog.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "spendlake",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with AQE, UTC and the UI off (tests and bench only)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPENDLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to a shared filesystem (HDFS, object store).
    Only when it is unset (local tests) a fresh local folder is created and registered.
    """
    root = spark.conf.get(SCRATCH_CONF, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {SCRATCH_CONF} to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spendlake-ckpt-")
        spark.conf.set(SCRATCH_CONF, root)
    try:
        spark.sparkContext.setCheckpointDir(root)
    except Exception:  # already set / not allowed on connect sessions
        pass
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused sub-path of the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cpu_parallelism(spark: SparkSession) -> int:
    """Task count for CPU-heavy work on small tables: the cluster's cores (or the shuffle
    partition setting, if larger)."""
    cores = spark.sparkContext.defaultParallelism
    try:
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    except ValueError:  # a non-numeric setting (some platforms allow "auto")
        shuffle = cores
    return max(cores, min(shuffle, 4 * cores))


def spread(df):
    """Round-robin ``df`` over ``cpu_parallelism`` tasks. Used on distinct-value tables that
    feed per-row CPU-heavy expressions (similarity, title case): AQE would otherwise merge
    their small post-shuffle partitions into a few tasks, since it sizes by bytes, not by
    CPU. A user repartition by number is kept as is, and is also an optimizer barrier."""
    return df.repartition(cpu_parallelism(df.sparkSession))


def spread_few_splits(df):
    """``spread`` only when the input has fewer partitions than cores (e.g. a file with
    one row group): for per-row CPU-heavy work on whole texts. Inputs with many splits
    (any large table) are returned unchanged, so this never adds a shuffle at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def distinct_spread(df, col: str):
    """Distinct values of ``col`` spread over ``cpu_parallelism`` tasks. Values are combined
    before the exchange, so one that most rows share costs a row per task."""
    return spread(df.select(col).distinct())


def number_rows(df, name: str, *order):
    """``df`` with a dense row number from 0 in ``order``, without a one-task window: rows are
    range-partitioned and sorted, written to the scratch folder with their place in the
    partition, and each partition's offset is the count of the rows before it. Rows that
    tie in ``order`` follow each other in any order; name columns that break ties."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    place = F.monotonically_increasing_id()  # the partition above 33 bits of row number
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place")).write.parquet(path))
    rows = spark.read.parquet(path)
    held = rows.groupBy("_part").agg((F.max("_place") + 1).alias("_held"))  # one row per partition
    before = F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
