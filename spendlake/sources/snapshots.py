"""Versioned table snapshots (ledger, merchant memory): every update writes its data to a folder
of its own and then publishes version ``n + 1`` by creating the file ``<root>/_versions/<n + 1>``, which
names that folder. Creation fails if the file is there, so of two writers one gets the number and
the other a ``ConflictError``; neither overwrites or tears the other's data. The path being read is never
overwritten; a failed write leaves the previous version current. Readers take the highest version.
Versions are found by listing through the Hadoop FileSystem of the session (HDFS, object stores
with conditional create), not by scanning data. Folders ``version=<n>`` of an older layout are read too.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer has published the version that this one was to be."""


def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _published(spark: SparkSession, root: str) -> dict[int, str]:
    """Complete versions and their data folders."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return {}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out = {}
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("version=") and fs.exists(hadoop(st.getPath(), "_SUCCESS")):
            out[int(name.split("=", 1)[1])] = name
    marks = hadoop(path, "_versions")
    for st in fs.listStatus(marks) if fs.exists(marks) else ():
        name = st.getPath().getName()
        if name.isdigit() and st.getLen():
            with_data = fs.open(st.getPath())
            out[int(name)] = with_data.readUTF()
            with_data.close()
    return out


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, ascending."""
    return sorted(_published(spark, root))


def load_latest(spark: SparkSession, root: str) -> DataFrame | None:
    found = _published(spark, root)
    return spark.read.parquet(f"{root.rstrip('/')}/{found[max(found)]}") if found else None


def save_next(df: DataFrame, root: str, base: int | None = None) -> int:
    """Write ``df`` as the version after ``base`` (the latest one now, if not given); returns its number.
    Raises ``ConflictError`` when that version exists by the time the data is written."""
    spark = df.sparkSession
    if base is None:
        base = max(_published(spark, root), default=0)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root.rstrip('/')}/{folder}")
    fs, path = _fs(spark, root)
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, f"_versions/{base + 1}")
    if (base + 1) in _published(spark, root):
        raise ConflictError(f"version {base + 1} of {root} is taken")
    try:
        out = fs.create(mark, False)
    except Py4JJavaError as e:
        raise ConflictError(f"version {base + 1} of {root} is taken") from e
    out.writeUTF(folder)
    out.close()
    return base + 1


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 5) -> int:
    """Publish ``change(latest)`` and, when another writer was first, change that writer's version instead."""
    for _ in range(attempts):
        found = _published(spark, root)
        latest = spark.read.parquet(f"{root.rstrip('/')}/{found[max(found)]}") if found else None
        try:
            return save_next(change(latest), root, max(found, default=0))
        except ConflictError:
            continue
    raise ConflictError(f"{root}: {attempts} attempts met other writers")
