"""Parts of files by byte range, read in tasks: first bytes for file types, blocks for content hashes.

No file is loaded whole and no content travels through Spark. Files are opened with
``pyarrow.fs`` (local files, HDFS, S3, GCS) from the paths of the listing.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.session import spread

#: Bytes of a leaf of the hash tree, children of an inner node, bytes read at once.
BLOCK_BYTES, FAN, STEP = 64 << 20, 1024, 1 << 20


def open_file(path: str):
    """A random-access file of a listed path (``file:/x``, ``hdfs://...``, a plain path)."""
    scheme, _, rest = path.partition(":")
    if "/" in scheme or scheme == "file" or not rest:
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if scheme == "file" else path)
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def first_bytes(files: DataFrame, n: int) -> DataFrame:
    """``files`` (column ``file_path``) with the first ``n`` bytes of every file as ``head``."""
    cols = files.columns

    def run(batches):
        for b in batches:
            heads = []
            for path in b.column("file_path").to_pylist():
                with open_file(path) as f:
                    heads.append(f.read(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.binary())], names=[*cols, "head"])

    return spread(files).mapInArrow(run, files.schema.add("head", "binary"))


def block_hashes(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file_path, node, hash``: sha256 (hex) of every block of every file (``file_path, file_size``), an
    empty file has one empty block."""
    last = F.greatest(F.ceil(F.col("file_size") / block_bytes).cast("long") - 1, F.lit(0).cast("long"))
    blocks = files.select("file_path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("node"))

    def run(batches):
        for b in batches:
            out = []
            for path, node in zip(b.column("file_path").to_pylist(), b.column("node").to_pylist()):
                digest, left = hashlib.sha256(), block_bytes
                with open_file(path) as f:
                    f.seek(node * block_bytes)
                    while left and (part := f.read(min(STEP, left))):
                        digest.update(part)
                        left -= len(part)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("file_path"), b.column("node"), pa.array(out, pa.string())], names=["file_path", "node", "hash"])

    return spread(blocks).mapInArrow(run, "file_path string, node long, hash string")


def content_hashes(files: DataFrame, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """``file_path, file_hash`` of files of any size: the sha256 of the content for files of one block; else the root of
    a tree whose leaves are the hashes of the blocks and whose nodes are the sha256 of the (hex) hashes of
    up to ``fan`` children. Levels follow from the largest file; a group holds ``fan`` hashes at most."""
    most = files.agg(F.max("file_size").alias("n")).first().n or 0
    level, nodes = block_hashes(files, block_bytes), max(1, -(-most // block_bytes))
    while nodes > 1:
        up = level.groupBy("file_path", F.floor(F.col("node") / fan).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), "hash"))).alias("c"))
        # the only node of a file is its root already
        alone = (F.size("c") == 1) & (F.col("node") == 0)
        level = up.select("file_path", "node", F.when(alone, F.col("c")[0]["hash"]).otherwise(F.sha2(F.array_join("c.hash", ""), 256)).alias("hash"))
        nodes = -(-nodes // fan)
    return level.select("file_path", F.col("hash").alias("file_hash"))
