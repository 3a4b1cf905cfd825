"""CSV records over several lines, cut in parallel.

A quoted cell may hold line breaks, so where a record ends depends on all quotes before it. Files are
read as lines, which Spark splits into blocks. One pass sums up each block: the parity of its quotes, which
tells the state at its end for either state at its start. A prefix scan over the blocks of a file
then fixes every block's starting state, and a second pass cuts all blocks into records at once.
Records that cross blocks come out in pieces and are put together by block order.

Both passes must see the same blocks: ``lines_of`` pins the least number of partitions, on which
Spark's block size depends, in the session unless it is set.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.session import scratch_path

#: Blocks that start inside a quoted cell, broadcast up to this number (about 150 bytes each).
MAX_BROADCAST_BLOCKS = 500_000
BLOCKS = "file_path string, _blk long, odd int, multi int, head string, head_mid long"
PIECES = "file_path string, _blk long, _mid long, kind int, value string"
#: What a row of ``pieces`` is: a whole record, one that goes on in the next block, the end of one
#: from an earlier block, a block inside of one.
WHOLE, OPEN, END, INSIDE = range(4)


def lines_of(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """All lines of the files under ``paths``: value, file_path, _blk (byte where the block
    starts), _mid (row id that grows within a block). ``glob``: only files of that name, in all folders below."""
    pinned = "spark.sql.files.minPartitionNum"
    if spark.conf.get(pinned, None) is None:
        spark.conf.set(pinned, str(spark.sparkContext.defaultParallelism))
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    # the metadata holds an encoded path, the listing a plain one
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return reader.text(paths if isinstance(paths, str) else list(paths)).select(
        "value", path.alias("file_path"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"))


def quotes(c) -> F.Column:
    """1 where the number of quotes is odd."""
    c = F.col(c) if isinstance(c, str) else c
    return ((F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2).cast("int")


def _runs(batch: pa.RecordBatch):
    """(first row, end) of the runs of one block in a batch; blocks of a file are contiguous in a task."""
    blk = batch.column("_blk").to_numpy()
    path = batch.column("file_path").dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero((blk[1:] != blk[:-1]) | (path[1:] != path[:-1])) + 1
    edges = [0, *cut.tolist(), len(blk)]
    return zip(edges[:-1], edges[1:])


def blocks_of(lines: DataFrame) -> DataFrame:
    """One row per block, written to the scratch folder: parity of its quotes (``odd``), whether a line of it has
    an odd number of them (``multi``), the first line that is not empty of a file's first block with its row id."""
    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            odd, mid, first = b.column("odd").to_numpy(), b.column("_mid").to_numpy(), b.column("first")
            for i, j in _runs(b):
                key = (b.column("file_path")[i].as_py(), b.column("_blk")[i].as_py())
                if held is None or held[:2] != key:
                    if held is not None:
                        yield _row(held)
                    held = (*key, 0, 0, None, None)
                flips = int(odd[i:j].sum())
                _, _, parity, multi, head, at = held
                if head is None and key[1] == 0:
                    k = next((k for k in range(i, j) if first[k].as_py()), None)
                    head, at = (first[k].as_py(), int(mid[k])) if k is not None else (None, None)
                held = (*key, (parity + flips) % 2, int(multi or flips > 0), head, at)
        if held is not None:
            yield _row(held)

    def _row(held):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, kinds)],
                                          names=["file_path", "_blk", "odd", "multi", "head", "head_mid"])

    spark = lines.sparkSession
    path = scratch_path(spark, "csv-blocks")
    # text travels to the workers for first blocks only
    lines.select("file_path", "_blk", "_mid", quotes("value").alias("odd"), F.when(F.col("_blk") == 0, F.col("value")).alias("first")) \
        .mapInArrow(run, BLOCKS).write.parquet(path)
    return spark.read.parquet(path)


def inside_at_start(blocks: DataFrame) -> DataFrame:
    """The prefix scan: blocks that start inside a quoted cell."""
    before = F.sum("odd").over(Window.partitionBy("file_path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("file_path", "_blk", (F.coalesce(before, F.lit(0)) % 2).alias("inside")).where("inside = 1")


def pieces(lines: DataFrame) -> DataFrame:
    """Lines of blocks (with ``inside``, in order within a block) cut into records and pieces of records."""
    def run(batches):
        key, held, held_mid, inside, fresh = None, [], None, False, True
        out: list = []

        def flush(open_: bool):
            """What is held is one row: a record, or a piece if it began before or goes on after its block."""
            nonlocal held, held_mid
            if held:
                began = held_mid is not None
                kind = (OPEN if began else INSIDE) if open_ else (WHOLE if began else END)
                out.append((*key, held_mid if began else -1, kind, "\n".join(held)))
            held, held_mid = [], None

        def emitted():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                                              names=["file_path", "_blk", "_mid", "kind", "value"])

        for b in batches:
            if not b.num_rows:
                continue
            value, mid = b.column("value"), b.column("_mid").to_numpy()
            odd = b.column("odd").to_numpy()
            for i, j in _runs(b):
                at = (b.column("file_path")[i].as_py(), b.column("_blk")[i].as_py())
                if at != key:
                    if key is not None:
                        flush(inside)
                    key, inside = at, bool(b.column("inside")[i].as_py())
                state = (np.cumsum(odd[i:j]) + inside) % 2  # after each line
                starts = np.flatnonzero(np.append(int(inside), state[:-1]) == 0)
                inside = bool(state[-1])
                first = starts[0] if len(starts) else j - i
                held += value.slice(i, first).to_pylist()
                if not len(starts):
                    continue
                flush(False)
                if len(starts) > 1:  # all but the last are whole records
                    cells = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), value.slice(i + 0, j - i))
                    n = len(starts) - 1
                    if out:
                        yield emitted()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1])), pa.array(mid[i + starts[:-1]]), pa.array(np.full(n, WHOLE), pa.int32()),
                         pc.binary_join(cells, "\n")], names=["file_path", "_blk", "_mid", "kind", "value"])
                held, held_mid = value.slice(i + starts[-1], j - i - starts[-1]).to_pylist(), int(mid[i + starts[-1]])
            if out:
                yield emitted()
        if key is not None:
            flush(inside)
        if out:
            yield emitted()

    return lines.select("file_path", "_blk", "_mid", "value", "inside", quotes("value").alias("odd")).mapInArrow(run, PIECES)


def records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """file_path, _blk, _mid (of its first line) and value of every record of the files in ``blocks``; lines
    within a record are joined by a line feed. Files must have balanced quotes."""
    inside = inside_at_start(blocks)
    crossing = inside.count()
    if crossing <= MAX_BROADCAST_BLOCKS:  # the scan's order within blocks stays
        marked = lines.join(F.broadcast(inside), ["file_path", "_blk"], "left")
    else:
        marked = lines.join(inside.hint("merge"), ["file_path", "_blk"], "left").sortWithinPartitions("file_path", "_blk", "_mid")
    cut = pieces(marked.withColumn("inside", F.coalesce("inside", F.lit(0))))
    whole = cut.where(F.col("kind") == WHOLE).drop("kind")
    if not crossing:
        return whole
    parts = cut.where(F.col("kind") != WHOLE)
    # in a block the end of an earlier record stands before the one that goes on
    order = Window.partitionBy("file_path").orderBy("_blk", F.when(F.col("kind") == OPEN, 1).otherwise(0))
    chains = parts.withColumn("chain", F.sum(F.when(F.col("kind") == OPEN, 1).otherwise(0)).over(order))
    joined = chains.groupBy("file_path", "chain").agg(F.min("_blk").alias("_blk"), F.max("_mid").alias("_mid"),
                                                      F.array_sort(F.collect_list(F.struct("_blk", "value"))).alias("parts"))
    return whole.unionByName(joined.select("file_path", "_blk", "_mid", F.array_join("parts.value", "\n").alias("value")))
