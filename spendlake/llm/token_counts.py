"""Token counts of flat, unindexed token files by a separator scan.

A token file is a plain sequence of fixed-width ids in which every document is followed by
an end-of-document id; nothing tells where documents begin. Files are cut into blocks of
equal length. Each block is searched for the separator in one vector operation, and the
documents that cross block borders are stitched by a prefix scan over small per-block
summaries (separators so far, position of the last one). The scan has two levels, runs of
``SEGMENT`` blocks and whole files, so that no task ever holds the blocks of one file.

Results: one row per document: ``file``, ``doc_no`` (0, 1, ... in the file), ``start``
(token offset), ``n_tokens``, ``closed`` (false for trailing ids without a separator).
Empty files give no rows; two adjacent separators enclose a document of 0 tokens.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.common import texts_of, written
from spendlake.session import scratch_path

#: Tokens read at once, and blocks of one run of the prefix scan.
BLOCK_TOKENS, SEGMENT = 1 << 20, 1024


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def count_tokens(spark: SparkSession, files: DataFrame, eod: int, width: int = 2,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of the token files ``files`` (``file``: URI, ``length``: bytes)."""
    step = block_tokens * width
    blocks = (files.filter(F.col("length") >= width)
              .select("file", F.explode(F.sequence(F.lit(0), ((F.col("length") - width) / step).cast("long"))).alias("block"))
              .repartition("file", "block"))

    def scan(batches):
        for b in batches:
            for file, block in zip(b.column("file").to_pylist(), b.column("block").to_pylist()):
                at, path = _open(file)
                with at.open_input_file(path) as f:
                    raw = f.read_at(min(step, f.size() - block * step), block * step)
                ids = np.frombuffer(raw, f"<u{width}", count=len(raw) // width)
                seps = np.flatnonzero(ids == eod) + block * block_tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.array([seps], pa.list_(pa.int64()))], names=["file", "block", "n_ids", "seps"])

    found = written(blocks.mapInArrow(scan, "file string, block long, n_ids long, seps array<long>"), "separators")
    return stitch(found.withColumn("base", F.col("block") * block_tokens))


def stitch(blocks: DataFrame) -> DataFrame:
    """Prefix scan over block summaries (``file, block, base, n_ids, seps``), then the documents."""
    b = (blocks.withColumn("segment", (F.col("block") / SEGMENT).cast("long"))
         .withColumn("n_sep", F.size("seps").cast("long"))
         .withColumn("last", F.when(F.col("n_sep") > 0, F.element_at("seps", -1))))
    before = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    runs = (b.groupBy("file", "segment").agg(F.sum("n_sep").alias("n"), F.max("last").alias("l"))
            .select("file", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_sep"),
                    F.max("l").over(before).alias("run_last")))
    inner = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = (b.withColumn("own_sep", F.coalesce(F.sum("n_sep").over(inner), F.lit(0)))
         .withColumn("own_last", F.max("last").over(inner))
         .join(runs, ["file", "segment"])
         .withColumn("first_doc", F.col("run_sep") + F.col("own_sep"))
         .withColumn("carry", F.coalesce("own_last", "run_last", F.lit(-1)) + 1))
    docs = (b.select("file", "first_doc", "carry", "seps", F.posexplode("seps").alias("i", "sep"))
            .withColumn("start", F.when(F.col("i") == 0, F.col("carry")).otherwise(F.element_at("seps", F.greatest("i", F.lit(1))) + 1))
            .select("file", (F.col("first_doc") + F.col("i")).alias("doc_no"), "start",
                    (F.col("sep") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed")))
    tail = (blocks.groupBy("file").agg(F.max(F.col("base") + F.col("n_ids")).alias("end"),
                                       F.max(F.when(F.size("seps") > 0, F.element_at("seps", -1))).alias("last"),
                                       F.sum(F.size("seps").cast("long")).alias("doc_no"))
            .withColumn("start", F.coalesce(F.col("last") + 1, F.lit(0))).filter("end > start")
            .select("file", "doc_no", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))
    return docs.unionByName(tail)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, length`` of a folder's token files; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
            .select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), "length"))


_ENC: dict = {}


def tokenizer(path: str):
    """The worker's ``tiktoken`` encoding of a rank file (base64 token, rank)."""
    if path not in _ENC:
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENC[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENC[path]


def write_token_files(docs: DataFrame, ranks_path: str, eod: int, width: int = 2) -> tuple[str, DataFrame]:
    """Tokenize ``docs`` (``doc_id, text``; null text: no tokens) into flat files in the
    shared folder, one per task. Returns the folder and the list of what was written
    (``file, doc_no, doc_id``). Every attempt of a task writes a file of its own name, and
    only files on the list count, so repeated or lost tasks do no harm."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    uri = folder if "://" in folder else ("file://" + folder.removeprefix("file:"))

    def run(batches):
        enc, out, name, doc_no, at = tokenizer(ranks_path), None, f"{uuid.uuid4().hex}.tok", 0, None
        for b in batches:
            if out is None:
                at, base = _open(uri)
                at.create_dir(base, recursive=True)
                out = at.open_output_stream(f"{base}/{name}")
            for t in texts_of(b.column("text")):
                ids = enc.encode_ordinary(t)
                ids.append(eod)
                out.write(np.array(ids, f"<u{width}").tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(doc_no, doc_no + n)),
                                              b.column("doc_id")], names=["name", "doc_no", "doc_id"])
            doc_no += n
        if out is not None:
            out.close()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    listed = docs.select("doc_id", "text").mapInArrow(run, f"name string, doc_no long, doc_id {id_type}")
    return folder, written(listed, "token-list")


def document_counts(docs: DataFrame, ranks_path: str, eod: int) -> DataFrame:
    """``doc_id, n_tokens`` per row of ``docs``: flat files are written, then scanned."""
    spark = docs.sparkSession
    folder, listed = write_token_files(docs, ranks_path, eod)
    if listed.isEmpty():
        return listed.select("doc_id", F.col("doc_no").alias("n_tokens"))
    name = F.element_at(F.split("file", "/"), -1)
    files = list_files(spark, folder).join(listed.select("name").distinct(), name == F.col("name"), "left_semi")
    found = count_tokens(spark, files, eod).withColumn("name", name)
    return listed.join(found, ["name", "doc_no"]).select("doc_id", "n_tokens")


