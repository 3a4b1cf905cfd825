"""Line dedup with levelled sorted runs of line hashes; DataFrame functions only.

A document is split at ``\\n``. A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at
both ends and A-Z lower-cased, held as a 128-bit hash. Keys of at least ``min_chars`` code
points found in at least ``min_docs`` documents lose all their lines in every document.

``LineRuns`` keeps what it has learned as sorted runs of ``(h1, h2, n_docs)`` in levels.
Batches arrive one after the other, each holding whole documents. A batch

1. counts the documents of each of its keys,
2. merge-anti-joins the *settled* run (keys that have reached ``min_docs``, which need no
   more counting), and
3. adds what is left as a sorted run of level 0.

When a level holds ``fanout`` runs they are compacted into one run of the next level: counts
of equal keys are added and keys that reach ``min_docs`` move to the settled run. The last
compaction merges all levels. A key is thus read and written a logarithmic number of times.

Counting combines on the map side, so a line that stands in a third of all documents costs
one row per task. The rows of hot lines meet the settled keys in a plain join, whose hot
partitions Spark's adaptive execution splits.

Null or empty text is one empty line. Documents are the values of ``doc_id`` (null is one
value); repeated rows of a document count once and each gets its own result. An empty table
gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import lower_ascii, text_or_empty, written

#: Characters stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _hashes(*cols: Column) -> list[Column]:
    """128 bits as two longs: the second hash starts from another value."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def _row_key(text_col: str) -> list[Column]:
    a, b = _hashes(F.col("doc_id"), text_or_empty(text_col))
    return [a.alias("r1"), b.alias("r2")]


def key_rows(docs: DataFrame, batches: int, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """One row per line that has a key of at least ``min_chars`` code points: ``batch`` (of
    the document), ``doc_id``, ``r1, r2`` (the row's own hash), ``h1, h2``, ``pos``."""
    lines = docs.select("doc_id", *_row_key(text_col), F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    h1, h2 = _hashes(F.col("key"))
    return keyed.select(F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(batches)).cast("int").alias("batch"),
                        "doc_id", "r1", "r2", h1.alias("h1"), h2.alias("h2"), "pos")


class LineRuns:
    """Levelled runs of key counts; every run is a written table in the shared folder."""

    SCHEMA = "h1 long, h2 long, n_docs long"

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: DataFrame | None = None

    def add(self, keys: DataFrame) -> None:
        """Count a batch (``doc_id, h1, h2``; whole documents, none of them in another batch)."""
        counts = keys.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        if self.settled is not None:
            counts = counts.join(self.settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(0, self._run(counts))

    def frequent(self) -> DataFrame:
        """All keys found in ``min_docs`` documents or more, after merging every level."""
        runs = [r for level in self.levels for r in level]
        self.levels = []
        if runs:
            self._settle(self._merge(runs))
        return self.settled if self.settled is not None else self.spark.createDataFrame([], "h1 long, h2 long")

    def _run(self, counts: DataFrame) -> DataFrame:
        return written(counts.sortWithinPartitions("h1", "h2"), "line-run")

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._settle(merged)
            self._push(level + 1, merged.filter(F.col("n_docs") < self.min_docs))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return self._run(both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")))

    def _settle(self, merged: DataFrame) -> None:
        new = merged.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        both = new if self.settled is None else self.settled.unionByName(new).distinct()
        self.settled = written(both.sortWithinPartitions("h1", "h2"), "settled-lines")


def drop_frequent(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, fanout: int = 2,
                  text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_lines`` (before dropping), ``n_dropped`` and ``kept`` (the other lines
    joined by ``\\n``; empty if none stay). Input columns of these names are replaced."""
    made = ("n_lines", "n_dropped", "kept")
    docs = docs.drop(*made)
    rows = written(key_rows(docs, batches, min_chars, text_col), "line-keys")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for b in range(batches):
        runs.add(rows.filter(F.col("batch") == b))
    gone = (rows.select("r1", "r2", "h1", "h2", "pos").join(runs.frequent(), ["h1", "h2"], "left_semi")
            .groupBy("r1", "r2").agg(F.collect_set("pos").alias("_gone")))
    keyed = docs.select("*", *(c.alias(f"_{n}") for c, n in zip(_row_key(text_col), ("r1", "r2"))))
    keyed = keyed.join(gone.withColumnsRenamed({"r1": "_r1", "r2": "_r2"}), ["_r1", "_r2"], "left")
    lines = F.split(text_or_empty(text_col), "\n", -1)
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col("_gone").isNull(), text_or_empty(text_col)).otherwise(
        F.array_join(F.transform(F.array_except(numbers, F.col("_gone")), lambda i: lines[i]), "\n"))
    return (keyed.withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
            .withColumn("kept", kept).select(*docs.columns, *made))
