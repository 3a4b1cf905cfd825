"""Helpers shared by the operators: table access, written intermediates, Arrow steps."""
from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.session import scratch_path

#: Rows of one Arrow batch. A batch of whole documents is held in memory by a Python
#: worker, so it is kept small; the longest texts decide the peak.
BATCH_ROWS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Set the session's Arrow batch length for plans that pass whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: cuts the lineage with
    files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def held_out(mod: int, id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder (null ids: false)."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % mod
    return F.coalesce(rest == 0, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a text: runs outside [\\x20\\x09-\\x0D]. ``bytes.lower`` and
    ``bytes.split`` treat exactly A-Z and these six characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_HELD: dict[str, Callable[[], object]] = {}


def takes_over(owner: str, forget: Callable[[], object] | None = None) -> None:
    """A Python worker serves one stage after another: drops what other operators than ``owner`` remembered in it.
    ``forget`` drops what ``owner`` remembers between batches. It and its callers reach the worker by name, so
    it must be a function of a module: what a nested function holds is a copy."""
    others = [k for k in _HELD if k != owner]
    for other in others:
        _HELD.pop(other)()
    if forget is not None:
        _HELD[owner] = forget
    if others:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on beside the next stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run``, an Arrow function over a task's batches, that gives freed memory back when the task ends."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


class Step:
    """One Arrow kernel: ``fn(get) -> list of arrays`` for the columns ``fields``; ``get``
    returns a column of the batch (or of an earlier step) by name."""

    def __init__(self, fields: list[tuple[str, T.DataType]], fn: Callable):
        self.fields, self.fn = fields, fn


def apply_steps(df: DataFrame, steps: list[Step], drop: tuple[str, ...] = ()) -> DataFrame:
    """Run Arrow kernels one after the other inside one ``mapInArrow``. New columns replace
    input columns of the same name; ``drop`` names columns that need not return to Spark."""
    made = {n: t for s in steps for n, t in s.fields}
    # an input column that a step overwrites is still an input of the steps before it
    kept = [f for f in df.schema.fields if f.name not in made and f.name not in drop]
    out = T.StructType(kept + [T.StructField(n, t) for n, t in made.items() if n not in drop])
    names = [f.name for f in out.fields]

    def run(batches):
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            for s in steps:
                cols.update(zip((n for n, _ in s.fields), s.fn(cols.__getitem__)))
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return df.mapInArrow(lean(run), out)


def texts_of(col: pa.Array) -> list[str]:
    """Python texts of an Arrow column, null as empty."""
    return [t if t is not None else "" for t in col.to_pylist()]
