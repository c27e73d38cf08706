"""Shared plumbing of the corpus operators: shared-folder tables and bounded Arrow blocks."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
BLOCK_BYTES = 4 << 20
#: The session's bound of what goes to a worker at once, and its default.
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: What operators remember in a Python worker from task to task: how to forget it, by operator.
_FORGET: dict[str, Callable[[], None]] = {}


def claim(operator: str, forget: Callable[[], None]) -> None:
    """Called as a task begins: what other operators remember in this worker is dropped, as workers live on."""
    others = [name for name in _FORGET if name != operator]
    for name in others:
        _FORGET.pop(name)()
    _FORGET[operator] = forget
    if others:
        gc.collect()
        trim()


def trim() -> None:
    """Give free memory back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    if (give := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give(0)


def small_batches(spark: SparkSession) -> None:
    """Batches no larger than a block, so that a task needs no more off its heap; a session's own choice stays."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BLOCK_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where the session leaves it unset (tests, one machine) a folder below the warehouse is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/.shared").rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._annalist_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a ``table()`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._annalist_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget plans that are done with; only then do executors delete their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], by: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``by`` column holds at most ``limit`` bytes, or a single row. At the end free memory goes back."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(by))
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
    trim()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    col = column(batch, name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def data_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(data_path(sf_dir, name))


def append(df: DataFrame, start, added: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with further columns, computed block by block in Arrow.

    ``start()`` runs once a task and gives a function from a block to the arrays of ``added``. The rows keep their
    order and all their columns but those that ``added`` names anew; ``df`` has a string column ``text``.
    """
    small_batches(df.sparkSession)
    df = df.drop(*(x.split()[0] for x in added.split(", ")))
    names = [*df.columns, *(x.split()[0] for x in added.split(", "))]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for block in blocks(batches, limit=limit):
            yield pa.RecordBatch.from_arrays([*block.columns, *make(block)], names)

    return df.mapInArrow(run, f"{fields}, {added}")
