"""Spark-side helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from txgraph.llm import textkernel as K
from txgraph.session import scratch_path

FOLDS = 5
SplitFn = Callable[[int, int, np.ndarray, np.ndarray], list]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate table to the shared scratch folder and read it back: lineage is
    cut, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def memory_returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when the task ends, memory that its Python process holds but no longer uses goes back to the
    system. Spark keeps the process for later tasks, where it would add to their own."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
        if trim is not None:
            trim(0)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id (neither learned from nor held out)."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """Only the columns an operator reads, so extra or clashing columns never reach it."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable], max_bytes: int = K.SLICE_BYTES) -> DataFrame:
    """Apply a per-slice function to (doc_id, text, ...) rows with Arrow.

    ``make()`` runs once in each task and returns ``f(rows, data, offs)``: the slice as an Arrow
    batch, its UTF-8 bytes and offsets; f returns the output columns. Slices hold about
    ``max_bytes`` of text, so memory per task does not depend on partition sizes.
    """
    out = to_arrow_schema(_parse(df, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b, data, offs in K.slices(batch.column(at), max_bytes):
                cols = f(batch.slice(a, b - a), data, offs)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == t.type else (c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, type=t.type))
                     for c, t in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(lambda batches: memory_returned(run(batches)), schema)


def _parse(df: DataFrame, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def id_type(df: DataFrame, col: str = "doc_id") -> str:
    return df.schema[col].dataType.simpleString()
