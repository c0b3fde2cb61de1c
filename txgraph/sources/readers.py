"""Readers and writers."""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str, columns: Optional[Iterable[str]] = None) -> DataFrame:
    """Parquet scan (S1). Selecting columns here lets Catalyst prune the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: Optional[StructType | str] = None,
             columns: Optional[Iterable[str]] = None) -> DataFrame:
    """CSV scan with header (S2). Pass a schema in production; inference costs a pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV write with header (S3)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_increments_stream(spark: SparkSession, directory: str, schema: StructType | str,
                           max_files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """Increment source (S4): each file dropped into ``directory`` (``glob``: whose name matches) is
    one increment."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(directory)


def write_graph(graph, path: str, mode: str = "overwrite") -> None:
    """Graph sink (S5): one parquet dataset per node type and per edge triple."""
    for ntype, nodes in graph.nodes.items():
        nodes.write.mode(mode).parquet(f"{path}/nodes/ntype={ntype}")
    for (s, r, d), edges in graph.edges.items():
        edges.write.mode(mode).parquet(f"{path}/edges/etype={s}__{r}__{d}")


def write_summary(summary: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Evaluation summary sink (S6): a one-row DataFrame per mode."""
    summary.coalesce(1).write.mode(mode).format(fmt).save(path)
