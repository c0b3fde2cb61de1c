"""Append-only tables of Parquet deltas.

A table is a list of folders, one per increment, each row with the number of its increment. Adding an
increment writes its rows and nothing else; a reader takes the newest (or oldest) row of a key, a
``max_by`` that Spark aggregates before its shuffle. A table value is immutable: ``append`` and ``compact``
return another one that shares the folders, so an older state stays readable.

``compact`` keeps the number of folders small at a cost that follows what was added: everything but the first
folder is merged into one, and the first only once the others hold half as many rows as it does.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Optional, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from txgraph.session import scratch_path

VERSION = "_version"


@dataclass(frozen=True)
class DeltaTable:
    spark: SparkSession = field(compare=False, repr=False)
    name: str
    schema: StructType = field(repr=False)
    key: tuple = ()          # rows of one key replace each other; () keeps all rows
    keep: str = "newest"     # or "oldest"
    parts: tuple = ()        # (folder, rows), in the order of their increments

    @classmethod
    def create(cls, df: DataFrame, name: str, key: Sequence[str] = (), keep: str = "newest") -> "DeltaTable":
        """The table whose first delta (increment 0) is ``df``."""
        if keep not in ("newest", "oldest"):
            raise ValueError(keep)
        return cls(df.sparkSession, name, df.schema, tuple(key), keep).append(df, 0)

    def append(self, df: DataFrame, version: int) -> "DeltaTable":
        """With the rows of one increment added: they are all that is written."""
        return replace(self, parts=(*self.parts, self._written(df.select(*self.schema.names, F.lit(version).cast("bigint").alias(VERSION)))))

    def _written(self, df: DataFrame) -> tuple[str, int]:
        path, seen = scratch_path(self.spark, f"delta-{self.name}"), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return path, int(seen.get["n"])

    @property
    def last_rows(self) -> int:
        return self.parts[-1][1]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.parts)

    def raw(self, parts: Optional[Sequence[tuple]] = None) -> DataFrame:
        """All rows of some folders (default: all), with the number of their increment."""
        schema = StructType([*self.schema.fields]).add(VERSION, LongType())
        return self.spark.read.schema(schema).parquet(*[p for p, _ in (self.parts if parts is None else parts)])

    def _settled(self, df: DataFrame) -> DataFrame:
        """One row per key, version kept."""
        if not self.key:
            return df
        rest = [c for c in self.schema.names if c not in self.key]
        pick, edge = (F.max_by, F.max) if self.keep == "newest" else (F.min_by, F.min)
        got = df.groupBy(*self.key).agg(pick(F.struct(F.lit(0).alias("_"), *rest), VERSION).alias("_row"), edge(VERSION).alias(VERSION))
        return got.select(*[F.col(c) if c in self.key else F.col(f"_row.{c}").alias(c) for c in self.schema.names], VERSION)

    def read(self) -> DataFrame:
        """The table as it stands."""
        df = self.raw()
        return (self._settled(df) if len(self.parts) > 1 else df).drop(VERSION)

    def compact(self, max_parts: int = 1) -> "DeltaTable":
        """With at most ``max_parts`` folders before anything is rewritten, and at most two after."""
        if len(self.parts) <= max_parts:
            return self
        first, others = self.parts[:1], self.parts[1:]
        if max_parts < 2 or 2 * sum(n for _, n in others) >= first[0][1]:
            return replace(self, parts=(self._written(self._settled(self.raw())),))
        return replace(self, parts=(*first, self._written(self._settled(self.raw(others)))))
