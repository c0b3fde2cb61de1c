"""Session helpers: a local session for tests/bench and the shared scratch folder.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names (a
shared file system); only when it is unset (local tests) do we pick our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Iterator, Optional

from pyspark.sql import SparkSession

_written: ContextVar[Optional[list]] = ContextVar("written", default=None)


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "txgraph") -> SparkSession:
    """Session for tests and the bench: UTC, AQE on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Read from the session (``spark.checkpoint.dir``); set our own only where unset.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="txgraph-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return (sc.getCheckpointDir() or conf_dir).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared scratch folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _written.get() is not None:
        _written.get().append(path)
    return path


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a table of the scratch folder; a path outside it is an error."""
    if not path.startswith(scratch_dir(spark) + "/"):
        raise ValueError(f"{path} is not in the scratch folder")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list]:
    """The scratch tables of the block are removed at its end: for callers that write their results before
    it ends. Yields the list of their paths; one taken off the list stays. If the block fails, all stay."""
    outer = _written.get()
    paths: list = []
    token = _written.set(paths)
    try:
        yield paths
    except BaseException:
        if outer is not None:
            outer.extend(paths)
        raise
    else:
        for p in paths:
            remove_scratch(spark, p)
    finally:
        _written.reset(token)


def handed_over(path: str) -> None:
    """A path taken off the list of a scope that ended counts as one of the surrounding scope."""
    if _written.get() is not None:
        _written.get().append(path)


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover - conf always present in practice
        return int(os.environ.get("TXGRAPH_PARTITIONS", "8"))
