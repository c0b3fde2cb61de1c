"""Structured Streaming graph maintenance.

Dense ids need a global counter, which a stream cannot keep cheaply; the native stream uses 128-bit hashed ids
(``node_id``) and keeps the key next to the id. One query reads each micro-batch once and appends to one Parquet
log, partitioned by kind and by the micro-batch's time (exactly-once, restartable):

* edges:        (name, src, dst, src_key, dst_key)
* observations: (name, node_id, key, ord, features...)

The state of the nodes is the newest observation of each. ``compact_stream`` writes it as a snapshot that covers the
log up to a micro-batch; ``node_state`` reads the newest snapshot and the log behind it only. Micro-batch times ascend, so an
observation that arrives late lies in a later partition, behind the snapshot.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txgraph.session import scratch_path
from txgraph.sources.readers import read_increments_stream

EDGES, OBSERVATIONS = "edges", "observations"
PIECE = "_piece"
PIECE_ROWS = 200_000  # rows of a file of a replayed batch, and of a task of its micro-batch
_META = ("kind", "name", "node_id", "key", "ord", "src", "dst", "src_key", "dst_key", "ingest", "n_obs")


def node_id(ntype: str, key_col: str) -> Column:
    """128-bit id of a key: 16 bytes; null for a null key."""
    return F.unhex(F.md5(F.concat(F.lit(ntype + "\x1f"), F.col(key_col).cast("string"))))


def graph_log(df: DataFrame, node_cols: dict, edge_defs: dict, features: dict, order_cols: Sequence[str]) -> DataFrame:
    """One row per row and edge type whose keys are present, and per row and node type with its feature
    values: one pass over the rows."""
    feats = sorted({c for fs in features.values() for c in fs})
    text = lambda c: F.col(c).cast("string")
    none = {"node_id": F.lit(None).cast("binary"), "key": F.lit(None).cast("string"), "ord": None, "src": F.lit(None).cast("binary"),
            "dst": F.lit(None).cast("binary"), "src_key": F.lit(None).cast("string"), "dst_key": F.lit(None).cast("string")}
    order = F.struct(*[F.col(c) for c in order_cols])
    none["ord"] = F.when(F.lit(False), order)

    def entry(kind: str, name: str, present: Column, values: dict) -> Column:
        cols = [F.lit(kind).alias("kind"), F.lit(name).alias("name"), *[values.get(c, x).alias(c) for c, x in none.items()],
                *[values.get(c, F.lit(None).cast("double")).alias(c) for c in feats]]
        return F.when(present, F.struct(*cols))

    made = [entry(EDGES, f"{s}__{r}__{d}", F.col(sc).isNotNull() & F.col(dc).isNotNull(),
                  {"src": node_id(s, sc), "dst": node_id(d, dc), "src_key": text(sc), "dst_key": text(dc)})
            for (s, r, d), (sc, dc) in edge_defs.items()]
    made += [entry(OBSERVATIONS, t, F.col(c).isNotNull(), {"node_id": node_id(t, c), "key": text(c), "ord": order}
                   | {f: F.col(f).cast("double") for f in features.get(t, [])}) for t, c in node_cols.items()]
    return df.select(F.explode(F.array(*made)).alias("_x")).where("_x IS NOT NULL").select("_x.*")


def observations(log: DataFrame) -> DataFrame:
    """(ntype, node_id, key, ord, features...) of a log."""
    feats = [c for c in log.columns if c not in _META]
    return log.where(F.col("kind") == OBSERVATIONS).select(F.col("name").alias("ntype"), "node_id", "key", "ord", *feats)


def edges(log: DataFrame) -> DataFrame:
    """(etype, src, dst, src_key, dst_key) of a log."""
    return log.where(F.col("kind") == EDGES).select(F.col("name").alias("etype"), "src", "dst", "src_key", "dst_key")


def newest_state(obs: DataFrame) -> DataFrame:
    """(ntype, node_id, key, ord, features..., n_obs): the newest of each node's rows, which are observations or older
    states (with n_obs)."""
    feats = [c for c in obs.columns if c not in ("ntype", *_META)]
    n = F.col("n_obs") if "n_obs" in obs.columns else F.lit(1)
    agg = obs.groupBy("ntype", "node_id", "key").agg(
        F.max_by(F.struct(F.col("ord"), *[F.col(c) for c in feats]), F.col("ord")).alias("_x"), F.sum(n).cast("bigint").alias("n_obs"))
    return agg.select("ntype", "node_id", "key", "_x.*", "n_obs")


def latest_node_features(obs: DataFrame) -> DataFrame:
    """Newest features per node, of a whole table of observations (batch)."""
    return newest_state(obs).drop("ord")


def start_graph_stream(stream: DataFrame, node_cols: dict, edge_defs: dict, features: dict,
                       order_cols: Sequence[str], out_dir: str, available_now: bool = True) -> StreamingQuery:
    """Start the query that appends to ``out_dir``/log; its checkpoint lies beside it."""
    log = graph_log(stream, node_cols, edge_defs, features, order_cols).withColumn("ingest", F.unix_millis(F.current_timestamp()))
    w = (log.writeStream.format("parquet").outputMode("append").partitionBy("kind", "ingest")
         .option("path", f"{out_dir}/log").option("checkpointLocation", f"{out_dir}/_checkpoint"))
    return (w.trigger(availableNow=True) if available_now else w).start()


def run_graph_stream(spark: SparkSession, source_dir: str, schema, node_cols: dict, edge_defs: dict,
                     features: dict, order_cols: Sequence[str], out_dir: Optional[str] = None,
                     glob: Optional[str] = None, max_files_per_trigger: int = 1, tasks: Optional[int] = None) -> str:
    """Work off the increment files that a directory holds now; returns the output folder. Called again
    with the same folder it goes on with the files that are new. A task sorts its part of the log by kind, several rows for
    a row that it reads: ``tasks`` (default: Spark's file splits) deals the rows of a micro-batch over so many."""
    out_dir = out_dir or scratch_path(spark, "graph-stream")
    stream = read_increments_stream(spark, source_dir, schema, max_files_per_trigger, glob)
    if tasks is not None and tasks > 1:
        stream = stream.repartition(tasks)
    start_graph_stream(stream, node_cols, edge_defs, features, order_cols, out_dir).awaitTermination()
    return out_dir


def read_log(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/log")


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _snapshots(spark: SparkSession, out_dir: str) -> list[int]:
    """Micro-batch times that finished snapshots cover, ascending."""
    fs, p = _files(spark, f"{out_dir}/snapshot")
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(d.getName().partition("=")[2]) for d in done)


def _behind(spark: SparkSession, out_dir: str, upto: int) -> DataFrame:
    return read_log(spark, out_dir).where(F.col("ingest") > upto)


def node_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """(ntype, node_id, key, ord, features..., n_obs) after all finished micro-batches: the newest snapshot and the
    log behind it."""
    done = _snapshots(spark, out_dir)
    tail = observations(_behind(spark, out_dir, done[-1] if done else -1)).withColumn("n_obs", F.lit(1).cast("bigint"))
    return newest_state(spark.read.parquet(f"{out_dir}/snapshot/upto={done[-1]}").unionByName(tail) if done else tail)


def compact_stream(spark: SparkSession, out_dir: str) -> int:
    """Write a snapshot of the state that covers every finished micro-batch, and remove those before the last one;
    returns the time that it covers."""
    done = _snapshots(spark, out_dir)
    upto = _behind(spark, out_dir, done[-1] if done else -1).agg(F.max("ingest")).first()[0]
    if upto is None:
        return done[-1] if done else -1
    tail = observations(_behind(spark, out_dir, done[-1] if done else -1).where(F.col("ingest") <= upto)).withColumn("n_obs", F.lit(1).cast("bigint"))
    old = [spark.read.parquet(f"{out_dir}/snapshot/upto={done[-1]}")] if done else []
    newest_state(old[0].unionByName(tail) if old else tail).write.parquet(f"{out_dir}/snapshot/upto={upto}")
    for t in done[:-1]:
        fs, p = _files(spark, f"{out_dir}/snapshot/upto={t}")
        fs.delete(p, True)
    return int(upto)


def replay_pieces(df: DataFrame, batch_col: str, piece_rows: int = PIECE_ROWS) -> int:
    """Pieces into which the largest batch must be cut for at most about ``piece_rows`` rows each."""
    most = df.groupBy(batch_col).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-most // piece_rows))


def with_pieces(df: DataFrame, pieces: int) -> DataFrame:
    """Rows with the piece (``PIECE``) of their batch, by a hash of the row."""
    return df.withColumn(PIECE, F.pmod(F.xxhash64(*df.columns), F.lit(pieces)).cast("int"))


def write_replay_batches(df: DataFrame, batch_col: str, out_dir: str) -> str:
    """Replay source (T1): a folder of files per batch number, with modification times in the order of the
    numbers, because a file source takes its files by time. Files that lie there already count as earlier. A batch is
    one file, or one a piece when the rows have pieces (``with_pieces``): no task writes a whole large batch."""
    fs, p = _files(df.sparkSession, out_dir)
    files = lambda: {f.getPath().toString(): f for f in _parquet_files(fs, p)} if fs.exists(p) else {}
    before = files()
    folders = [batch_col, *([PIECE] if PIECE in df.columns else [])]
    df.repartition(*folders).write.mode("append").partitionBy(*folders).parquet(out_dir)
    number = lambda path: int(path.split("/")[-1 - len(folders)].rpartition("=")[2])
    new = sorted((number(k), k) for k in files().keys() - before.keys())
    start = max([f.getModificationTime() for f in before.values()], default=1_000_000_000_000)
    for i, (_, path) in enumerate(new, 1):
        fs.setTimes(spark_path(df.sparkSession, path), start + 1000 * i, -1)
    return out_dir


def spark_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _parquet_files(fs, p) -> list:
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        if f.getPath().getName().endswith(".parquet"):
            out.append(f)
    return out
