"""Shared storage and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Bytes of rows that a task and its Python worker exchange at once in a pipeline.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, on one machine, as in tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of Arrow batches in this session, unless it sets them itself; a longer row is a batch of its own.

    Spark's own bounds (10,000 rows, 64 MB) let whole partitions of text stand at once in the JVM's buffers, which double as
    they grow, and in the worker, coming and going. Results don't depend on it. It holds for what is run later as well, since a
    lazy result takes it from the session when it is written.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, f"{most}b")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what `materialise` wrote for this table."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written on the way, to be deleted when what reads them has been written in turn."""

    def __init__(self):
        self.written: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(materialise(df, name))
        return self.written[-1]

    def drop(self) -> None:
        for df in self.written:
            discard(df)
        self.written = []


def _forest(batches):
    """Union-find over one partition's edges: each node of the partition with the smallest node it reaches."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        out = [(x, root(x)) for x in up]
        frame = pd.DataFrame(out, columns=["a", "b"])
        yield frame[frame["a"] != frame["b"]]


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every node of `edges` (columns a, b: long), component_id being its component's smallest id.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each partition's edges are first reduced to a
    spanning forest, so a round shuffles at most one edge for each node and partition; minima are combined before the
    shuffle, and the join on the node is one that adaptive execution can split. Every round is written to the shared folder.
    """
    schema = "a long, b long"
    cur = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(_forest, schema), "cc")
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each neighbour above a node is hung on the smallest node in reach
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: a node and its smaller neighbours are hung on the smallest of them, whose own row stands for the node
        small = large.join(low, "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()
        new = materialise(small, "cc")
        # done when no node is both hung on another and hung upon, and nothing hangs twice
        ends = new.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("on")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("on")))).alias("x")).select("x.*")
        if (ends.groupBy("id").agg((F.sum("up") + F.when(F.sum("up") > 0, F.max("on")).otherwise(0)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
            discard(cur)
            roots = new.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
            return new.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
        discard(cur)
        cur = new
