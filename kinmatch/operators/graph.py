"""Connected components by alternating large and small stars, and results cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; where unset, as in tests, a local folder, but never on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/kinmatch-checkpoints"


def saved(df: DataFrame) -> DataFrame:
    """df, computed once, in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `saved`, as Parquet: for many rows of few distinct values it takes a part of a checkpoint's space, and readers only read the columns they need."""
    folder = f"{shared_folder(df.sparkSession)}/kinmatch-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what `stored` wrote, when nothing reads it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._stored_in)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Edges to a task: few edges in many tasks cost shuffle files and scheduling, not work.
EDGES_A_TASK = 50_000


def tasks_for(rows: int, each: int = EDGES_A_TASK) -> int:
    return 1 + rows // each


def _ordered(edges: DataFrame, tasks: int) -> DataFrame:
    rows = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return rows.coalesce(tasks).distinct()


def _stars(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node's smallest neighbour (itself included) gets its larger (or all its smaller) neighbours."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    moved = joined.where("b > a") if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(out if large else out.union(least.select("a", F.col("m").alias("b"))), tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component. edges: a, b."""
    now, before = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before and state[0]:
        tasks = tasks_for(state[0])
        before, now = state, saved(_stars(_stars(now.coalesce(tasks), True, tasks), False, tasks))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
