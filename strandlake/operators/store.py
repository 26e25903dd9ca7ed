"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again; only where that is unset, on one machine, a temporary folder serves."""
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-work-')}"
    path = f"{base.rstrip('/')}/variants-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(df: DataFrame, bytes_each: int = 2 << 20) -> int:
    """Partitions for a shuffle of df that grow with its input (the tables it reads; local rows count as none), so that one fits a task at any size; at least the session's number.

    The planner's estimate of a join is the product of its sides, so tables are summed up instead."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 50)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 1 << 12))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b); root is the least node of its component.

    A round hangs each node's larger neighbours on its least neighbour and then each node itself,
    so paths shrink by half or more; minima are combined before they are joined back.  A round's
    tables are deleted when the next one's are written."""
    now = stored(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        half = _hang(both, "v > u")
        dropped(now)
        now = _hang(half, None)
        dropped(half)
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            return now.selectExpr("u AS node", "v AS root").unionByName(now.selectExpr("v AS node", "v AS root").distinct())
        before = state
    raise RuntimeError("components did not settle")


def _hang(edges: DataFrame, which: str | None) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m")))
    moved = edges.join(least, "u")
    out = (moved.where(which) if which else moved).selectExpr("v AS x", "m")
    if not which:
        out = out.unionByName(least.selectExpr("u AS x", "m"))
    out = stored(out.where("x <> m").selectExpr("greatest(x, m) AS u", "least(x, m) AS v").distinct())
    dropped(least)
    return out


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """df plus its row number (from 0) in the given order: rows are ranged over partitions, whose counts give the first number of each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    at = d.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__first"))
    base, rows = 0, []
    for r in at.orderBy("__p").collect():  # one row per partition
        rows.append((r["__p"], r["__first"], base))
        base += r.n
    first = df.sparkSession.createDataFrame(rows, "__p int, __first long, __base long")
    return d.join(F.broadcast(first), "__p").withColumn(name, F.col("__base") + F.col("__i") - F.col("__first")).select(*df.columns, name)
