"""Shared pieces: written intermediates, distributed ranks, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Where that is unset on a single machine (tests) a temporary
    folder is made and set on the context; on a cluster such a folder would be no shared one, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master or "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vellumite-")
        spark.sparkContext.setCheckpointDir(f"file://{named}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Folders that this process has made; results are read from them lazily, so they stay until release().
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_root(spark)}/vellumite-{uuid.uuid4().hex}")
    return f"{_MADE[-1]}/{name}"


def made() -> list[str]:
    return list(_MADE)


def release(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Deletes these (by default all) intermediates of this process; results not yet written elsewhere are lost."""
    for folder in _MADE[:] if folders is None else folders:
        if folder in _MADE:
            _MADE.remove(folder)
            remove_path(spark, folder)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: short lineage, known size, survives lost executors."""
    return written_at(df, fresh_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As written(), in as many buckets of `key` as there are shuffle partitions: joins on the key then move the other side only.

    After a shuffle on `key` each task already holds whole buckets. The table's entry in the catalog is needed
    to read buckets; it is dropped at once and its files stay.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    entry = f"vellumite_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return out.select(*df.columns)


def give_back() -> None:
    """Memory that is free in this Python process goes back to the machine: workers wait for their next task side by side with the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def distributed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], to: str, weight: Column | None = None) -> DataFrame:
    """Adds `to`: the number of rows (or sum of `weight`) of the same `keys` before this row in (bucket, order).

    A plain window over `keys` would send a hot key to one task. Here each (keys, bucket) is ranked by
    itself and the totals of the buckets before it are added, so a task holds one bucket at most.
    `bucket` must be a function of the row's content, so that a rerun deals rows alike.
    """
    amount = F.lit(1).cast("long") if weight is None else weight.cast("long")
    own = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    sums = own.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = own.withColumn("_within", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(starts, same, "left").withColumn(to, F.col("_start") + F.col("_within")).drop("_bucket", "_amount", "_within", "_b", "_start", *[f"_k{i}" for i in range(len(keys))])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond"). Every step is a minimum per node, combined before the shuffle, and an equi-join that Spark
    may split where a node is hot, and no broadcast, which would gather a column of nodes on the driver; a star with millions of leaves stays as many rows. Each round is
    written to the shared folder and the one before it deleted; the driver sees one row of totals.
    Null ends are no edges. Nodes without an edge to another node are not returned.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "round")
    now = written_at(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null and hi <> lo").distinct(), path)
    if now.isEmpty():
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    totals = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("w"), "m")
        joined = large.join(floor.hint("merge"), F.col("hi") == F.col("w"))
        small = joined.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        after = fresh_path(spark, "round")
        then = written_at(small, after)
        row = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        remove_path(spark, path)
        path, now = after, then
        if tuple(row) == totals:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        totals = tuple(row)
