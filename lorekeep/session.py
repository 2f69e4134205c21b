"""Session settings, table access and the shared folder for cutting lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorekeep")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, unless they find it on their own path."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    on_path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    near = context.master.startswith("local[") and Path.cwd() == root
    if context.applicationId in _shipped or root in on_path or near:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lorekeep-"), "lorekeep"), "zip", root, "lorekeep")
    context.addPyFile(archive)  # served by the driver to every executor
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder set; only a local session that names
    none gets one of this machine, a cluster's is refused, since its executors couldn't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        set_dir = context._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lorekeep-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write a result used more than once to the shared folder; it outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_files: list[str] = []


def drop_written(spark: SparkSession) -> None:
    """Delete the tables :func:`written` left in the shared folder; what still reads them can't be used any more."""
    jvm = spark.sparkContext._jvm
    while _files:
        path = jvm.org.apache.hadoop.fs.Path(_files.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """As :func:`cut`, in compressed columns, for tables of which later steps read only some columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: list, number: str) -> DataFrame:
    """Row numbers from 1 in each group, without a task that sees a whole group.

    Rows are sorted into ranges, numbered in each, and the ranges' counts are added up. ``order`` are columns or sort
    expressions that tell any two rows of a group apart; null groups are one.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    keys = {f"__o{i}": o for i, o in enumerate(order)}
    ranged = df.withColumn("__g", F.col(group)).repartitionByRange("__g", *order)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()))
    local = ranged.withColumn(number, F.row_number().over(Window.partitionBy("__part", "__g").orderBy(*keys.values())))
    counts = ranged.groupBy("__g", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("__g").alias("__h"), F.col("__part").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = local.join(base, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__q")))
    return joined.withColumn(number, (F.col(number) + F.col("__base")).cast("int")).drop("__g", "__h", "__part", "__q", "__base")
