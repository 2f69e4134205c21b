"""The feedback log and deliveries as streams: the batch operators, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.times import instant
from lorekeep.operators.delivery import merge_latest, normal_id

EVENT = "ts string, event string, query string, hits array<string>, id string, path string"


def event_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Events of JSON-line files as they appear, with their instant ``at``; rows without a readable time can't be placed
    in a window and don't come out (the batch operators keep them)."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(path)
    return rows.withColumn("at", instant(F.col("ts"))).where("at is not null")


def recalls(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``window, id, recalls`` of tumbling windows: 1 for a hit, 2 for a read; events later than ``late`` are dropped."""
    weighted = F.when(F.col("event") == "search", F.transform("hits", lambda h: F.struct(h.alias("id"), F.lit(1).alias("w")))).when(F.col("event") == "read", F.array(F.struct(F.col("id").alias("id"), F.lit(2).alias("w"))))
    each = events.withWatermark("at", late).select("at", F.explode(weighted).alias("x")).where("x.id is not null and x.id <> ''")
    return each.groupBy(F.window("at", window), F.col("x.id").alias("id")).agg(F.sum("x.w").alias("recalls"))


def once(deliveries: DataFrame, late: str = "7 days") -> DataFrame:
    """The first delivery of each session within the watermark on its time ``at``; state is dropped behind it."""
    keyed = deliveries.withColumn("session_id", normal_id(F.col("sessionId"))).where("session_id is not null")
    return keyed.withWatermark("at", late).dropDuplicatesWithinWatermark(["session_id"])


#: Parts of the store, by a hash of the session; a batch rewrites only those it touches.
PARTS = 64


def _pointers(spark: SparkSession, store: str) -> list[tuple[int, str]]:
    """Numbers and paths of the store's pointer files, by number."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/pointers")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    folders = [f.getPath() for f in fs.listStatus(path)]
    whole = [f.getName() for f in folders if f.getName().isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted((int(n), f"{store}/pointers/{n}") for n in whole)


def _state(spark: SparkSession, store: str, before: int | None = None) -> dict[int, str]:
    """The folder of each part of the store, as of the last batch (below ``before``). Only a store that isn't there is empty;
    one that can't be read fails."""
    own = [p for n, p in _pointers(spark, store) if before is None or n < before]
    if not own:
        return {}
    return {r["part"]: r["folder"] for r in spark.read.schema("part int, folder string").option("mode", "FAILFAST").json(own[-1]).collect()}  # at most PARTS rows


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The latest deliveries that :func:`keep_latest` holds; None before its first batch."""
    folders = sorted(set(_state(spark, store).values()))
    return spark.read.parquet(*folders) if folders else None


def keep_latest(deliveries: DataFrame, store: str, checkpoint: str):
    """Every batch merged into a store of the latest deliveries, by parts; a batch that runs again changes nothing.

    A batch reads and writes only the parts its sessions fall in, each into a folder of its own, and names the store's
    folders in a pointer file of its number last of all. What a lost batch left is never read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(normal_id(F.col("sessionId"))), F.lit(PARTS)).cast("int")
        batch = batch.withColumn("__part", part).where(normal_id(F.col("sessionId")).isNotNull()).persist()
        try:
            state = _state(spark, store, number)
            touched = [r[0] for r in batch.select("__part").distinct().collect()]  # at most PARTS
            held = [state[k] for k in touched if k in state]
            rows = batch.drop("__part")
            merged = merge_latest(spark.read.parquet(*held) if held else rows.limit(0), rows)
            own = F.pmod(F.xxhash64("session_id"), F.lit(PARTS)).cast("int")
            if touched:
                merged.withColumn("__part", own).repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{store}/batch-{number}")
            state |= {k: f"{store}/batch-{number}/__part={k}" for k in touched}
            spark.createDataFrame(sorted(state.items()), "part int, folder string").coalesce(1).write.mode("overwrite").json(f"{store}/pointers/{number}")
        finally:
            batch.unpersist()

    return deliveries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
