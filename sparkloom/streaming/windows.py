"""Structured Streaming refresh: windows, late data, de-duplication, upserts, deltas and spin detection.

Each function takes a streaming (or batch) DataFrame of events and returns one; ``drain`` runs a stream over what is
there now and gives the sink's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkloom.runtime import Scratch

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, its times as instants."""
    files = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The rows that the stream appends until what is there is used up, as a staged table."""
    spark = stream.sparkSession
    scratch = Scratch(spark, name)
    out = f"{scratch.path}/out"
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{scratch.path}/state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    """(start, event_type, n, total) for each window, once the watermark passes it."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def spin(events: DataFrame, size: str, step: str, least: int, late: str) -> DataFrame:
    """(start, user_id, n): keys with ``least`` events or more in a sliding window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "user_id").agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "user_id", "n")


def bursts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, start, end, n): events debounced to sessions by a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert(stream: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The latest row of each key: every batch is merged with the table so far and written anew beside it."""
    spark = stream.sparkSession
    scratch = Scratch(spark, name)
    tables: list[DataFrame] = []

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch if not tables else tables[-1].unionByName(batch)
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(order)).alias("r")).select("r.*")
        tables.append(scratch.stage(latest))
        if len(tables) > 2:  # a batch that runs again reads the table before
            scratch.drop(tables.pop(0))

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{scratch.path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return tables[-1] if tables else spark.createDataFrame([], stream.schema)


def delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): keys that came, went or changed between two states."""
    b, a = before.select(key, F.col(value).alias("b")), after.select(key, F.col(value).alias("a"))
    both = b.join(a, key, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("updated").alias("change"))
