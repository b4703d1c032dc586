"""Streams of events and messages.

Streams read a folder as files arrive and keep their state in the shared checkpoint folder
(spark.checkpoint.dir), so a lost executor or driver goes on where the log ends. Duplicates
are dropped and windows closed by watermarks, so the state is bounded by the time they span.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import checkpoint_dir

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's runs of events without a pause of the gap."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def once_each(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key didn't come within the watermark's time before."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What is there now, run through the stream to a table in the shared folder and read back."""
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _read_text(spark: SparkSession, path: str) -> str | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.sparkContext.wholeTextFiles(path).values().first() if fs.exists(target) else None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hadoop.Path(f"{path}.new"), True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(hadoop.Path(path), False)
    fs.rename(hadoop.Path(f"{path}.new"), hadoop.Path(path))


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that upsert_batches keeps, as its last whole batch left it."""
    held = json.loads(_read_text(spark, f"{path}/current.json") or "{}")
    folders = [f"{path}/v{version}/_b={bucket}" for bucket, version in held.get("buckets", {}).items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, log: str, buckets: int = 64):
    """Starts a stream that keeps in `path` the latest row of each key, batch by batch; read it by current().

    Keys are dealt to buckets by hash, and a batch writes anew only the buckets it touches,
    beside the old, before it names them in the pointer file current.json; so a failed batch
    leaves the table whole, and a batch run again writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = json.loads(_read_text(spark, f"{path}/current.json") or '{"batch": -1, "buckets": {}}')
        if held["batch"] >= number:
            return
        new = batch.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r["_b"] for r in new.select("_b").distinct().collect())  # at most `buckets`
        known = held["buckets"]
        folders = [f"{path}/v{known[str(b)]}/_b={b}" for b in touched if str(b) in known]
        rows = new if not folders else new.unionByName(spark.read.schema(batch.schema).parquet(*folders).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        names = batch.columns
        best = rows.groupBy("_b", key).agg(F.max(F.struct(order, *[c for c in names if c not in (key, order)])).alias("s"))
        best = best.select("_b", *(F.col(key) if c == key else F.col(f"s.{c}") for c in names))
        best.write.mode("overwrite").partitionBy("_b").parquet(f"{path}/v{number}")
        _write_text(spark, f"{path}/current.json", json.dumps({"batch": number, "buckets": known | {str(b): number for b in touched}}))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
