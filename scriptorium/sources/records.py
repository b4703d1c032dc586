"""Folders of JSON records, and tables written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import cut

POST = "url string, text string, likes int, comments int, date_posted string, user_id string, content_type string"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def json_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One record a file; unreadable files give no row, a missing folder no rows."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    return rows.where("_bad is null").drop("_bad")


def load_posts(spark: SparkSession, filtered: str, raw: str) -> DataFrame:
    """Filtered posts where there is such a folder, else raw ones, by date, missing dates first."""
    rows = json_records(spark, filtered if _exists(spark, filtered) else raw, POST)
    return rows.orderBy(F.coalesce("date_posted", F.lit("")), "url")


def numbered(df: DataFrame, by: str, prefix: str) -> DataFrame:
    """Adds record_name, prefix_001 and on, in the order of a column.

    Numbers come from counts of ranges of that order, so no task sees all rows.
    """
    spread_ = cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = spread_.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("first"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "first", "before")
    place = F.col("before") + F.col("_m") - F.col("first") + 1
    return spread_.join(F.broadcast(before), "_p").select(*df.columns, F.format_string(f"{prefix}_%03d", place).alias("record_name"))


def save_posts(df: DataFrame, path: str, by: str = "url", held: float = 0.0) -> None:
    """Posts numbered by name, those held out (a share by hash of `by`) beside the others in their own partition."""
    share = F.pmod(F.xxhash64(by, F.lit(42)), F.lit(10_000)) < int(held * 10_000)
    numbered(df, by, "linkedin_post").withColumn("held", share).write.mode("overwrite").partitionBy("held").parquet(path)


def save_profile(posts: DataFrame, profile: DataFrame, path: str) -> None:
    """Posts and the profile they come from with their totals, in a folder each."""
    posts.write.mode("overwrite").parquet(f"{path}/posts")
    totals = posts.agg(F.count("*").alias("posts"), F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"))
    profile.join(totals, F.lit(True)).write.mode("overwrite").parquet(f"{path}/profile")


def save_state(state: DataFrame, path: str) -> None:
    """Water marks as a table; written whole each time."""
    state.coalesce(1).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """Water marks, or a row of defaults where none were saved."""
    schema = "total_fetched bigint, newest bigint, oldest bigint"
    if not _exists(spark, path):
        return spark.createDataFrame([(0, None, None)], schema)
    return spark.read.schema(schema).json(path)
