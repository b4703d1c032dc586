"""Reading the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.session import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Bytes of input that may be dealt anew.
DEALT = 4 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to at least one partition per core where a small file made fewer.

    The number of input splits and their bytes are read from the plan without running it.
    Tables of many splits or more than DEALT bytes keep theirs, so nothing is shuffled at scale.
    """
    ship(df.sparkSession)
    want = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(want) if size <= DEALT and df.rdd.getNumPartitions() < max(2, want // 2) else df
