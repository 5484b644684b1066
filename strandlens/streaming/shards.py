"""Streams of arriving shards: counts that go on where they stopped, and first-seen dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def add_counts(path: str, keys: list[str], parameter_hash: str):
    """A foreachBatch function that adds each batch's counts, under the batch's number, so that a repeated batch writes the
    same folder again. Refuses a folder that other parameters made."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        context = spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        # a folder that is there but can't be read is an error
        known = spark.read.parquet(path).select("parameters").first() if folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder) else None
        if known and known[0] != parameter_hash:
            raise ValueError("the counts were made with other parameters")
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("parameters", F.lit(parameter_hash))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


def count_shards(spark: SparkSession, source: str, schema, path: str, checkpoint: str, keys: list[str], parameter_hash: str, prepare=lambda x: x) -> DataFrame:
    """Counts all shard files that have arrived and returns the totals so far; a later call adds only new files."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = prepare(stream).writeStream.foreachBatch(add_counts(path, keys, parameter_hash)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return totals(spark, path, keys)


def first_seen(spark: SparkSession, source: str, schema, path: str, checkpoint: str, key: str) -> DataFrame:
    """Rows of arriving shards whose key has not been seen. There is no watermark: the state keeps every key."""
    stream = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)
