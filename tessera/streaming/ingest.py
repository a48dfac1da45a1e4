"""A file stream that upserts into a Parquet table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.joins import upsert


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str]):
    """Starts a query that upserts each micro-batch into ``target`` (versions ``target/v=<batch>``) and stops when the input is used up.

    Each batch writes a whole new version, so a batch that is run again after a failure writes the same version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if number:
            new = upsert(spark.read.parquet(f"{target}/v={number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """The table after the last batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.read.parquet(f"{target}/v={max(int(n[2:]) for n in names if n.startswith('v='))}")
