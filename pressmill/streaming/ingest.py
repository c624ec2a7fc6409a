"""Streams of pages: each page once, against all pages seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pressmill.functions.ids import cache_key


def page_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Pages of a folder of Parquet files, read as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_to_table(stream: DataFrame, out: str, seen: str, checkpoint: str, url: str = "url") -> StreamingQuery:
    """Append each page whose URL is new to ``out`` and its key to ``seen``.

    The set of seen keys is a table, not operator state, so it may grow without bound; batches are joined with it by
    shuffle. A batch that is run again finds its own number in ``out`` and leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.where(F.col(url).isNotNull()).withColumn("url_key", cache_key(F.col(url))).dropDuplicates(["url_key"])
        known = _read(spark, seen, "url_key string, batch_no long").where(F.col("batch_no") != number)
        fresh = keyed.join(known.select("url_key"), "url_key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch_no={number}")
        spark.read.parquet(f"{out}/batch_no={number}").select("url_key").write.mode("overwrite").parquet(f"{seen}/batch_no={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def dedup_within(stream: DataFrame, time: str, url: str = "url", horizon: str = "7 days") -> DataFrame:
    """Each URL once within a horizon of event time; state older than that is dropped."""
    return stream.withWatermark(time, horizon).withColumn("url_key", cache_key(F.col(url))).dropDuplicatesWithinWatermark(["url_key"])


def crawl_counts(stream: DataFrame, time: str, window: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Pages per domain and window of event time, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "domain").agg(F.count(F.lit(1)).alias("pages"))
