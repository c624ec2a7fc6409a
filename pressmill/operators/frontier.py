"""The frontier: URLs to fetch, the set of those seen, and logs of a task's URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pressmill.functions.ids import cache_key
from pressmill.session import materialize


def unseen(urls: DataFrame, seen: DataFrame, url: str = "url", method: str = "md5", secret: str | None = None) -> DataFrame:
    """New URLs with their key: each key once (the first by URL order), none that is in ``seen`` (url_key).

    Null URLs are left out. One shuffle on the key serves both the deduplication and the anti join.
    """
    keyed = urls.where(F.col(url).isNotNull()).withColumn("url_key", cache_key(F.col(url), method, secret))
    return keyed.dropDuplicates(["url_key"]).join(seen.select("url_key"), "url_key", "left_anti")


class Frontier:
    """A queue and a seen set as Parquet tables in a folder. Rows are only appended; a drain moves a cursor.

    The cursor is kept in the folder, so a frontier opened again goes on where the last one was. Keys queued by an ``add``
    that did not get as far as marking them are marked when the frontier is opened.
    """

    def __init__(self, spark: SparkSession, path: str, method: str = "md5", secret: str | None = None) -> None:
        self.spark, self.path, self.method, self.secret = spark, path.rstrip("/"), method, secret
        self.cursor = self._read("cursor", self._CURSOR).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        self._mark()

    _SEEN, _QUEUE, _CURSOR = "url_key string", "seq long, url string, url_key string", "seq long"

    def _mark(self) -> None:
        late = self._read("queue", self._QUEUE).select("url_key").join(self.seen(), "url_key", "left_anti").distinct()
        if not late.isEmpty():
            late.write.mode("append").parquet(f"{self.path}/seen")

    def _move(self, seq: int) -> None:
        self.cursor = seq
        self.spark.range(seq, seq + 1, 1, 1).select(F.col("id").alias("seq")).write.mode("append").parquet(f"{self.path}/cursor")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", self._SEEN)

    def queue(self) -> DataFrame:
        return self._read("queue", self._QUEUE).where(F.col("seq") > self.cursor)

    def add(self, urls: DataFrame, url: str = "url") -> int:
        """Queue unseen URLs and mark them as seen; returns how many were new."""
        fresh = unseen(urls.select(F.col(url).alias("url")), self.seen(), "url", self.method, self.secret)
        top = self._read("queue", self._QUEUE).agg(F.max("seq")).first()[0]
        start = -1 if top is None else top
        # ids grow with partition and row: an order without gathering the rows in one place
        rows = fresh.select((F.monotonically_increasing_id() + F.lit(start + 1)).alias("seq"), "url", "url_key")
        rows.write.mode("append").parquet(f"{self.path}/queue")
        new = self._read("queue", self._QUEUE).where(F.col("seq") > start)
        n = new.count()
        new.select("url_key").write.mode("append").parquet(f"{self.path}/seen")
        return n

    def mark_seen(self, urls: DataFrame, url: str = "url") -> None:
        unseen(urls.select(F.col(url).alias("url")), self.seen(), "url", self.method, self.secret).select("url_key").write.mode("append").parquet(f"{self.path}/seen")

    def has(self, url: str) -> bool:
        key = self.spark.range(1).select(cache_key(F.lit(url), self.method, self.secret).alias("url_key"))
        return bool(self.seen().join(F.broadcast(key), "url_key", "left_semi").limit(1).count())

    def drain(self, n: int | None = None) -> DataFrame:
        """The next ``n`` URLs in order, or all; later drains begin after them."""
        waiting = self.queue()
        last = (waiting if n is None else waiting.orderBy("seq").limit(n)).agg(F.max("seq")).first()[0]
        before = self.cursor
        if last is not None:
            self._move(last)
        return self._read("queue", self._QUEUE).where((F.col("seq") > before) & (F.col("seq") <= self.cursor)).orderBy("seq")

    def __len__(self) -> int:
        return self.queue().count()

    def clear(self) -> None:
        for name, schema in (("queue", self._QUEUE), ("seen", self._SEEN), ("cursor", self._CURSOR)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.cursor = -1


def url_log(urls: DataFrame, task: str, order: str) -> DataFrame:
    """A task's URLs with their position ``pos`` from 0 by ``order``; repeated ones are kept, ties in any order.

    A task may hold most of all rows, so none is gathered: rows are sorted over ranges of (task, order), numbered within
    each range, and the numbers of the ranges before are added. Only one count per task and range is put together.
    """
    ranges = urls.repartitionByRange(F.col(task), F.col(order)).sortWithinPartitions(task, order)
    # an id that grows with the rows of a range: its upper bits name the range, the lower 33 count the rows
    numbered = materialize(ranges.withColumn("_id", F.monotonically_increasing_id()), "log")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    each = numbered.groupBy(F.col(task).alias("_task"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    before = Window.partitionBy("_task").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = numbered.withColumn("_part", part).join(offsets.withColumnRenamed("_part", "_part2"), F.col(task).eqNullSafe(F.col("_task")) & (F.col("_part") == F.col("_part2")))
    return joined.select(*urls.columns, (row - F.col("_first") + F.col("_before")).alias("pos"))


def log_slice(log: DataFrame, start: int, limit: int) -> DataFrame:
    return log.where((F.col("pos") >= start) & (F.col("pos") < start + limit))
