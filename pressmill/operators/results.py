"""Results of scraping tasks: tables with expiry, pages of them, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULT_TTL_DAYS, MAX_PAGE = 7, 50


def with_expiry(rows: DataFrame, ttl_days: float = DEFAULT_TTL_DAYS, now: Column | None = None) -> DataFrame:
    """rows with ``expires_at``; without a positive number of days they never expire."""
    now = now if now is not None else F.current_timestamp()
    seconds = int(ttl_days * 86400) if ttl_days else None
    return rows.withColumn("expires_at", F.lit(None).cast("timestamp") if seconds is None else F.timestamp_seconds(F.unix_micros(now) / F.lit(1e6) + F.lit(seconds)))


def live(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows that have not expired."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > (now if now is not None else F.current_timestamp())))


class ResultStore:
    """Results by task as Parquet, one folder a task, so that reads and deletes touch that task only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, task_id: str, articles: DataFrame, ttl_days: float = DEFAULT_TTL_DAYS, order: str = "id") -> None:
        """Write a task's articles with position, replacing what it had. Positions follow ``order``."""
        from pressmill.operators.frontier import url_log

        numbered = url_log(articles.withColumn("_one", F.lit(0)), "_one", order)
        with_expiry(numbered.drop("_one"), ttl_days).write.mode("overwrite").parquet(f"{self.path}/articles/task_id={task_id}")

    def save_stats(self, task_id: str, stats: DataFrame, ttl_days: float = DEFAULT_TTL_DAYS) -> None:
        with_expiry(stats, ttl_days).write.mode("overwrite").parquet(f"{self.path}/stats/task_id={task_id}")

    def save_failures(self, task_id: str, failed: DataFrame, ttl_days: float = DEFAULT_TTL_DAYS) -> None:
        with_expiry(failed, ttl_days).write.mode("overwrite").parquet(f"{self.path}/failures/task_id={task_id}")

    def failures(self, task_id: str) -> DataFrame | None:
        return self._task("failures", task_id)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def _task(self, kind: str, task_id: str) -> DataFrame | None:
        path = f"{self.path}/{kind}/task_id={task_id}"
        return live(self.spark.read.parquet(path)) if self._exists(path) else None

    def articles(self, task_id: str) -> DataFrame | None:
        """A task's live articles; null for an unknown task."""
        return self._task("articles", task_id)

    def stats(self, task_id: str) -> DataFrame | None:
        return self._task("stats", task_id)

    def article(self, article_id: str) -> DataFrame:
        """An article by id, from whichever task."""
        return live(self.spark.read.parquet(f"{self.path}/articles")).where(F.col("id") == article_id)

    def page(self, task_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
        rows = self.articles(task_id)
        if rows is None:
            raise KeyError(task_id)
        return page(rows, limit, offset)

    def delete(self, task_id: str) -> bool:
        """Remove a task; whether there was one."""
        found = False
        for kind in ("articles", "stats", "failures"):
            path = f"{self.path}/{kind}/task_id={task_id}"
            if self._exists(path):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                found |= p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        return found


def page(rows: DataFrame, limit: int = 20, offset: int = 0, order: str = "pos") -> DataFrame:
    """One page of rows with a position, selected by range, so nothing is sorted to skip rows."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE} and offset not negative")
    return rows.where((F.col(order) >= offset) & (F.col(order) < offset + limit)).orderBy(order)


def next_offset(total: int, limit: int, offset: int) -> int | None:
    return offset + limit if offset + limit < total else None


def compact(articles: DataFrame) -> DataFrame:
    """Short rows of articles as listed on result pages."""
    return articles.select("id", "title", "source_url", "domain", "word_count", F.lit("markdown").alias("format"))


def task_stats(outcomes: DataFrame, task: str = "task_id") -> DataFrame:
    """Per task: total_urls, success_count and fail_count.

    outcomes has the task, url, ok, error and status. Every URL counts as one of the two outcomes; a null ``ok`` is a
    failure. The failed URLs are the rows of ``failures``: a task's list of them has no bound.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return outcomes.groupBy(task).agg(F.count(F.lit(1)).alias("total_urls"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("fail_count"))


def failures(outcomes: DataFrame, task: str = "task_id") -> DataFrame:
    """One row per failed URL: the task, url, error and status."""
    return outcomes.where(~F.coalesce(F.col("ok"), F.lit(False))).select(task, "url", "error", "status")
