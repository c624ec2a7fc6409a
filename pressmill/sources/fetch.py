"""Fetching pages over HTTP from within tasks.

The fetcher is a parameter, so that tests and other transports can take its place.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.sources.settings import Settings


@dataclass(frozen=True)
class Fetched:
    """Final address after redirects, status and body."""

    url: str
    status: int
    body: bytes


Fetcher = Callable[[str, Settings], Fetched]


def http_get(url: str, settings: Settings) -> Fetched:
    request = urllib.request.Request(url, headers={"User-Agent": settings.user_agent})
    with urllib.request.urlopen(request, timeout=settings.fetch_timeout_seconds) as response:
        return Fetched(response.geturl(), response.status, response.read())


def with_retry(url: str, settings: Settings, fetch: Fetcher = http_get, wait: Callable[[float], None] = time.sleep) -> tuple[Fetched | None, str | None, int | None]:
    """(result, error, status): tries again after failures, except after answers of the 4xx kind."""
    error, status = None, None
    for attempt in range(max(1, settings.fetch_retries)):
        try:
            found = fetch(url, settings)
            if found.status < 400:
                return found, None, found.status
            error, status = f"HTTP {found.status}", found.status
        except urllib.error.HTTPError as e:
            error, status = f"HTTP {e.code}", e.code
        except Exception as e:  # whatever a transport raises is a failed page, never a failed task
            error, status = f"{type(e).__name__}: {e}"[:300], None
        if status is not None and 400 <= status < 500:
            break
        if attempt + 1 < settings.fetch_retries:
            wait(settings.fetch_retry_delay_seconds)
    return None, error, status


SCHEMA = "requested_url string, url string, status int, error string, content binary"


def fetch_pages(urls: DataFrame, url: str = "url", settings: Settings | None = None, fetch: Fetcher = http_get) -> DataFrame:
    """One row per URL: requested_url, the final url, status, error and content. Null URLs are left out.

    Each task fetches several pages at a time; a failure is a row with an error. Write the result before using it
    twice, or pages are fetched again.
    """
    settings = settings or Settings.load(urls.sparkSession)

    def one(address: str) -> tuple:
        found, error, status = with_retry(address, settings, fetch)
        return (address, found.url if found else address, status, error, found.body if found else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(settings.fetches_per_task) as pool:
            for batch in batches:
                rows = list(pool.map(one, batch.column(0).to_pylist()))
                types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["requested_url", "url", "status", "error", "content"])

    return urls.where(F.col(url).isNotNull()).select(url).mapInArrow(run, SCHEMA)
