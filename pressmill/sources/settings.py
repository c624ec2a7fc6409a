"""Settings of a deployment, from the session's configuration or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """``spark.pressmill.<name>`` in the session, else ``PRESSMILL_<NAME>`` in the environment, else the default."""

    embedding_provider: str = "hashing"
    embedding_dimension: int = 64
    vector_metric: str = "cosine"
    user_agent: str = "pressmill"
    fetch_timeout_seconds: float = 15.0
    fetch_retries: int = 3
    fetch_retry_delay_seconds: float = 2.0
    fetches_per_task: int = 8
    result_ttl_days: float = 7.0
    follow_urls_max: int = 25
    chunk_tokens: int = 512
    chunk_overlap_tokens: int = 50

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        found = {}
        for f in fields(cls):
            text = spark.conf.get(f"spark.pressmill.{f.name}", None) if spark else None
            text = text if text is not None else os.environ.get(f"PRESSMILL_{f.name.upper()}")
            if text is not None:
                found[f.name] = type(f.default)(text)
        return cls(**found)
