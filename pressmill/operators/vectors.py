"""Embedding storage and similarity search."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pressmill.session import files_of, remove

METRICS = ("cosine", "dot_product", "euclidean")
#: Query vectors held and broadcast at a time; more are searched in several passes.
QUERY_SET = 20_000
#: Query vectors scored at once within a task.
QUERY_BLOCK = 256
COUNT_BOUND = 10_000


class Embedder(Protocol):
    """Turns texts into vectors of ``dimension`` numbers."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic embeddings without a model: words and letter trigrams hashed into a unit vector."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def _word(self, word: str) -> tuple[list[int], list[float]]:
        """Places and signs of a word and its letter trigrams."""
        at, sign = [], []
        for part in (word, *(word[i : i + 3] for i in range(max(0, len(word) - 2)))):
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
            at.append(h % self.dimension)
            sign.append(1.0 if h >> 63 else -1.0)
        return at, sign

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        known: dict[str, tuple[list[int], list[float]]] = {}
        for row, text in zip(out, texts):
            at: list[int] = []
            sign: list[float] = []
            for word in (text or "").replace("\n", " ").lower().split():
                found = known.get(word)
                if found is None:
                    found = known[word] = self._word(word)
                at += found[0]
                sign += found[1]
            if at:
                row += np.bincount(at, weights=sign, minlength=self.dimension)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)


def embed_column(embedder: Embedder):
    """A vectorised column function of an embedder; null texts give null."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        made = embedder.embed([t if isinstance(t, str) else "" for t in texts])
        return pd.Series([v.astype(np.float32).tolist() if isinstance(t, str) else None for t, v in zip(texts, made)])

    return embed


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Similarity of two vectors, greater is nearer; unknown metrics count as cosine. Null where lengths differ."""
    if metric == "dot_product":
        value = _dot(a, b)
    elif metric == "euclidean":
        square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        value = F.lit(1.0) / (F.lit(1.0) + square)
    else:
        norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
        value = F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value)


def search(vectors: DataFrame, query: list[float], limit: int = 5, metric: str = "cosine", key: str = "vec_id", column: str = "embedding", fields: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` nearest rows: key, score and fields. Null vectors and those of other lengths are left out; ties go by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(key, *fields, score(F.col(column), q, metric).alias("score")).where("score is not null")
    return rows.orderBy(F.desc("score"), key).limit(limit)


def batch_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, metric: str = "cosine", key: str = "vec_id", column: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the nearest rows for each of a stated set of query vectors.

    Queries are dealt by hash into passes of about ``QUERY_SET``; a pass holds its queries in every task and scans the
    vectors once. Each task keeps only its best rows per query, so what is shuffled is (tasks x queries x limit) rows,
    whatever the number of vectors.
    """
    queries = queries.where(F.col(column).isNotNull()).select(key, column)
    passes = max(1, -(-queries.count() // QUERY_SET))
    nearest = None
    for k in range(passes):
        part = _pass(vectors, queries.where(F.pmod(F.xxhash64(key), F.lit(passes)) == k), limit, metric, key, column, exclude_self)
        nearest = part if nearest is None else nearest.unionByName(part)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return nearest.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)


def _pass(vectors: DataFrame, queries: DataFrame, limit: int, metric: str, key: str, column: str, exclude_self: bool) -> DataFrame:
    """Candidates of one pass: the best rows of every task for every query."""
    collected = queries.toPandas()
    names = collected[key].to_numpy(np.int64)
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    if not len(names):
        return spark.createDataFrame([], schema)
    size = max(map(len, collected[column]))
    good = [len(v) == size for v in collected[column]]
    matrix = np.array(collected[column][good].tolist(), np.float64).reshape(-1, size)
    shared = spark.sparkContext.broadcast((names[good], matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            usable = batch[batch[column].notna()]
            usable = usable[[len(v) == q.shape[1] for v in usable[column]]]
            if not len(usable):
                continue
            v, own = np.array(usable[column].tolist(), np.float64), usable[key].to_numpy(np.int64)
            for start in range(0, len(ids), QUERY_BLOCK):
                s = _scores(q[start : start + QUERY_BLOCK], v, metric)
                if exclude_self:
                    s[ids[start : start + QUERY_BLOCK, None] == own[None, :]] = -np.inf
                for i, row in enumerate(s, start):
                    old_s, old_k = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                    all_s, all_k = np.concatenate((old_s, row)), np.concatenate((old_k, own))
                    top = np.lexsort((all_k, -all_s))[:limit]
                    top = top[all_s[top] > -np.inf]
                    best[i] = (all_s[top], all_k[top])
        for i, (s, k) in best.items():
            yield pd.DataFrame({"query_id": np.full(len(s), ids[i]), "vec_id": k, "score": s})

    return vectors.select(key, column).mapInPandas(run, schema)


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    # sums run over the components in order, as the column expression's do
    dot = np.zeros((len(q), len(v)))
    for k in range(q.shape[1]):
        if metric == "euclidean":
            dot += (v[None, :, k] - q[:, None, k]) ** 2
        else:
            dot += v[None, :, k] * q[:, None, k]
    if metric == "euclidean":
        return 1.0 / (1.0 + dot)
    if metric == "dot_product":
        return dot
    norm = np.sqrt(np.cumsum(v * v, 1)[:, -1])[None, :] * np.sqrt(np.cumsum(q * q, 1)[:, -1])[:, None]
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1.0), 0.0)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the newest by ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


class VectorStore:
    """A collection of vectors in a folder: immutable Parquet parts, of which the newest row of an id counts.

    Writes append a part; deletes append tombstones; ``compact`` rewrites the live rows as one part. A part's name tells
    its version, so the collection is opened again from its folder; parts without a mark of completion do not count.
    """

    _NAME = re.compile(r"/(part|compact)-(\d{6})-[0-9a-f]+/_SUCCESS$")

    SCHEMA = "_id string, text string, vector array<float>, title string, source_url string, domain string, version long, gone boolean"

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str = "cosine", embedder: Embedder | None = None) -> None:
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        self.metric = metric if metric in METRICS else "cosine"
        self.embedder = embedder or HashingEmbedder(dimension)
        if self.embedder.dimension != dimension:
            raise ValueError("the embedder has another dimension")
        self._parts = self._found()

    def _found(self) -> list[str]:
        done = sorted((int(m[2]), m[1] == "compact", f.removesuffix("/_SUCCESS")) for f in files_of(self.spark, self.path, done=True) if (m := self._NAME.search(f)))
        since = max((n for n, compact, _ in done if compact), default=-1)
        return [f for n, compact, f in done if n > since or (n == since and compact)]

    def _next(self) -> int:
        return 1 + max((int(re.search(r"/(?:part|compact)-(\d{6})-", p)[1]) for p in self._parts), default=-1)

    def _append(self, rows: DataFrame, gone: bool) -> None:
        version = self._next()
        path = f"{self.path}/part-{version:06d}-{uuid.uuid4().hex}"
        rows.withColumn("version", F.lit(version).cast("long")).withColumn("gone", F.lit(gone)).select(*[f.split()[0] for f in self.SCHEMA.split(", ")]).write.parquet(path)
        self._parts.append(path)

    def rows(self) -> DataFrame:
        """Live rows. A collection of one part is read as it is; of several, the newest row of each id is found by its id."""
        if not self._parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        stored = self.spark.read.schema(self.SCHEMA).parquet(*self._parts)
        return (stored if len(self._parts) == 1 else latest(stored, "_id", "version")).where(~F.col("gone"))

    def upsert(self, documents: DataFrame) -> dict:
        """Documents (id, text, meta with title, source_url, domain) by id; of equal ids one row is kept."""
        rows = documents.dropDuplicates(["id"]).select(F.col("id").alias("_id"), "text", embed_column(self.embedder)(F.col("text")).alias("vector"), "meta.title", "meta.source_url", "meta.domain")
        self._append(rows, False)
        n = self.spark.read.parquet(self._parts[-1]).count()
        return {"status": "ok" if n else "noop", "count": n}

    def search(self, query: str | list[float], limit: int = 5, fields: tuple[str, ...] = ("text", "title", "source_url", "domain")) -> DataFrame:
        vector = self.embedder.embed([query])[0].tolist() if isinstance(query, str) else query
        if len(vector) != self.dimension:
            raise ValueError("the query has another dimension")
        return search(self.rows(), vector, limit, self.metric, "_id", "vector", fields)

    def get(self, key: str) -> DataFrame:
        return self.rows().where(F.col("_id") == key)

    def count(self, bound: int = COUNT_BOUND) -> int:
        """Number of rows, counted up to ``bound``."""
        return self.rows().select("_id").limit(bound).count()

    def delete(self, keys: list[str]) -> int:
        """Remove ids; how many there were."""
        if not keys:
            return 0
        wanted = self.spark.createDataFrame([(k,) for k in set(keys)], "_id string")
        found = self.rows().join(F.broadcast(wanted), "_id", "left_semi")
        n = found.count()
        if n:
            self._append(found, True)
        return n

    def remove_rows(self, keys: DataFrame) -> None:
        """Remove the ids (_id) of a table of any size."""
        self._append(self.rows().join(keys.select("_id").distinct(), "_id", "left_semi"), True)

    def clear(self) -> None:
        """Remove all rows, for good."""
        remove(self.spark, self.path)
        self._parts = []

    def compact(self) -> None:
        """Rewrite the live rows as one part; the parts before it are removed afterwards."""
        version, old = self._next(), self._parts
        path = f"{self.path}/compact-{version:06d}-{uuid.uuid4().hex}"
        self.rows().withColumn("version", F.lit(version).cast("long")).write.parquet(path)
        self._parts = [path]
        for part in old:
            remove(self.spark, part)


def dispatch(store: VectorStore, request: dict, documents: DataFrame | None = None) -> DataFrame | dict:
    """A request ``{"operation": "upsert"}`` with documents, or ``{"operation": "search", "query": ..., "limit": ..., "fields": ...}``."""
    if request.get("operation") == "upsert" and documents is not None:
        return store.upsert(documents)
    if request.get("operation") == "search":
        return store.search(request["query"], int(request.get("limit", 5)), tuple(request.get("fields") or ("text", "title", "source_url", "domain")))
    raise ValueError("unknown operation")
