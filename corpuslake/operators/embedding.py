"""A resumable embedding pass over chunks without a vector.

The model is a plug-in: anything with `name`, `dimensions`, `window` and encode(texts).
Vectors travel with the name of their model. Running again embeds only what is missing.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_INPUTS, MAX_TOKENS = 64, 100_000
ATTEMPTS, BASE_SECONDS = 5, 1.0
#: Statuses that are worth another try (fixed values).
RETRYABLE = frozenset({408, 409, 429, 500, 502, 503, 504})
#: What models of one family expect before a question (fixed value).
QUERY_PREFIX = ("bge", "Represent this sentence for searching relevant passages: ")
#: Hosted models, and their price for a million tokens (fixed values).
HOSTED = {"text-embedding-3-small": 0.02}


class EmbeddingFailed(RuntimeError):
    """A batch could not be embedded."""


class Embedder(Protocol):
    name: str
    dimensions: int
    window: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in: signed word hashes, normalised. It has no notion of meaning."""

    def __init__(self, dimensions: int = 384, window: int = 512):
        self.name, self.dimensions, self.window = f"hash-{dimensions}", dimensions, window

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            size = np.linalg.norm(v)
            out.append((v / size if size else v).tolist())
        return out


def query_text(model: str, question: str) -> str:
    return (QUERY_PREFIX[1] if QUERY_PREFIX[0] in model.lower() else "") + question


def cost(model: str, tokens: int) -> float | None:
    return tokens / 1e6 * HOSTED[model] if model in HOSTED else None


def plan_batches(sizes: list[int], max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """Ranges of consecutive inputs, each of at most so many inputs and tokens; an oversize input goes alone."""
    ranges, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == max_inputs or held + n > max_tokens):
            ranges.append((start, i))
            start, held = i, 0
        held += n
    return ranges + [(start, len(sizes))] * (len(sizes) > start)


def batches(rows: DataFrame, by: list[str], order: str, tokens: str, max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """by, order, tokens, batch: each group's rows in order, cut greedily by plan_batches().

    Rows that share a place go by their tokens. The running state resets where a batch fills, which no window frame says; so groups
    are sorted inside partitions and read as a stream, without holding a group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*by, order, tokens]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, batch, n, held = None, 0, 0, 0
        for b in stream:
            out = []
            for *key, size in zip(*(b.column(c).to_pylist() for c in [*by, tokens])):
                size = size or 0
                if key != group:
                    group, batch, n, held = key, 0, 0, 0
                elif n == max_inputs or held + size > max_tokens:
                    batch, n, held = batch + 1, 0, 0
                n, held = n + 1, held + size
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int64())], names=[*names, "batch"])

    sorted_ = rows.select(*names).repartition(parts, *by).sortWithinPartitions(*by, order, tokens)
    return sorted_.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", batch long")


def is_retryable(error: Exception) -> bool:
    status = getattr(error, "status_code", None)
    return status in RETRYABLE if status is not None else isinstance(error, (ConnectionError, TimeoutError))


def with_retry(call: Callable[[], list], attempts: int = ATTEMPTS, sleep=time.sleep, jitter=random.random, pause: float = BASE_SECONDS) -> list:
    """call(), again after a growing pause while its error is a passing one."""
    for n in range(attempts):
        try:
            return call()
        except Exception as error:
            if n + 1 == attempts or not is_retryable(error):
                raise EmbeddingFailed(str(error)) from error
            sleep(pause * 2**n * (0.5 + jitter()))
    raise AssertionError


def cost_column(model: Column, tokens: Column) -> Column:
    """The price of so many tokens; null for a model that has none."""
    prices = F.create_map(*[F.lit(x) for pair in HOSTED.items() for x in pair])
    return tokens / 1e6 * prices[model]


def embed(pending: DataFrame, embedder: Embedder, key: str = "id", text: str = "content", tokens: str = "token_count", pause: float = BASE_SECONDS) -> DataFrame:
    """key, embedding, embedding_model of pending chunks; a wrong count or size of vectors is an error."""
    kind = pending.schema[key].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            texts, sizes = b.column(text).to_pylist(), [n or 0 for n in b.column(tokens).to_pylist()]
            found: list[list[float]] = []
            for start, end in plan_batches(sizes):
                part = with_retry(lambda s=start, e=end: embedder.encode([t or "" for t in texts[s:e]]), pause=pause)
                if len(part) != end - start or any(len(v) != embedder.dimensions for v in part):
                    raise EmbeddingFailed("the model gave other vectors than were asked for")
                found += part
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(found, pa.list_(pa.float32())), pa.array([embedder.name] * len(found), pa.string())], names=[key, "embedding", "embedding_model"]
            )

    return pending.select(key, text, tokens).mapInArrow(run, f"{key} {kind}, embedding array<float>, embedding_model string")


def write_embeddings(chunks: DataFrame, new: DataFrame, dimensions: int, keys: list[str]) -> DataFrame:
    """chunks with the new vectors; refuses vectors of another size."""
    right = new.select(*keys, F.col("embedding").alias("__v"), F.col("embedding_model").alias("__m"))
    size = F.when(F.col("__v").isNotNull() & (F.size("__v") != dimensions), F.raise_error(F.lit("a vector of another size")))
    joined = chunks.join(right, keys, "left")
    vector = F.coalesce(size.cast("array<float>"), F.col("__v"), F.col("embedding"))
    model = F.when(F.col("__v").isNotNull(), F.col("__m")).otherwise(F.col("embedding_model"))
    changed = {"embedding": vector, "embedding_model": model}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in chunks.columns])


def over_window(tokens: str, window: int):
    """Aggregate: inputs that are longer than the model reads."""
    return F.count_if(F.col(tokens) > window)


def report(chunks: DataFrame, by: list[str], window: int) -> DataFrame:
    pending = F.col("embedding").isNull()
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.count_if(~pending).alias("embedded"),
        F.coalesce(F.sum(F.when(pending, F.col("token_count"))), F.lit(0)).alias("pending_tokens"), over_window("token_count", window).alias("over_window"),
    )


def oldest(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group: a bounded work list."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
