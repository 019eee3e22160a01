"""Embedding of contents by a given model, with retries; failures go to a dead-letter table instead of failing the job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import Settings, retry_delay
from millrace.functions import vector
from millrace.functions.text import WORD, is_blank


class Embedder(Protocol):
    """Anything that turns texts into vectors; it is sent to the tasks, so connections are opened on first use there."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Answerer(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Signed counts of hashed words, scaled to unit length. A deterministic stand-in for tests, not a model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in WORD.findall(text.lower()):
                h = xxhash.xxh3_64_intdigest(word)
                row[h % self.dim] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1.0
        return out.tolist()


def _tried(embedder: Embedder, texts: list[str], settings: Settings, sleep: Callable[[float], None]) -> tuple[list[Sequence[float] | None], list[str | None], int]:
    """Vectors (None where it failed), errors, and tries. A batch that keeps failing is tried text by text."""
    error = ""
    for attempt in range(settings.embed_tries):
        try:
            return list(embedder(texts)), [None] * len(texts), attempt + 1
        except Exception as e:  # noqa: BLE001 - the model's failures are data here
            error = f"{type(e).__name__}: {e}"[:500]
            if attempt + 1 < settings.embed_tries:
                sleep(retry_delay(attempt, settings.retry_seconds))
    if len(texts) == 1:
        return [None], [error], settings.embed_tries
    parts = [_tried(embedder, [t], settings, sleep) for t in texts]
    return [p[0][0] for p in parts], [p[1][0] for p in parts], settings.embed_tries


def embedded(records: DataFrame, embedder: Embedder, settings: Settings = Settings(), content: str = "content", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """records with the columns embedding array<float> (null if it failed), embed_error and embed_state.

    Null and blank contents are dropped first. embed_state is that of vector.state, so 'ok' only for vectors of the right width,
    without NaN and not all zero. Batches of settings.embed_batch texts; a task that is lost embeds its rows again.
    """
    rows = records.where(F.col(content).isNotNull() & ~is_blank(F.col(content)))
    schema = "embedding array<float>, embed_error string"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            vectors, errors = [], []
            for at in range(0, len(s), settings.embed_batch):
                v, e, _ = _tried(embedder, s.iloc[at : at + settings.embed_batch].tolist(), settings, sleep)
                vectors += v
                errors += e
            yield pd.DataFrame({"embedding": pd.Series([None if v is None else [float(x) for x in v] for v in vectors], dtype=object), "embed_error": pd.Series(errors, dtype=object)})

    out = rows.withColumn("_embedded", run.asNondeterministic()(F.col(content)))
    out = out.select(*(c for c in rows.columns if c not in ("embedding", "embed_error", "embed_state")), "_embedded.embedding", "_embedded.embed_error")
    return out.withColumn("embed_state", vector.state(F.col("embedding"), settings.dim))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to store, and dead letters with their reason."""
    good = rows.where("embed_state = 'ok'").drop("embed_error", "embed_state")
    dead = rows.where("embed_state <> 'ok'").withColumn("reason", F.coalesce("embed_error", "embed_state")).drop("embed_error", "embed_state", "embedding")
    return good, dead
