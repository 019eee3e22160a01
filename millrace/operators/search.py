"""Similarity search: exact scans with threshold and top-k, content lookup, context and prompt."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vector
from millrace.operators.embed import Answerer
from millrace.session import scratch_path

#: Queries that one pass over all vectors answers (a broadcast of some 30 MB at a width of 64), and those compared at a time.
SLICE, BLOCK = 65_536, 4096


def _literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def _usable(v: Column, width: int) -> Column:
    return v.isNotNull() & (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def scored(docs: DataFrame, query: Sequence[float], id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, cosine_similarity), rounded to 6 digits, of all usable vectors. One pass, no shuffle."""
    rows = docs.where(_usable(F.col(embedding), len(query))).select(F.col(id).alias("id"), F.col(embedding).alias("e"))
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    unit = _literal([float(x) / size for x in query] if size else query)  # the question is brought to unit length once, not per row
    score = F.try_divide(vector.dot(F.col("e"), unit), vector.norm(F.col("e"))) if size else F.lit(None).cast("double")
    return rows.select("id", F.round(score, 6).alias("cosine_similarity"))


def top_k(docs: DataFrame, query: Sequence[float], k: int = 25, threshold: float = 0.3, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, cosine_similarity): the k best of at least the threshold, by similarity and id descending.

    Null, empty, zero and NaN vectors and those of another width are never hits. Spark keeps k rows per task
    (TakeOrderedAndProject); nothing else is shuffled. An empty table gives an empty result.
    """
    hits = scored(docs, query, id, embedding).where(vector.at_least(F.col("cosine_similarity"), threshold))
    return hits.orderBy(F.desc("cosine_similarity"), F.desc("id")).limit(k)


def nearest_euclidean(docs: DataFrame, query: Sequence[float], k: int = 25, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, distance): the k nearest by Euclidean distance and id."""
    rows = docs.where(_usable(F.col(embedding), len(query)))
    return rows.select(F.col(id).alias("id"), F.round(vector.euclidean(F.col(embedding), _literal(query)), 6).alias("distance")).orderBy("distance", "id").limit(k)


def batch_top_k(docs: DataFrame, queries: DataFrame, k: int, width: int, threshold: float = -1.0, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id, cosine_similarity): the k best other rows of each query row (query_id, embedding).

    Queries go out in slices of at most SLICE vectors, one pass over all vectors each; every task multiplies its blocks of vectors with
    blocks of the slice and keeps k rows a query, so that the shuffle carries k rows per query and task whatever the number of
    vectors. Similarities are rounded to 6 digits; ties rank by id. Unusable vectors, as in top_k, neither ask nor answer.
    """
    spark = docs.sparkSession
    rows = docs.where(_usable(F.col(embedding), width)).select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    asked = queries.where(_usable(F.col("embedding"), width)).select("query_id", F.col("embedding").cast("array<double>").alias("e"))
    parts, path, found = max(1, ceil(asked.count() / (0.9 * SLICE))), scratch_path(spark, "found"), None
    for s in range(parts):
        table = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == s).toArrow()  # at most some SLICE vectors
        names = table["query_id"].to_numpy()
        q = np.asarray(table["e"].combine_chunks().flatten(), np.float64).reshape(-1, width)
        shared = spark.sparkContext.broadcast((names, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best, who = np.full((len(names), k), -np.inf), np.full((len(names), k), -1, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    own = part.column(0).to_numpy()
                    v = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, width)
                    v = v / np.linalg.norm(v, axis=1, keepdims=True)
                    for first in range(0, len(names), BLOCK):
                        now = slice(first, first + BLOCK)
                        c = np.round(q[now] @ v.T, 6)
                        c[(names[now, None] == own[None, :]) | (c < threshold)] = -np.inf
                        both, ids = np.concatenate((best[now], c), axis=1), np.concatenate((who[now], np.broadcast_to(own, c.shape)), axis=1)
                        order = np.lexsort((ids, -both), axis=1)[:, :k]
                        best[now], who[now] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
            ok = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)[ok.ravel()]), pa.array(who[ok]), pa.array(best[ok])], names=["query_id", "id", "cosine_similarity"])

        found = rows.mapInArrow(search, "query_id long, id long, cosine_similarity double")
        if parts > 1:
            found.write.mode("append").parquet(path)
    if parts > 1:
        found = spark.read.schema(found.schema).parquet(path)
    ranked = found.selectExpr("query_id", "cast(row_number() over (partition by query_id order by cosine_similarity desc, id) as int) as rank", "id", "cosine_similarity")
    return ranked.where(F.col("rank") <= k)


def distinct_vectors(docs: DataFrame, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, copies): the smallest id of each group of vectors with equal signatures, and the group's size.

    Null and empty vectors and those with NaN are left out. Grouped with partial sums, so a vector stored any number of times
    is shuffled once per task.
    """
    v = F.col(embedding)
    rows = docs.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return rows.groupBy(vector.signature(v).alias("signature")).agg(F.min(id).alias("id"), F.count("*").alias("copies")).select("id", "copies")


def with_contents(hits: DataFrame, docs: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """(rank, id, cosine_similarity, content): the hits' contents, looked up after the cut to k; hits without content drop out.

    hits come from top_k, so their number is bounded by k and they are broadcast.
    """
    texts = docs.select(F.col(id).alias("id"), F.col(content).alias("content")).where("content <> ''")
    ranked = texts.join(F.broadcast(hits), "id")
    return ranked.selectExpr("cast(row_number() over (order by cosine_similarity desc, id desc) as int) as rank", "id", "cosine_similarity", "content")


def context(ranked: DataFrame) -> DataFrame:
    """One row (context): numbered hits with their similarity, best first, a line break between them."""
    line = F.format_string("[Doc %d] (CosSim: %.4f)\n%s", "rank", "cosine_similarity", "content")
    lines = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def prompt(question: str, contexts: DataFrame) -> DataFrame:
    """One row (prompt) for an answering model. The wording is a fixed value."""
    head = F.lit(f"Answer using only context below. If unsure, say 'I don't know'.\nQuestion: {question}\nContext (ranked by relevance):\n")
    return contexts.select(F.concat(head, "context", F.lit("\n")).alias("prompt"))


def answered(prompts: DataFrame, answerer: Answerer, prompt: str = "prompt") -> DataFrame:
    """prompts with the column answer of an answering model, which is called in the tasks; null where it fails or the prompt is null."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else answerer(text)
            except Exception:  # noqa: BLE001 - the model's failures are data here
                return None

        for s in batches:
            yield pd.Series([one(x) for x in s], dtype=object)

    return prompts.withColumn("answer", ask.asNondeterministic()(F.col(prompt)))


def preview(docs: DataFrame, characters: int = 200, id: str = "id", content: str = "content") -> DataFrame:
    """(id, preview): the first characters of each content, with an ellipsis where it goes on; null contents are left out."""
    c = F.col(content)
    shown = F.when(F.char_length(c) > characters, F.concat(F.substring(c, 1, characters), F.lit("..."))).otherwise(c)
    return docs.where(c.isNotNull()).select(F.col(id).alias("id"), shown.alias("preview"))


def page(docs: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """One page in the order of a column, for interactive use."""
    return docs.orderBy(order).offset(offset).limit(limit)
