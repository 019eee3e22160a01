"""Problem 6: evaluation passages inside corpus documents, by winnowing.

Of every window of `window` successive word k-grams the smallest hash is kept (the rightmost of equal ones). Two texts that share
k + window - 1 successive words share a whole window and therefore a kept hash, so no such span is missed. The kept hashes of
corpus and test items are joined, and a hit is extended word by word in both directions on the words themselves, which makes the
result exact.

A passage is `span` successive words of an item, or all of an item that has fewer words. Shorter items get k-grams and windows
of their own, chosen so that the guarantee covers their length.

The corpus is read once. Its kept hashes are held against a Bloom filter of the items' hashes inside the tasks; its size is bounded
by a parameter, and where the items outgrow it, it merely lets more through. Only what passes is shuffled, with the words around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import WORD
from millrace.llm import shingles as S
from millrace.session import written

#: Words of a k-gram, where the passage is long enough; bits of the Bloom filter, at least and at most (8 MB).
GRAM, BLOOM_BITS, BLOOM_MOST = 8, 1 << 16, 1 << 26


def winnow(flat: np.ndarray, counts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of the kept k-grams. A text with fewer than `window` k-grams has none."""
    h, row, at = S.grams(flat, counts, k)
    n = len(h) - window + 1
    if n <= 0:
        return h[:0], row[:0], at[:0]
    least, where = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        smaller = h[j : j + n] <= least
        least, where = np.where(smaller, h[j : j + n], least), np.where(smaller, j, where)
    inside = row[:n] == row[window - 1 : window - 1 + n]
    kept = np.unique((np.arange(n) + where)[inside])
    return h[kept], row[kept], at[kept]


def shape(words: int, span: int) -> tuple[int, int, int]:
    """(passage length, k, window) for an item with so many words."""
    n = min(words, span)
    k = min(GRAM, n)
    return n, k, n - k + 1


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [S.mix(h + np.uint64(i)) % np.uint64(bits) for i in (1, 2, 3, 4)]


def _context(words: list[str], at: int, length: int) -> tuple[int, list[str]]:
    """The words that a passage of `length` around the k-gram at `at` can touch, lower-cased, and where the k-gram begins among them."""
    a = max(0, at - length + 1)
    return at - a, [w.lower() for w in words[a : at + length]]


_HIT = "id long, n int, h long, lead int, words array<string>"


def _hits(batches: Iterator[pa.RecordBatch], shapes: list[tuple[int, int, int]] | None, span: int, bloom: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(id, text) to kept k-grams. shapes None: test items, each by its own length; otherwise the corpus, by all of them."""
    known, seed = S.WordHashes(), {}
    for batch in S.slices(batches, 500):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        words = [WORD.findall(t) for t in texts]
        flat, counts = S.word_hashes(texts, known)
        out: list[tuple] = []
        todo = shapes if shapes is not None else sorted({shape(len(w), span) for w in words if w})
        for n, k, window in todo:
            h, row, at = winnow(flat, counts, k, window)
            h = S.mix(h + np.uint64(seed.setdefault(n, 131 * n)))
            if bloom is not None:
                bits = np.uint64(len(bloom) * 8)
                ok = np.ones(len(h), bool)
                for b in _bits(h, int(bits)):
                    ok &= (bloom[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
                h, row, at = h[ok], row[ok], at[ok]
            for x, r, p in zip(h.view(np.int64).tolist(), row.tolist(), at.tolist()):
                if shapes is not None or min(len(words[r]), span) == n:
                    out.append((ids[r], n, x, *_context(words[r], p, n)))
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "n", "h", "lead", "words"])


def bloom_filter(hits: DataFrame) -> np.ndarray:
    """The items' hashes as bits in bytes; built in the tasks as 64-bit words, of which at most BLOOM_MOST / 64 reach the driver."""
    bits = min(BLOOM_MOST, max(BLOOM_BITS, 1 << int(64 * max(hits.count(), 1)).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.unique(np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), bits))) if batch.num_rows else np.empty(0, np.uint64)
            at, bit = b >> np.uint64(6), np.left_shift(np.uint64(1), b & np.uint64(63))
            first = np.flatnonzero(np.diff(at.view(np.int64), prepend=-1))
            value = np.bitwise_or.reduceat(bit, first) if len(at) else bit
            yield pa.RecordBatch.from_arrays([pa.array(at[first].view(np.int64)), pa.array(value.view(np.int64))], names=["at", "word"])

    rows = hits.select("h").mapInArrow(place, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return out.view(np.uint8)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined hits to those whose words agree over the whole passage length around the k-gram."""
    for batch in batches:
        keep, longest = [], []
        for n, la, wa, lb, wb in zip(*(batch.column(c).to_pylist() for c in ("n", "lead_a", "words_a", "lead_b", "words_b"))):
            back = 0
            while back < min(la, lb) and wa[la - back - 1] == wb[lb - back - 1]:
                back += 1
            ahead = 0
            while ahead < min(len(wa) - la, len(wb) - lb) and wa[la + ahead] == wb[lb + ahead]:
                ahead += 1
            keep.append(back + ahead >= n and ahead > 0)
            longest.append(back + ahead)
        ok = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(ok), batch.column("item_id").filter(ok), pa.array(longest, pa.int32()).filter(ok)], names=["doc_id", "item_id", "words"])


def leaked_items(docs: DataFrame, items: DataFrame, span: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, words): documents that hold a passage of an item, once each, with the longest agreement seen around a hit
    (counted up to `span` - 1 words on either side of the k-gram).

    Words are runs of letters and digits in any case. Null ids and texts and texts without words have no passages. An item that
    is repeated under several ids is reported under each. Other columns are ignored; empty tables give an empty result.
    """
    texts = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    tests = written(texts.mapInArrow(lambda it: _hits(it, None, span, None), _HIT), "items")
    lengths = sorted(r.n for r in tests.select("n").distinct().collect())  # at most `span` numbers
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(tests))
    shapes = [shape(n, span) for n in lengths]
    corpus = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    hits = corpus.mapInArrow(lambda it: _hits(it, shapes, span, bloom.value), _HIT)
    a = hits.select(F.col("id").alias("doc_id"), "n", "h", F.col("lead").alias("lead_a"), F.col("words").alias("words_a"))
    b = tests.select(F.col("id").alias("item_id"), "n", "h", F.col("lead").alias("lead_b"), F.col("words").alias("words_b"))
    found = a.join(b, ["n", "h"]).mapInArrow(_extended, "doc_id long, item_id long, words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
