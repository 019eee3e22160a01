"""Word shingles as 64-bit numbers, and one-permutation min-hash signatures of them, over Arrow batches.

Words are maximal runs of letters and digits, lower-cased; a shingle is `width` consecutive words. All functions here work on
one batch of texts inside a task; Spark partitions and shuffles what they emit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import xxhash

from millrace.functions.text import WORD


def _step(j: int) -> np.uint64:
    """j times the golden ratio, modulo 2**64."""
    return np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the whole number."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word as written, or of its bytes; case is dropped. Forgets everything when it grows beyond a bound."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return h


#: Lower case of ASCII letters and digits; all else is white space.
_ASCII_WORDS = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else 32 for i in range(256))


def word_hashes(texts: Iterable[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts one after the other, and the number of words of each text."""
    # the words of an ASCII text as bytes have the same hashes, and are found faster
    rows = [list(map(known.__getitem__, t.encode().translate(_ASCII_WORDS).split() if t.isascii() else WORD.findall(t))) for t in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter(chain.from_iterable(rows), np.uint64, int(counts.sum()))
    return flat, counts


def grams(flat: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of each run of `width` words that lies within one text."""
    n = len(flat) - width + 1
    row = np.repeat(np.arange(len(counts)), counts)
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = mix(h + flat[j : j + n] + _step(j + 1))
    start = np.concatenate(([0], np.cumsum(counts)))[:-1]
    inside = row[:n] == row[width - 1 : width - 1 + n]
    at = np.flatnonzero(inside)
    return h[at], row[at], at - start[row[at]]


def by_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by row and h; which of two equal elements comes first is left open."""
    if len(row) and row.max() >= 1 << 16:
        return np.lexsort((h, row))
    order = np.argsort(h)
    return order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # 16 bits are sorted by radix


def shingle_sets(flat: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each text, sorted by row and hash."""
    h, row, _ = grams(flat, counts, width)
    order = by_row(h, row)
    h, row = h[order], row[order]
    if len(h):
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
        h, row = h[first], row[first]
    return h, row


def signatures(h: np.ndarray, row: np.ndarray, rows: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation min-hash of each row's shingles, densified; and which rows have any shingle.

    One hash puts a shingle into one of `bins` bins and gives it a value; a bin keeps its smallest. An empty bin takes the
    value of a bin that a hash of (bin, attempt) names, attempt after attempt until one is not empty (optimal densification);
    these hashes are the same for all rows, so equal sets keep equal signatures.
    """
    h = mix(h)
    bin_ = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    value = mix(h ^ _step(1))
    cell = row.astype(np.int64) * bins + bin_.astype(np.int64)
    order = np.argsort(value)[::-1]  # of the values of a bin the last one written stays, the smallest; equal values are equal hashes
    cell, h = cell[order], h[order]
    sig, full = np.zeros(rows * bins, np.uint64), np.zeros(rows * bins, bool)
    sig[cell], full[cell] = h, True
    sig, full = sig.reshape(rows, bins), full.reshape(rows, bins)
    some = full.any(axis=1)
    r, b = np.nonzero(~full & some[:, None])
    attempt = 0
    source_full, source = full.copy(), sig.copy()
    while len(r):
        attempt += 1
        donor = (mix(b.astype(np.uint64) * np.uint64(0x10001) + _step(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = source_full[r, donor]
        sig[r[ok], b[ok]] = source[r[ok], donor[ok]]
        r, b = r[~ok], b[~ok]
    return sig, some


#: Bits of a block, at most; a block of so many agrees by chance in one of 2**48.
BLOCK_BITS = 48


def block_keys(sig: np.ndarray, rows_per_band: int, tables: range) -> np.ndarray:
    """The keys of the signatures in their block tables, as int64 [rows, tables].

    A signature's fingerprint is made of the lowest 48 // rows_per_band bits of each bin; a block is rows_per_band bins of it. In
    the i-th of the tables it is rotated so that block i leads; the key is the number of the table and the leading block's bits.
    """
    width = BLOCK_BITS // rows_per_band
    low = sig[:, : len(tables) * rows_per_band] & np.uint64((1 << width) - 1)
    block = low.reshape(len(sig), len(tables), rows_per_band)
    key = np.broadcast_to(np.array(tables, np.uint64), (len(sig), len(tables))).copy()
    for j in range(rows_per_band):
        key = (key << np.uint64(width)) | block[:, :, j]
    return key.view(np.int64)


def text_sets(texts: list[str], width: int, known: WordHashes) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted arrays."""
    flat, counts = word_hashes(texts, known)
    h, row = shingle_sets(flat, counts, width)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [h[cut[i] : cut[i + 1]] for i in range(len(texts))]


def pair_similarities(left: list[str], right: list[str], width: int, known: WordHashes) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of texts; 0 where neither has a shingle. A text that comes again is hashed once."""
    at = {t: i for i, t in enumerate(dict.fromkeys(chain(left, right)))}
    h, row = shingle_sets(*word_hashes(at, known), width)
    start = np.searchsorted(row, np.arange(len(at) + 1))
    n = len(left)
    text = np.fromiter(map(at.__getitem__, chain(left, right)), np.int64, 2 * n)
    many = start[text + 1] - start[text]
    h = h[np.repeat(start[text] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    row = np.repeat(np.tile(np.arange(n), 2), many)
    order = by_row(h, row)
    h, row = h[order], row[order]
    twice = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.empty(0, np.int64)
    both = np.bincount(row[twice], minlength=n)[:n].astype(float)
    total = many[:n] + many[n:] - both
    return np.divide(both, total, out=np.zeros(n), where=total > 0)


def slices(batches: Iterator, rows: int = 2000) -> Iterator:
    """Arrow batches cut into smaller ones, so that the memory of a task stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
