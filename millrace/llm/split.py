"""Problem 1: items above a size limit, cut into overlapping pieces at natural boundaries.

Sizes are estimated tokens (characters // 4), so a piece has at most 4 * limit characters and repeats the last 4 * overlap
characters of the piece before. The cut positions of an item are chosen by dynamic programming over its boundary positions:
the sum of the cuts' penalties and of the squared deviations of the pieces from an even size is smallest.

Boundary positions and their penalties: after a blank line 0; after a line break 0.1; after the end of a sentence 0.25; after a
clause (comma, semicolon, colon) 0.6; where two of these lie more than an eighth of the limit apart also after other white
space 1; and where even these lie further apart than that, every 32 characters inside the run 50. Cuts of the last kind
are made only where nothing else fits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import estimated_tokens, is_blank
from millrace.session import written

_BREAK = re.compile(r"(?P<blank>\n[^\S\n]*\n\s*)|(?P<line>[\n\r  ]\s*)|(?P<stop>[.!?…]+[)\]\"'»”]*\s+|[。！？]+\s*)|(?P<clause>[,;:]\s+|[，；：、]\s*)")
_SPACE, _RUN = re.compile(r"\s+"), re.compile(r"\S+")
_PENALTY = {"blank": 0.0, "line": 0.1, "stop": 0.25, "clause": 0.6}
_WORD, _HARD, _STEP = 1.0, 50.0, 32
CUTS = ("end", "blank", "line", "stop", "clause", "space", "hard")


def boundaries(text: str, gap: int) -> tuple[list[int], list[float], list[int]]:
    """Inner cut positions in order, their penalties, and their kinds as indexes into CUTS."""
    at, cost, kind = [], [], []
    n = len(text)

    def fill(a: int, b: int) -> None:
        """Positions for a stretch (a, b) that has no natural boundary."""
        if b - a <= gap:
            return
        last = a
        for m in [*_SPACE.finditer(text, a, b), None]:
            p = m.end() if m else b
            if p - last > gap:
                hard = range(last + _STEP, p, _STEP)
                at.extend(hard), cost.extend([_HARD] * len(hard)), kind.extend([6] * len(hard))
            if m and a < p < b:
                at.append(p), cost.append(_WORD), kind.append(5)
            last = p

    last = 0
    for m in _BREAK.finditer(text):
        p = m.end()
        fill(last, p)
        if last < p < n:
            at.append(p), cost.append(_PENALTY[m.lastgroup]), kind.append(CUTS.index(m.lastgroup))
        last = p
    fill(last, n)
    return at, cost, kind


def cut_positions(text: str, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Ends of the pieces' own parts (the last is the length), and the kind of each cut.

    limit and overlap in characters. A piece is text[max(0, e - overlap) of the end before : its end].
    """
    n = len(text)
    if n <= limit:
        return [n], [0]
    at, cost, kind = boundaries(text, max(_STEP, limit // 8))
    p, c = np.array([0, *at, n]), np.array([0.0, *cost, 0.0])
    most = limit - overlap
    even = n / max(1, -(-(n - overlap) // most))
    best, back = np.full(len(p), np.inf), np.zeros(len(p), np.int64)
    best[0] = 0.0
    low = np.searchsorted(p, p - most)
    first = int(np.searchsorted(p, limit, "right"))
    for j in range(1, len(p)):
        i = np.arange(0 if j < first else low[j], j)
        size = p[j] - p[i]
        total = best[i] + ((size - even) / even) ** 2
        if j < len(p) - 1 and p[j] <= overlap:  # the first piece holds at least the overlap
            continue
        k = int(np.argmin(np.where((size <= most) | (i == 0) & (size <= limit), total, np.inf)))
        if np.isfinite(total[k]):
            best[j], back[j] = total[k] + c[j], i[k]
    ends, kinds, j = [], [], len(p) - 1
    while j > 0:
        ends.append(int(p[j]))
        kinds.append(0 if j == len(p) - 1 else kind[j - 1])
        j = back[j]
    return ends[::-1], kinds[::-1]


def long_run_starts(text: str, ends: list[int], longest: int) -> list[int]:
    """For each cut, the start of the run of more than `longest` characters without white space that it lies in; else -1."""
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text) if m.end() - m.start() > longest]
    starts = [a for a, _ in runs]
    before = [bisect_left(starts, e) - 1 for e in ends]  # the last run that begins before the cut
    return [starts[i] if i >= 0 and e < runs[i][1] else -1 for i, e in zip(before, ends)]


def _oversized(items: DataFrame, content: str, limit_tokens: int) -> DataFrame:
    c = F.col(content)
    return items.where(c.isNotNull() & ~is_blank(c) & (estimated_tokens(c) > limit_tokens))


def forced_cuts(items: DataFrame, id: str = "id", content: str = "content", limit_tokens: int = 500, overlap_tokens: int = 32) -> DataFrame:
    """(id, run_start): for each oversized item, the pieces' cuts that lie inside a run without white space longer than a piece.

    One row per run; an item none of whose cuts had to go through such a run has one row with -1. Null and blank contents and
    those within the limit are left out. Rows that are delivered again make no difference.
    """
    limit, overlap = 4 * limit_tokens, 4 * overlap_tokens

    @F.pandas_udf("array<int>")
    def starts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([sorted(set(long_run_starts(x, cut_positions(x, limit, overlap)[0], limit)) - {-1}) or [-1] for x in s], dtype=object)

    over = _oversized(items.select(F.col(id).alias("id"), F.col(content).alias("content")), "content", limit_tokens)
    return over.select("id", F.explode(starts("content")).alias("run_start")).select("id", F.col("run_start").cast("long").alias("run_start")).distinct()


_PIECE = "part int, file string, at long, item string, piece int, start int, end int, cut string, text string"


def split_items(items: DataFrame, limit_tokens: int = 500, overlap_tokens: int = 32) -> DataFrame:
    """All pieces of queue items (id, content, file_path, chunk_index, enqueued_at), numbered through each file.

    Returns (file_path, chunk_index, item_id, piece, start, end, cut, text): items of a file follow each other by chunk_index (null
    last), enqueued_at and id; chunk_index of the result counts the pieces of the file from 0. Items within the limit are one
    piece; null and blank contents have none; an item delivered again (same id and content) counts once; an item without
    file_path belongs to the path in its id, or to the file '' where that has none.

    The rows are range-partitioned by (file, order within it), so that a file with a third of all rows is spread over many tasks;
    each task numbers its own stretch. Only a file that began in an earlier task needs an offset: at most one per task.
    """
    limit, overlap = 4 * limit_tokens, 4 * overlap_tokens
    path = F.coalesce("file_path", F.nullif(F.regexp_extract("id", r"^(.*):[^:]*:[^:]*$", 1), F.lit("")), F.lit(""))
    rows = items.select(path.alias("file"), "chunk_index", "enqueued_at", F.col("id").alias("item"), F.col("content").alias("text"))
    rows = rows.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))
    rows = rows.groupBy("item", "text").agg(F.min(F.struct(F.col("file"), F.coalesce("chunk_index", F.lit(2**31 - 1)).alias("no"), F.col("enqueued_at"))).alias("o"))
    order = ["file", "no", "enqueued_at", "item", "text"]
    rows = rows.select("o.*", "item", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            for f, item, text in zip(*(batch.column(k).to_pylist() for k in ("file", "item", "text"))):
                if f != file:
                    file, at = f, 0
                ends, kinds = cut_positions(text, limit, overlap) if len(text) // 4 > limit_tokens else ([len(text)], [0])
                begin = 0
                for k, (e, c) in enumerate(zip(ends, kinds)):
                    out.append((part, f, at, item, k, begin, e, CUTS[c], text[begin:e]))
                    begin, at = max(0, e - overlap), at + 1
            names = [x.split()[0] for x in _PIECE.split(", ")]
            types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, types)], names=names)

    pieces = written(rows.mapInArrow(cut, _PIECE), "pieces")
    counts = pieces.groupBy("file", "part").agg(F.count("*").alias("n"))
    # at most one file runs from one task into the next, so that fewer rows than tasks remain
    w = "sum(n) over (partition by file order by part rows between unbounded preceding and 1 preceding)"
    offsets = counts.selectExpr("file", "part", f"coalesce({w}, 0) as before").where("before > 0")
    numbered = pieces.join(F.broadcast(offsets), ["file", "part"], "left")
    return numbered.select(
        F.col("file").alias("file_path"), (F.col("at") + F.coalesce("before", F.lit(0))).alias("chunk_index"), F.col("item").alias("item_id"), "piece", "start", "end", "cut", "text"
    )
