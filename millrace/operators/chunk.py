"""Overlapping chunks of texts by estimated tokens (four characters each), cut at white space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far from its target a boundary is looked for, in characters.
REACH = 50


def boundary(text: str, start: int, end: int, tokens: int) -> int:
    """Characters of text[start:end] up to the white space nearest to 4 * tokens; of two equally near ones the later.

    The end where the target lies beyond it, and the target itself where no white space is near.
    """
    target, length = 4 * tokens, end - start
    if target >= length:
        return length
    for away in range(REACH):
        if target + away < length and text[start + target + away].isspace():
            return target + away
        if 0 < target - away and text[start + target - away].isspace():
            return target - away
    return target


def chunks(text: str, tokens: int = 500, overlap: int = 32) -> list[str]:
    """A text within the limit whole and as it is, a blank one not at all; otherwise stripped chunks.

    A chunk begins before the end of the one before, by the length to the boundary of `overlap` tokens in that chunk.
    """
    if not text.strip():
        return []
    if len(text) // 4 <= tokens:
        return [text]
    out, start, end = [], 0, 0
    while end < len(text):
        end = start + boundary(text, start, len(text), tokens)
        if piece := text[start:end].strip():
            out.append(piece)
        start = max(start + 1, end - boundary(text, start, end, overlap))
    return out


def chunked(docs: DataFrame, id: str = "doc_id", text: str = "text", tokens: int = 500, overlap: int = 32) -> DataFrame:
    """(id, chunk_index, content): the chunks of each text, numbered from 0. Null and blank texts have none.

    One pass without a shuffle; a task holds one text and its chunks at a time beside the Arrow batch.
    """
    kind = docs.schema[id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, index, out = [], [], []
                part = batch.slice(at, 500)
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    pieces = chunks(value, tokens, overlap) if value else []
                    ids += [name] * len(pieces)
                    index += range(len(pieces))
                    out += pieces
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(out, pa.string())], names=["id", "chunk_index", "content"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(cut, f"id {kind}, chunk_index int, content string")
