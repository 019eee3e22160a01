"""Files to records (content, tags): CSV rows, JSON items, Python definitions, text chunks.

One Arrow pass over (path, data): each file is parsed by the parser of its extension. Bytes are decoded as UTF-8 with replacement.
A parser that fails gives the whole text, in overlapping blocks, as records whose tag names the failure; no file fails the job. A row
of a CSV file that cannot be read is left out, the others stay.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.operators.chunk import chunks

#: Characters that the sniffer sees; token limit of a record; characters of a fallback block and of its overlap with the one before.
SNIFFED, TOKENS, BLOCK, BLOCK_OVERLAP = 10_240, 500, 8192, 512
Record = tuple[str, list[str]]


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def _sized(content: str, tags: list[str], large: str) -> Iterator[Record]:
    """One record, or overlapping chunks of it with a numbered tag if it is above the token limit."""
    if len(content) // 4 <= TOKENS:
        yield content, tags
    else:
        for k, piece in enumerate(chunks(content, TOKENS)):
            yield piece, [*tags, f"{large}_chunk_{k}"]


def unique_names(names: Iterable[str]) -> list[str]:
    """Stripped names; a repeated one gets the first free suffix _1, _2, ..."""
    out: list[str] = []
    for name in (x.strip() for x in names):
        k, free = 0, name
        while free in out:
            k += 1
            free = f"{name}_{k}"
        out.append(free)
    return out


def csv_records(text: str, path: str) -> Iterator[Record]:
    """A record per row: a JSON object of the stripped cells. Dialect and header are sniffed; without a header the columns are
    column_0, ...; cells beyond the header are extra_col_j, missing ones are left out."""
    sample = text[:SNIFFED].replace("\0", "")
    try:
        dialect, header = csv.Sniffer().sniff(sample), csv.Sniffer().has_header(sample)
    except csv.Error:
        dialect, header = csv.excel, False
    csv.field_size_limit(sys.maxsize)  # a long cell is no error
    rows = _rows(csv.reader(io.StringIO(text, newline=""), dialect))
    first = next(rows, None)
    if first is None:
        return
    names = unique_names(first) if header else [f"column_{i}" for i in range(len(first))]
    for i, row in enumerate(rows if header else chain([first], rows)):
        cells = {names[j] if j < len(names) else f"extra_col_{j}": cell.strip() for j, cell in enumerate(row)}
        yield from _sized(_text(cells), [*names, path], f"csv_large_row_{i}")


def _rows(reader: Iterator[list[str]]) -> Iterator[list[str]]:
    """The rows of a CSV reader without those that it cannot read."""
    while True:
        try:
            yield next(reader)
        except StopIteration:
            return
        except csv.Error:
            continue


def json_records(text: str, path: str) -> Iterator[Record]:
    """A record per item of a list, else one; tags are the path and the keys of an object."""
    data = json.loads(text)
    kind = "json_array_item" if isinstance(data, list) else "json_object"
    for item in data if isinstance(data, list) else [data]:
        tags = [path, *(map(str, item) if isinstance(item, dict) else ())]
        if isinstance(data, (list, dict)):
            yield from _sized(_text(item), tags, kind)
        else:
            yield _text(item), tags


def python_records(text: str, path: str) -> Iterator[Record]:
    """A record per class and (async) function at any depth of these, and per import of the module itself."""
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function"}
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(n, ("__main__",)) for n in reversed(ast.parse(text).body)]
    while todo:
        node, parents = todo.pop()
        where = {"source_segment": ast.get_source_segment(text, node), "line_number": node.lineno}
        if kind := kinds.get(type(node)):
            element = {"type": kind, "name": node.name, "full_name": ".".join((*parents, node.name)), "parent_path": list(parents), **where, "docstring": ast.get_docstring(node)}
            yield from _sized(_text(element), [kind, path], node.name)
            todo += [(n, (*parents, node.name)) for n in reversed(node.body) if type(n) in kinds]
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [{"name": a.name, "asname": a.asname} for a in node.names]
            module = {"module": node.module} if isinstance(node, ast.ImportFrom) else {}
            yield _text({"type": "import", "names": names, "parent_path": list(parents), **where, **module}), ["import", path]


def text_records(text: str, path: str) -> Iterator[Record]:
    """Stripped overlapping chunks of the text; none of a blank one."""
    for k, piece in enumerate(chunks(text, TOKENS)):
        yield piece.strip(), ["txt_chunk", path, f"chunk_{k}"]


#: Parser of a file type and the tags of its failures, path last or first as the type has it.
PARSERS: dict[str, Callable[[str, str], Iterator[Record]]] = {"csv": csv_records, "json": json_records, "py": python_records, "txt": text_records}


def _failed(kind: str, error: Exception, path: str) -> list[str]:
    if kind == "py":
        return ["py_syntax_error" if isinstance(error, SyntaxError) else "py_parse_fallback", path]
    return {"csv": ["csv_fallback_text_streaming", path], "txt": ["txt_fallback_block", path], "json": [path, "json_fallback_text"]}.get(kind, [f"{kind}_fallback", path])


def fallback(text: str, tags: list[str]) -> Iterator[Record]:
    """The whole text: one record, or numbered blocks, each after the end of the block before."""
    if len(text) <= BLOCK:
        yield text, tags
    else:
        for k, at in enumerate(range(0, len(text), BLOCK)):
            yield text[max(0, at - BLOCK_OVERLAP) : at + BLOCK], [*tags, f"block_{k}"]


def file_records(path: str, data: bytes | None, kind: str | None = None) -> list[Record]:
    """All records of one file; none of a missing or empty one. kind: csv, json, py, txt; by default the extension, else txt."""
    if not data:
        return []
    kind = kind or os.path.splitext(path)[1][1:].lower() or "txt"
    text = data.decode("utf-8", "replace")
    try:
        return list(PARSERS.get(kind, text_records)(text, path))
    except Exception as error:  # noqa: BLE001 - whatever a file holds, it becomes records
        return list(fallback(text, _failed(kind, error, path)))


def parsed(files: DataFrame, path: str = "path", data: str = "data", kind: str | None = None) -> DataFrame:
    """(file_path, chunk_index, content, tags) of files (path, data: binary or string); chunk_index counts a file's records from 0.

    Files with null path or data and empty ones give nothing. Blank records are dropped after numbering.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_path", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string()), ("tags", pa.list_(pa.string()))])
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name is None or not value:
                    continue
                found = [(k, *r) for k, r in enumerate(file_records(name, value if isinstance(value, bytes) else value.encode(), kind)) if r[0].strip()]
                if found:
                    k, content, tags = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k, pa.int32()), pa.array(content), pa.array(tags, pa.list_(pa.string()))], schema=schema)

    return files.select(path, data).mapInArrow(run, "file_path string, chunk_index int, content string, tags array<string>")
