from __future__ import annotations

import csv
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import chunk, parse


def test_limits():
    assert chunk.chunks(" " * 3000) == [] and chunk.chunks("") == []
    assert chunk.chunks("a" * 2003) == ["a" * 2003]
    assert len(chunk.chunks("a" * 2004)) == 2
    assert [len(c) for c in chunk.chunks("a" * 5000)][0] == 2000
    assert chunk.chunks(" x " + "y" * 10) == [" x " + "y" * 10]


def test_nearest_white_space_and_the_later_of_two():
    text = "a" * 1990 + " " + "b" * 9 + "c" * 10 + "  " + "d" * 3000
    assert chunk.boundary(text, 0, len(text), 500) == 1990 or text[2010] == " "
    assert chunk.boundary("x" * 1995 + " " + "x" * 9 + " " + "x" * 100, 0, 2106, 500) == 2005  # 5 after, 5 before


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n  \U0001f600é"), min_size=2000, max_size=9000))
def test_every_character_is_in_a_chunk(text):
    out = chunk.chunks(text)
    assert all(c for c in out)
    at = 0
    for c in out:  # chunks follow each other through the text and leave out only white space
        found = text.find(c, max(0, at - 2100))
        assert found >= 0
        at = max(at, found + len(c))
    assert "".join(text.split()).startswith("".join(out[0].split())) if out else not text.strip()
    assert all(len(c) <= 2050 for c in out)


def test_chunked_table(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "short", 5), (4, "w " * 2000, 5)], "doc_id long, text string, chunk_index int")
    got = [(r.id, r.chunk_index) for r in chunk.chunked(rows).collect()]
    assert got[:1] == [(3, 0)] and [g for g in got if g[0] == 4] == [(4, 0), (4, 1), (4, 2)]
    assert chunk.chunked(rows.where("false")).count() == 0


def test_csv_with_header():
    text = 'name,age,description\nAlice,25,"A software engineer who loves coding"\nBob,31,"Paints, sometimes"\nCara,47,"Sails"\n'
    got = parse.file_records("test_data.csv", text.encode())
    assert got[0] == ('{"name": "Alice", "age": "25", "description": "A software engineer who loves coding"}', ["name", "age", "description", "test_data.csv"])
    assert len(got) == 3


def test_csv_odd_rows():
    words = ["alpha", "be", "gamma ray", "delta", "eps"] * 10
    text = "name,name,count\n" + "".join(f"{w},{w[::-1]},{10 + i}\n" for i, w in enumerate(words)) + "x,y,11,extra\nshort\n"
    got = [json.loads(c) for c, _ in parse.file_records("f.csv", text.encode())]
    assert list(got[0]) == ["name", "name_1", "count"] and got[50]["extra_col_3"] == "extra" and got[51] == {"name": "short"}


def test_csv_without_header_and_large_row():
    rows = "".join(f"word{i},other{i}\n" for i in range(9)).encode()
    small = parse.file_records("f.csv", rows)
    assert small[0] == ('{"column_0": "word0", "column_1": "other0"}', ["column_0", "column_1", "f.csv"]) and len(small) == 9
    big = parse.file_records("f.csv", rows + b"3," + b"word " * 900 + b"\n")
    assert big[9][1][-1] == "csv_large_row_9_chunk_0" and len(big) > 10


def test_csv_keeps_every_row_that_can_be_read():
    words = ["alpha", "be", "gamma ray", "delta", "eps"] * 4
    rows = [f"{w},{10 + i}" for i, w in enumerate(words)]
    text = "name,count\n" + "\n".join(rows) + "\n" + "x" * 3_300_000 + ",77\nlast,78\n"
    got = parse.file_records("f.csv", text.encode())
    cells = [json.loads(c) for c, t in got if not t[-1].startswith("csv_large_row_")]
    assert cells == [*({"name": w, "count": str(10 + i)} for i, w in enumerate(words)), {"name": "last", "count": "78"}]

    def reader():
        yield ["a"]
        raise csv.Error("a row that cannot be read")

    assert list(parse._rows(reader())) == [["a"]]
    large = [c for c, t in got if t[-1].startswith("csv_large_row_")]
    assert sum(map(len, large)) >= 3_300_000 and max(map(len, large)) <= 2050


def test_fallback_keeps_the_whole_text():
    text = "{" + "".join(f"w{i} " for i in range(400_000))
    got = parse.file_records("a.json", text.encode())
    assert got[0][1] == ["a.json", "json_fallback_text", "block_0"] and all(len(c) <= 8192 + 512 for c, _ in got)
    assert got[0][0] + "".join(c[512:] for c, _ in got[1:]) == text


def test_json_kinds():
    assert parse.file_records("a.json", b'[{"k": null, "e": "\xc3\xa9"}, 3]') == [('{"k": null, "e": "é"}', ["a.json", "k", "e"]), ("3", ["a.json"])]
    assert parse.file_records("a.json", b'{"x": {"y": 1}}') == [('{"x": {"y": 1}}', ["a.json", "x"])]
    assert parse.file_records("a.json", b'"s"') == [('"s"', ["a.json"])]
    assert parse.file_records("a.json", b"{broken") == [("{broken", ["a.json", "json_fallback_text"])]


def test_python_elements():
    code = 'import os\nfrom a import b as c\nclass K:\n    """doc"""\n    async def m(self):\n        def inner(): pass\n'
    got = [(json.loads(c), t) for c, t in parse.file_records("m.py", code.encode())]
    assert [t[0] for _, t in got] == ["import", "import", "class", "async_function", "function"]
    assert got[2][0]["docstring"] == "doc" and got[4][0]["full_name"] == "__main__.K.m.inner" and got[1][0]["module"] == "a"
    assert parse.file_records("m.py", b"def (") == [("def (", ["py_syntax_error", "m.py"])]


def test_text_and_unknown_types():
    assert parse.file_records("n.txt", b"  hi  ") == [("hi", ["txt_chunk", "n.txt", "chunk_0"])]
    assert parse.file_records("n.md", b"x\xff")[0][0] == "x�"
    assert parse.file_records("n.txt", b" \n ") == [] and parse.file_records("n.txt", b"") == [] and parse.file_records("n.txt", None) == []


def test_parsed_table(spark):
    rows = spark.createDataFrame([("a.json", b"[1, 2]"), (None, b"x"), ("b.txt", None), ("c.txt", b"")], "path string, data binary")
    assert [(r.file_path, r.chunk_index, r.content) for r in parse.parsed(rows).collect()] == [("a.json", 0, "1"), ("a.json", 1, "2")]


@pytest.mark.parametrize("names,want", [(["a", "a ", "a"], ["a", "a_1", "a_2"]), (["", ""], ["", "_1"]), (["a_1", "a", "a"], ["a_1", "a", "a_2"])])
def test_unique_names(names, want):
    assert parse.unique_names(names) == want
