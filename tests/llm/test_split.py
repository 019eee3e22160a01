from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import split

LIMIT, OVERLAP = 2000, 128


def pieces(text):
    ends, kinds = split.cut_positions(text, LIMIT, OVERLAP)
    starts = [0, *(max(0, e - OVERLAP) for e in ends[:-1])]
    return [text[a:b] for a, b in zip(starts, ends)], ends, kinds


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Ende. ", "next\n\n", "x" * 700, "é" * 90 + ", ", "。", "\U0001f600 ", "y" * 2500, " "]), min_size=1, max_size=40).map("".join))
def test_round_trip_limits_and_overlap(text):
    out, ends, _ = pieces(text)
    assert all(0 < len(p) <= LIMIT for p in out)
    assert "".join([out[0], *(p[OVERLAP:] for p in out[1:])]) == text
    assert all(b[:OVERLAP] == a[-OVERLAP:] for a, b in zip(out, out[1:]))


def test_cuts_lie_at_natural_boundaries():
    text = ("One sentence about files here. " * 60 + "\n\n") * 3
    _, ends, kinds = pieces(text)
    assert {split.CUTS[k] for k in kinds} <= {"blank", "stop", "end"} and kinds[0] != 6
    words = "word " * 2000
    assert {split.CUTS[k] for k in pieces(words)[2]} == {"space", "end"}


def brute(text, limit, overlap):
    """The least cost by trying every choice of cuts."""
    at, cost, _ = split.boundaries(text, max(32, limit // 8))
    p, c, n = [0, *at, len(text)], [0.0, *cost, 0.0], len(text)
    even = n / max(1, -(-(n - overlap) // (limit - overlap)))
    best = {0: 0.0}
    for j in range(1, len(p)):
        if j < len(p) - 1 and p[j] <= overlap:
            continue
        ok = [best[i] + ((p[j] - p[i] - even) / even) ** 2 for i in best if p[j] - p[i] <= (limit if i == 0 else limit - overlap)]
        if ok:
            best[j] = min(ok) + c[j]
    return best[len(p) - 1]


def test_cost_is_least():
    text = "".join(f"Line {i} has some words, more words; and a stop. {'x' * (i % 7) * 9}\n" for i in range(120))
    ends, kinds = split.cut_positions(text, 400, 40)
    even = len(text) / -(-(len(text) - 40) // 360)
    weights = dict(zip(("blank", "line", "stop", "clause", "space", "hard"), (0.0, 0.1, 0.25, 0.6, 1.0, 50.0)))
    mine = sum(((b - a - even) / even) ** 2 for a, b in zip([0, *ends], ends)) + sum(weights[split.CUTS[k]] for k in kinds[:-1])
    assert abs(mine - brute(text, 400, 40)) < 1e-9


ITEMS = "id string, content string, tags array<string>, file_path string, chunk_index int, enqueued_at double, size_bytes long, piece int"


def table(spark):
    run = "r" * 2100
    rows = [
        ("f:0:1", "small", None, "f", 0, 1.0, 1, 9), ("f:2:3", "one " * 700, None, "f", 2, 3.0, 1, 9), ("f:2:3", "one " * 700, None, "f", 2, 3.0, 1, 9), ("f:1:2", "b" * 100 + " " + run + " end", None, "f", 1, 2.0, 1, 9),
        ("g:0:1", None, None, "g", 0, 1.0, 1, 9), ("g:1:1", " \n" * 3000, None, "g", 1, 1.0, 1, 9), ("h:x:5:1", "lost path", None, None, None, 1.0, 1, 9), ("odd", "no path", None, None, None, None, 1, 9),
        ("f:9:9", "z" * 2003, None, "f", 9, 9.0, 1, 9), ("f:9:8", run + " " + "q" * 5000, None, "f", 9, 8.0, 1, 9),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_forced_cuts(spark):
    got = {(r.id, r.run_start) for r in split.forced_cuts(table(spark)).collect()}
    assert got == {("f:2:3", -1), ("f:1:2", 101), ("f:9:8", 0), ("f:9:8", 2101)}
    assert split.forced_cuts(table(spark).where("false")).count() == 0


def test_pieces_are_numbered_through_each_file(spark):
    rows = split.split_items(table(spark)).orderBy("file_path", "chunk_index").collect()
    files = {}
    for r in rows:
        files.setdefault(r.file_path, []).append(r)
    assert {f: [r.chunk_index for r in x] for f, x in files.items()} == {f: list(range(len(x))) for f, x in files.items()}
    assert list(files) == ["", "f", "h:x"] and [r.item_id for r in files["f"]][:1] == ["f:0:1"]
    assert list(dict.fromkeys(r.item_id for r in files["f"])) == ["f:0:1", "f:1:2", "f:2:3", "f:9:8", "f:9:9"]
    assert all(len(r.text) <= 2003 for r in rows)


def test_one_hot_file_over_many_tasks(spark):
    rows = spark.range(3000).select(F.concat(F.lit("hot:"), "id", F.lit(":1")).alias("id"), F.lit("text").alias("content"), F.lit("hot").alias("file_path"), F.col("id").cast("int").alias("chunk_index"), F.lit(1.0).alias("enqueued_at"))
    got = split.split_items(rows.repartition(6))
    assert got.where("item_id <> concat('hot:', chunk_index, ':1')").count() == 0 and got.count() == 3000
