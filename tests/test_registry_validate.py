from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.config import Settings, retry_delay
from millrace.functions import validate
from millrace.operators import registry

FILES = "filepath string, found boolean, size long, mtime double, checksum string"
KNOWN = "filepath string, size long, mtime double, checksum string"
CASES = [
    ("gone", (False, None, None, None), (5, 1.0, "a"), "file_not_found"), ("gone_new", (False, None, None, None), None, "file_not_found"),
    ("new", (True, 5, 1.0, "a"), None, "new_file"), ("size", (True, 6, 9.0, "b"), (5, 1.0, "a"), "size_changed"),
    ("time", (True, 5, 2.01, "a"), (5, 1.0, "a"), "time_changed"), ("second", (True, 5, 2.0, " A "), (5, 1.0, "a"), "already_processed"),
    ("sum", (True, 5, 1.0, "b"), (5, 1.0, "a"), "content_changed"), ("empty", (True, 0, 1.0, "b"), (0, 1.0, "a"), "already_processed"),
    ("nosum", (True, 5, 1.0, ""), (5, 1.0, "a"), "already_processed"), ("oldnosum", (True, 5, 1.0, "b"), (5, 1.0, None), "already_processed"),
    ("unseen", (None, 5, 1.0, "a"), (5, 1.0, "a"), "error_checking"), ("nosize", (True, None, 1.0, "a"), (5, 1.0, "a"), "error_checking"),
]


@pytest.fixture(scope="module")
def states(spark):
    files = spark.createDataFrame([(p, *f) for p, f, _, _ in CASES], FILES)
    known = spark.createDataFrame([(p, *k) for p, _, k, _ in CASES if k], KNOWN)
    return files, known


def test_reasons(states):
    got = {r.filepath: r.reason for r in registry.changes(*states).collect()}
    assert got == {p: reason for p, _, _, reason in CASES}


def test_counts(states):
    r = registry.change_counts(registry.changes(*states)).first()
    assert (r.total_files, r.files_to_process, r.files_skipped, r.error_files, r.already_processed) == (12, 6, 6, 4, 4)


def test_latest_stats_missing(spark):
    rows = spark.createDataFrame([(1, "a", 10, 1.0, "x", "2030", 3), (2, "a", 20, 1.0, "y", "2031", 0), (3, "b", None, 1.0, None, None, None), (4, None, 1, 1.0, None, None, None)],
                                 "record_no long, filepath string, size long, mtime double, checksum string, processed_at string, records_count long")
    last = registry.latest(rows)
    assert {(r.filepath, r.record_no) for r in last.collect()} == {("a", 2), ("b", 3)} and last.columns == rows.columns
    s = registry.stats(last).first()
    assert (s.total_files, s.total_records, s.files_with_no_records, s.oldest_processing) == (2, 0, 1, "2031")
    assert registry.stats(last.where("false")).first().avg_records_per_file == 0.0
    only_a = spark.createDataFrame([("a",)], "filepath string")
    assert [r.filepath for r in registry.missing(last, only_a).collect()] == ["b"] and [r.filepath for r in registry.kept(last, only_a).collect()] == ["a"]
    assert [r.filepath for r in registry.recent(last).collect()] == ["a"]


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name,shown,stored", [
    ("a/b:c*.txt", "a_b_c_.txt", "a_b_c_.txt"), ("", "unnamed_file", ""), ("  ", "unnamed_file", "__"), (".hid", ".hid", "_hid"), ("na\u00efve 1.py", "na\u00efve 1.py", "na\u00efve_1.py"),
    ("x" * 300 + ".csv", "x" * 251 + ".csv", "x" * 251 + ".csv"), (None, "unnamed_file", None), ("a\x00b\x85", "ab", "a_b_"),
])
def test_names(spark, name, shown, stored):
    assert one(spark, name, "string", validate.display_name) == shown and one(spark, name, "string", validate.storage_name) == stored


def test_tags(spark):
    assert one(spark, [" a ", "a", None, "<b>", "", "c'd"], "array<string>", validate.listed_tags) == ["a", "b", "cd"]
    assert one(spark, ["t"] * 51, "array<string>", validate.listed_tags) is None
    assert one(spark, [f"t {i}" for i in range(60)], "array<string>", validate.storage_tags) == [f"t_{i}" for i in range(50)]
    assert one(spark, None, "array<string>", validate.storage_tags) is None


@pytest.mark.parametrize("name,state", [("ok_1", "ok"), ("1x", "invalid"), (None, "invalid"), ("SELECT", "keyword"), ("a" * 64, "too_long"), ("a\n", "invalid")])
def test_identifiers(spark, name, state):
    assert one(spark, name, "string", validate.identifier_state) == state


def test_paths_and_patterns(spark):
    for path, state in [("/etc/x.txt", "pattern"), ("a/../../b.txt", "pattern"), ("/root/x.txt", "system_dir"), ("x.md", "extension"), ("dir/A.TXT", "ok"), ("a\0.txt", "nul"), (None, None)]:
        assert one(spark, path, "string", validate.path_state) == state, path
    assert one(spark, r"50%_\ ", "string", validate.escaped_like) == r"50\%\_\\ "
    assert one(spark, "a,b\nc", "string", validate.looks_like_csv) and not one(spark, "ab\nc", "string", validate.looks_like_csv)
    flags = validate.suspicious(F.col("x"))
    assert one(spark, "<ScRiPt a> EVAL (1)", "string", lambda _: flags["script_tag"] & flags["eval_call"] & ~flags["event_handler"])
    assert [one(spark, x, "double", validate.remaining_text) for x in (5.0, 90.0, 7200.0)] == ["5s", "1.5m", "2.0h"]


def test_guards_and_settings():
    assert validate.limit_offset(20_000, 5) == (10_000, 5) and validate.limit_offset(None, None) == (None, None)
    for bad in ((-1, 0), (1, 1_000_001), ("1", 0)):
        with pytest.raises(ValueError):
            validate.limit_offset(*bad)
    for bad in ({"dim": 0}, {"relevance_threshold": 1.5}, {"top_k": 2.5}, {"top_k": -1}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings(relevance_threshold=0.0).relevance_threshold == 0.0
    assert Settings.from_env({"MILLRACE_TOP_K": "7", "MILLRACE_RELEVANCE_THRESHOLD": "0.5"}) == Settings(top_k=7, relevance_threshold=0.5)
    assert [retry_delay(n) for n in range(7)] == [1, 2, 4, 8, 16, 30, 30]


def test_normal_paths_are_those_of_the_standard_library(spark):
    paths = ["a/../b", "../a", "a/./b//c", "/../etc/x", "", "/", ".", "a/b/../../..", "../../x/..", "x/", "/a/..", "é/../ü"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.n for r in rows.select("p", validate.normal_path(F.col("p")).alias("n")).collect()} == {p: os.path.normpath(p) for p in paths}
    state = {r.p: r.s for r in rows.select("p", validate.path_state(F.concat("p", F.lit("/f.txt"))).alias("s")).collect()}
    assert state["a/../b"] == "ok" and state["../a"] == "pattern" and state["/../etc/x"] == "pattern"
