from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import leaks, mixing, truncation

W = re.compile(r"[^\W_]+")


def passages(text, span=12):
    w = [x.lower() for x in W.findall(text or "")]
    n = min(len(w), span)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        w = [x.lower() for x in W.findall(text or "")]
        for i, item in items:
            for p in passages(item):
                if any(tuple(w[k : k + len(p)]) == p for k in range(len(w) - len(p) + 1)):
                    out.add((d, i))
                    break
    return out


def leak_data():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x1"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 2, 5, 7, 8, 9, 11, 12, 13, 40])))) for i in range(60)] + [(60, None), (61, "..."), (62, "")]
    items.append((63, items[5][1]))
    docs = [(200, None), (201, ""), (202, " ".join(["same"] * 300))]
    for d in range(120):
        body = say(80)
        if d % 2:
            own = W.findall(rng.choice(items[:60])[1])
            n = rng.choice([len(own), 11, 12, 15])
            at = rng.randrange(max(1, len(own) - n + 1))
            body[30:30] = own[at : at + n]
        docs.append((d, ", ".join(body).upper() if d % 3 == 0 else " ".join(body)))
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = leak_data()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, words string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, q).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 60
    assert leaks.leaked_items(d.where("false"), q).count() == 0 and leaks.leaked_items(d, q.where("false")).count() == 0


def test_winnowing_keeps_a_hash_of_every_shared_span():
    import numpy as np

    from millrace.llm import shingles as S

    rng = random.Random(1)
    span = [f"s{i}" for i in range(12)]
    for _ in range(50):
        a, b = ([f"{x}{rng.random()}".replace(".", "") for _ in range(rng.randrange(30))] + span + [f"{x}{i}y" for i in range(9)] for x in "ab")
        h = [leaks.winnow(*S.word_hashes([" ".join(t)], S.WordHashes()), 8, 5)[0] for t in (a, b)]
        assert len(np.intersect1d(*h))


RANKS = os.path.exists(mixing.TOKENIZER)


@pytest.mark.skipif(not RANKS, reason="no tokenizer here")
def test_mix_shares_repeats_and_shortfalls(spark):
    rng = random.Random(0)
    docs = [(i, rng.choice(["Big", " big ", "BIG", "small", "tiny", "other", None]) if i % 5 else "big", "word " * rng.randint(0, 60)) for i in range(3000)] + [(9999, "big", None)]
    d = spark.createDataFrame([(i, s, t, 0) for i, s, t in docs], "doc_id long, source string, text string, slot int").repartition(4)
    plan = spark.createDataFrame([("Big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 1), (None, 0.1, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    used = mixing.mixed(d, plan)
    assert used.groupBy("doc_id", "source").count().where("count > if(source = 'small', 2, 1)").count() == 0
    assert used.select("source").distinct().count() == 3 and used.where("doc_id is null").count() == 0
    assert used.count() == mixing.mixed(d, plan).count()  # the same mix again
    tokens = {}
    for r in mixing.token_counts(d).groupBy("source").agg(F.sum("tokens").alias("t")).collect():
        tokens[r.source] = r.t
    total = sum(tokens[s] for s in ("big", "small", "tiny"))
    missing = {s for s, share, n in (("Big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 1)) if tokens[s.lower()] * n < share * total}
    assert {r.source for r in mixing.shortfalls(d, plan).where("misses").collect()} == missing
    for r in mixing.actual_shares(d, plan).collect():
        if r.source not in missing and r.target_share > 0:
            assert abs(r.tokens / total - r.target_share) < 0.02
    assert mixing.mixed(d.where("false"), plan).count() == 0
    assert mixing.shortfalls(d.where("false"), plan).where("misses").count() == 0


@pytest.mark.skipif(not RANKS, reason="no tokenizer here")
def test_shortfalls_come_from_the_executed_schedule(spark):
    d = spark.createDataFrame([(i, f"s{i % 40}", "word " * (1 + i % 7)) for i in range(400)], "doc_id long, source string, text string")
    plan = spark.createDataFrame([(f"s{i}", 1 / 12_000, 1) for i in range(12_000)], "source string, target_share double, max_repeats int")
    found = mixing.shortfalls(d, plan)
    text = found.where("misses").select("source")._jdf.queryExecution().executedPlan().toString()
    assert "Range (" in text and "Window" in text
    # 40 sources hold a fortieth each, which is more than their share; the others hold nothing
    assert {r.source for r in found.where("misses").collect()} == {f"s{i}" for i in range(40, 12_000)}


@pytest.mark.skipif(not RANKS, reason="no tokenizer here")
def test_token_counts_are_the_tokenizers(spark):
    texts = ["", "Hello world, это ок 123", "a" * 50_000]
    d = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    encode = mixing._encoder(mixing.TOKENIZER, mixing.PATTERN).encode_ordinary
    assert [r.tokens for r in mixing.token_counts(d).orderBy("doc_id").collect()] == [len(encode(t)) for t in texts]


def cut_data():
    rng = random.Random(3)
    names, acts = ["".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(25)], ["locks", "scans", "moves", "drains"]

    def sentence():
        return f"The {rng.choice(names)} {rng.choice(names)} {rng.choice(acts)} every {rng.choice(names)} {rng.choice(names)}"

    rows, cut = [], set()
    for i in range(1500):
        text = ". ".join(sentence() for _ in range(rng.randint(3, 9)))
        kind = i % 10
        if kind == 0:  # in the middle of a sentence or word
            text = text.rsplit(" ", rng.choice([3, 4]))[0] if i % 20 else text[:-2] + "zq"
            cut.add(i)
        elif kind == 1:
            text += "\n\n" + "Signed: op" + str(i)
        elif kind == 2 and len(text) > 200:
            text = text[:200]
            cut |= {i} if not text.endswith(".") else set()
        elif kind == 3:
            text += ". The loader dr&am"
            cut.add(i)
        elif kind != 4:  # 4: whole, without a final stop
            text += rng.choice([".", "!", '."'])
        rows.append((i, rng.choice(["A", " a "]) if kind != 2 else "limited", text))
    return rows + [(8000, "a", None), (8001, None, ""), (8002, None, "A whole text."), (8003, "a", "...")], cut


def test_cut_texts(spark):
    rows, cut = cut_data()
    d = spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "doc_id long, source string, text string, evidence string").repartition(3)
    got = {r.doc_id for r in truncation.cut_texts(d).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    rates = {r.source: r for r in truncation.cut_rates(d).collect()}
    assert set(rates) == {"a", "limited", None} and rates["limited"].rate > 0.5 and rates[None].cut == 0
    assert truncation.cut_texts(d.where("false")).count() == 0 and truncation.cut_rates(d.where("false")).count() == 0


def test_texts_cut_with_a_mark_and_broken_ones_after_a_stop(spark):
    rows, cut = cut_data()
    body = " ".join(t for i, _, t in rows if t and i % 10 > 4)
    for j in range(30):  # cut at one length, and marked
        mark = ["...", " [...]", "…"][j % 3]
        rows.append((9000 + j, "marking", body[301 * j : 301 * j + 300] + mark))
    rows += [(9100, "a", "A whole text. \ufffd"), (9101, "a", "A whole text. &am")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = {r.doc_id: r.evidence for r in truncation.cut_texts(d).collect()}
    assert all(got.get(9000 + j) for j in range(30)) and "field limit" in got.values()
    assert got.get(9100) == got.get(9101) == "broken transfer" and 8003 not in got
