"""Histogram sort: equal bytes, gapless slots, hot texts."""

import zlib
from collections import defaultdict

from velamen.llm import sharding


def check(rows, texts, shards, slack):
    sizes, slots = [0] * shards, defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes) - min(sizes) <= slack, sizes
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -(2**62), r["size"], r["text_crc32"]) for r in rows)
    assert got == sorted((i if i is not None else -(2**62), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_shards(docs, texts):
    longest = max(len((t or "").encode()) + 1 for _, t in texts)
    check(sharding.histogram_shards(docs, 4).collect(), texts, 4, 2 * longest + 200)


def test_one_text_in_half_of_all_rows(spark):
    texts = [(i, "the same text over and over" if i % 2 else f"text number {i} of its own") for i in range(4000)]
    rows = sharding.histogram_shards(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts, 16, 120)


def test_pieces_of_a_shard(spark, monkeypatch):
    """Small pieces: slots follow the sort through all of them, also where one text or row fills many."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", 40)
    texts = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)] + [(9999, "alike")] * 200
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.histogram_shards(df, 4).collect()
    check(rows, texts, 4, 200 * 6 + 60)
    keys = {(r["doc_id"], r["text"]): (r["k"], r["s"]) for r in df.selectExpr("doc_id", "text", "shiftrightunsigned(xxhash64(text), 1) AS k", "shiftrightunsigned(xxhash64(doc_id), 1) AS s").collect()}
    text_of = dict(texts)
    order = [keys[r["doc_id"], text_of[r["doc_id"]]] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_few_and_no_rows(spark, nothing):
    assert sharding.histogram_shards(nothing).count() == 0
    rows = sharding.histogram_shards(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows) == [(0, 1), (1, 2), (1, 2)]
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_one_row_of_almost_all_bytes(spark):
    texts = [(0, "x" * 100_000), *((i, "y" * i) for i in range(1, 50))]
    rows = sharding.histogram_shards(spark.createDataFrame(texts, "doc_id long, text string"), 3).collect()
    check(rows, texts, 3, 100_100)


def test_no_python_in_the_plan(docs):
    plan = sharding.histogram_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
