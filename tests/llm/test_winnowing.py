"""Fingerprints against a window-by-window reading."""

import hashlib

import xxhash
from pyspark.sql import functions as F

from velamen.llm import winnowing
from velamen.llm.winnowing import K, WINDOW


def signed(v):
    return v - (1 << 40) if v >= 1 << 39 else v


def kept(text):
    """(hash, position) of each window's smallest gram, the rightmost of ties."""
    if not text:
        return []
    grams = [text[i : i + K] for i in range(len(text) - K + 1)] if len(text) >= K else [text]
    values = [(signed(xxhash.xxh64(g.encode(), seed=42).intdigest() >> 24), -i) for i, g in enumerate(grams)]
    windows = [values[i : i + WINDOW] for i in range(max(1, len(values) - WINDOW + 1))]
    return list(dict.fromkeys(min(w) for w in windows))


def likeness(a, b):
    a, b = {v for v, _ in a}, {v for v, _ in b}
    return len(a & b) / len(a | b) if a or b else 1.0


def expected(rows):
    out = []
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        hexed = lambda f: "".join("%010x" % (v & ((1 << 40) - 1)) for v, _ in f)
        own, new, nxt = kept(text), kept(edited), kept(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(new), likeness(own, new), likeness(own, nxt), [-p for _, p in own]))
    return out


def test_fingerprints(docs, texts):
    rows = sorted({(i, t or "") for i, t in texts if i is not None})
    df = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    got = sorted(tuple(r) for r in winnowing.winnowed(df).collect())
    assert got == sorted(expected(rows))


def test_ranges_meet(spark, monkeypatch):
    """Every document's next one, across ranges of a few documents, over ids far apart."""
    monkeypatch.setattr(winnowing, "RANGE_CHARS", 200)
    rows = [(i**5 - 10**6, f"text {i} " + "abcdefghij"[i % 10] * (i % 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(tuple(r) for r in winnowing.winnowed(df).collect()) == sorted(expected(rows))


def test_ranges_of_one_id(spark, monkeypatch):
    """An id, or the null id, that holds most rows is cut by its texts."""
    monkeypatch.setattr(winnowing, "RANGE_CHARS", 300)
    rows = [(7 if i % 3 else i, f"text number {i} " + "klmnopqrst"[i % 10] * (i % 40)) for i in range(200)]
    by = {}
    for r in winnowing.winnowed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        by.setdefault((r["doc_id"], r["n_chars"], r["fingerprint"]), []).append(r)
    order = lambda row: (row[0], (xxhash.xxh64(row[1].encode(), seed=42).intdigest() >> 2))
    want = {}
    for x in expected(sorted(rows, key=order)):
        want.setdefault((x[0], x[1], x[3]), []).append(x)
    assert {k: sorted(tuple(r) for r in v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}


def test_segments_meet(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "SEGMENT", 50)
    texts = ["abcdefghij" * 40, "x" * 500, "".join(chr(97 + (i * i * 7 + i // 3) % 23) for i in range(3000)), "é日😀" * 90, "a" * 92, "b" * 93]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in winnowing.winnowed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(expected(rows))


def test_a_text_of_seventeen_million_characters(spark):
    """More than 24 bits of positions; its last gram is the same one as elsewhere."""
    n = 17_000_000
    end = "an end of forty-three characters and a few more"
    df = spark.range(2).selectExpr("id AS doc_id", f"CASE WHEN id = 1 THEN concat(repeat('0123456789 ', {n // 11}), '{end}') ELSE '{end}' END AS text")
    kept = winnowing._with_kept(df, "text", "kept").select("doc_id", F.element_at("kept", -1).alias("hash"), F.element_at("kept_at", -1).alias("at"), F.size("kept").alias("n"))
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[1]["hash"] == rows[0]["hash"] and rows[1]["at"] == rows[0]["at"] + n // 11 * 11 > 2**24 and rows[1]["n"] > n / 40


def test_nothing_nulls_and_repeats(spark, nothing):
    assert winnowing.winnowed(nothing).count() == 0
    one = winnowing.winnowed(spark.createDataFrame([(5, "a text of some length, long enough for more than one window of grams")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    df = spark.createDataFrame([(None, "x" * 60), (None, None), (1, "same"), (1, "same"), (2, "")], "doc_id long, text string")
    rows = winnowing.winnowed(df).collect()
    assert len(rows) == 5 and {r["n_chars"] for r in rows} == {60, 0, 4}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1


def test_shared_passage_shares_a_gram(spark):
    passage = "a passage of forty-three characters or more"[: K + WINDOW - 1]
    assert len(passage) == K + WINDOW - 1
    a, b = "first words " * 9 + passage + " and an end", passage + " another text behind it" * 5
    rows = {r["doc_id"]: r for r in winnowing.winnowed(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    cut = lambda x: {x[i : i + 10] for i in range(0, len(x), 10)}
    assert cut(rows[1]["fingerprint"]) & cut(rows[2]["fingerprint"])


def test_no_python_in_the_plan(docs):
    plan = winnowing.winnowed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
