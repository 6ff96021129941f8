"""N-gram Jaccard join against brute force."""

import random
import re
from collections import Counter

import pytest

from velamen.llm import components, jaccard_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k=5, percent=75):
    own = [(i, sets(t, k)) for i, t in rows]
    parent = {i: i for i, _ in own if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, s) in enumerate(own):
        for j, t in own[:x]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in own)


@pytest.mark.parametrize(("k", "percent"), [(5, 75), (3, 60), (5, 100)])
def test_groups(docs, texts, k, percent):
    got = jaccard_join.jaccard_groups(docs, k, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts, k, percent)


def test_frequent_shingles_and_many_buckets(spark, docs, texts, monkeypatch):
    """The same groups with many small buckets and a low bound of what counts as frequent."""
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 2)
    monkeypatch.setattr(jaccard_join, "BUCKET", 50)
    monkeypatch.setattr(jaccard_join, "FLUSH", 300)
    got = jaccard_join.jaccard_groups(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts)


def links(rows, k=5, percent=75):
    own = [(i, sets(t, k)) for i, t in rows]
    return Counter((i, sum(j is not None and i is not None and x != y and len(t) > 0 and 100 * len(s & t) >= percent * len(s | t) for y, (j, t) in enumerate(own))) for x, (i, s) in enumerate(own))


@pytest.mark.parametrize(("k", "percent"), [(5, 75), (3, 60), (5, 100)])
def test_links_of_each(docs, texts, k, percent):
    got = jaccard_join.jaccard_links(docs, k, percent).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == links(texts, k, percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts, k, percent)


def test_links_inside_a_cluster(spark, monkeypatch):
    """Near copies that all link with one text, and only some of them with each other; blocks and tiles cut through them."""
    for name, value in (("BLOCK_SETS", 25), ("TILE", 7), ("COLUMNS", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(3)
    base = [f"w{i}" for i in range(204)]
    rows = [(i, " ".join(base)) for i in range(4)]
    for i in range(90):
        words = list(base)
        for _ in range(r.randrange(8)):
            words[r.choice([20, 50, 80, 110, 140, 170, r.randrange(204)])] = r.choice(["x", f"e{i}"])
        rows.append((10 + i, " ".join(words)))
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = links(rows)
    assert len({n for _, n in expected}) > 10
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == expected


def test_links_where_a_leader_has_leaders(spark):
    """Versions of a text, the later ones in more copies: a leader's leader may follow yet another."""
    r = random.Random(47)
    words, rows = [f"w{j}" for j in range(150)], []
    for x in range(16):
        rows += [" ".join(words)] * (1 + x // 4)
        for _ in range(r.choice([1, 2, 3])):
            words[r.randrange(150)] = f"n{x}_{r.randrange(99)}"
    rows = list(enumerate(rows))
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == links(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_repeated_ids_without_words(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, None), (2, ""), (3, None), (3, " "), (None, None), (4, ""), (4, "x")]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_nothing(nothing):
    assert jaccard_join.jaccard_groups(nothing).count() == 0 and jaccard_join.one_of_each(nothing).count() == 0


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.jaccard_groups(df).collect()} == {(1, 0, 1, 1), (2, 0, 2, 1), (3, 0, 3, 1)}


def test_one_of_each(docs, texts):
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    expected = {i for i, _, c in brute(texts) if i == c}
    assert Counter(r["doc_id"] for r in left.collect()) == Counter({i: 1 for i in expected})


def test_links_at_the_threshold(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(words))]
    for n in (74, 75, 76):  # the first n + 4 words: n of its 100 shingles
        rows.append((n, " ".join(words[: n + 4])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert brute(rows) == Counter((i, len(sets(t)), got[i]) for i, t in rows)


@pytest.mark.parametrize("hub", [200_000, 10])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(500, 560)] + [(900, 900 + i) for i in range(1, 80)] + [(7, 7), (1, 2), (2, 1)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_percent_is_bounded(docs):
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.jaccard_groups(docs, 5, 40)
