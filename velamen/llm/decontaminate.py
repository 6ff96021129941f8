"""Benchmark items in training texts: a BM25 index of the items, asked with every passage of every text.

Passages overlap by half and are twice as long as the longest item of their index, so that some passage holds all of
an item that a text quotes. Scores are shares of the score that the item's own words reach; document frequencies and
the mean length are those of all items, however many indexes hold them. The search is block-max WAND with a fixed
threshold: blocks of items in which the largest scores of a passage's terms do not add up to the threshold are skipped;
within a block that is left, the terms' lists are kept in the order of their next item, and all of them jump to the
pivot, the first item at which the largest scores so far reach the threshold. Only pivots are scored. What scores enough
is held against the item's own word sequences, for its question and for its answer.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, chunks, dropped, mix, text_bytes, tuned, words, written

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; share of word sequences that an item or a part must have in it.
SCORE, OVERLAP = 0.5, 0.75
SHINGLE = 5
#: Word counts that part items into indexes with passages of their own length.
CLASSES = (64, 256, 1024, 4096)
#: Terms of items, summed, that one broadcast index holds at most, so about 100 MB; items beyond it make further indexes.
PART_TERMS = 2_000_000
#: Bytes of an index that may be broadcast.
PART_BYTES = 1 << 29
#: Words of a text, and pairs of passages' terms and blocks, that are looked up at a time.
SLICE_WORDS, ROWS = 1 << 16, 1 << 21
SLACK = 1e-9

_ANSWER = re.compile(r"\n\s*(?:answer|a)\s*[:.]\s*|\banswer\s*:\s*", re.IGNORECASE)
_END = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+")


def question_answer(text: str) -> tuple[str, str]:
    """An item's two parts: at a mark `Answer:`, else behind the last `?`, else the last sentence is the answer. An item
    of one sentence is its question and has no answer."""
    marks = list(_ANSWER.finditer(text))
    if marks:
        return text[: marks[-1].start()], text[marks[-1].end() :]
    at = text.rfind("?")
    if 0 <= at < len(text.rstrip()) - 1:
        return text[: at + 1], text[at + 1 :]
    ends = [m for m in _END.finditer(text.rstrip())]
    if ends:
        return text[: ends[-1].start()], text[ends[-1].end() :]
    return text, ""


def _sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    salt = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * salt[j]
    return mix(out)


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    cut = [x.encode("utf-8", "replace") for x in texts]
    hashes, _, _, at = words(np.frombuffer(b"".join(cut), np.uint8), np.cumsum([0, *map(len, cut)]), marks=False)
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..last (last not among them), and which range each is of."""
    sizes = last - first
    of = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + first[of], of


@dataclass
class Statistics:
    """Of all items: how many, their mean length, and in how many of them each term stands (terms in order)."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.items - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    """Postings of the items of one class: terms in order, per term its items in order with their scores, cut into blocks."""

    ids: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # word hashes of the whole, the question, the answer
    half: int
    terms: np.ndarray
    most: np.ndarray  # largest score of each term
    key: np.ndarray  # term * items + item of each posting
    item: np.ndarray
    score: np.ndarray
    first: np.ndarray  # first entry of each term; an entry is a term's postings in one block
    block: np.ndarray
    block_most: np.ndarray
    edge: np.ndarray  # first posting of each entry

    @classmethod
    def of(cls, ids: list[int], parts: list[tuple], half: int, stats: Statistics) -> Index:
        n = len(ids)
        lengths = np.array([len(p[0]) for p in parts])
        terms, term = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        key, tf = np.unique(term * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, item = key // n, key % n
        score = stats.idf(terms)[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / stats.mean))
        score /= np.bincount(item, weights=score, minlength=n)[item]
        block = item // max(8, int(n**0.5) // 2)
        edge = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        most = np.maximum.reduceat(score, np.searchsorted(term, np.arange(len(terms))))
        first = np.searchsorted(term[edge], np.arange(len(terms) + 1))
        return cls(np.array(ids, np.int64), parts, half, terms, most, key, item, score, first, block[edge], np.maximum.reduceat(score, edge), np.append(edge, len(key)))

    def search(self, hashes: np.ndarray, first: np.ndarray, least: float):
        """(document, passage's first word, its last, item, score) of all passages and items that score `least` or more,
        a slice of words at a time."""
        step = max(self.half, SLICE_WORDS // self.half * self.half)
        # slices of a long text share a half; the passage that ends with it is part of one of the next slice
        cut = [(d, a, min(b, a + step + self.half)) for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)) for a in range(a, b, step)]
        at = 0
        while at < len(cut):
            size, to = 0, at
            while to < len(cut) and (to == at or size + cut[to][2] - cut[to][1] <= 2 * SLICE_WORDS):
                size += cut[to][2] - cut[to][1]
                to += 1
            yield from self._slices(hashes, cut[at:to], least)
            at = to

    def _slices(self, hashes: np.ndarray, cut: list[tuple[int, int, int]], least: float):
        doc, begin, end = (np.array(x, np.int64) for x in zip(*cut, strict=True))
        word, of = _spread(begin, end)
        halves = -(-(end - begin) // self.half)
        base = np.cumsum(halves) - halves
        part = base[of] + (word - begin[of]) // self.half
        t = np.minimum(np.searchsorted(self.terms, hashes[word]), len(self.terms) - 1)
        known = self.terms[t] == hashes[word]
        t, part, of = t[known], part[known], of[known]
        # a passage is a half and the one behind it
        before = part > base[of]
        pairs = np.unique(np.concatenate([part, part[before] - 1]) * len(self.terms) + np.concatenate([t, t[before]]))
        passage, t = pairs // len(self.terms), pairs % len(self.terms)
        able = np.bincount(passage, weights=self.most[t], minlength=int(halves.sum())) >= least - SLACK
        passage, t = passage[able[passage]], t[able[passage]]
        owner = np.repeat(np.arange(len(cut)), halves)
        rows = np.cumsum(self.first[t + 1] - self.first[t])
        lo = 0
        while lo < len(passage):  # whole passages, of about so many rows
            hi = int(np.searchsorted(rows, (rows[lo - 1] if lo else 0) + ROWS, "right"))
            hi = int(np.searchsorted(passage, passage[min(max(hi, lo + 1), len(passage) - 1)], "left")) if hi < len(passage) else len(passage)
            hi = hi if hi > lo else int(np.searchsorted(passage, passage[lo], "right"))
            for p, i, s in self._blocks(passage[lo:hi], t[lo:hi], least):
                d = owner[p]
                a = int(begin[d] + (p - base[d]) * self.half)
                yield int(doc[d]), a, int(min(a + 2 * self.half, end[d])), int(i), float(s)
            lo = hi

    def _blocks(self, passage: np.ndarray, t: np.ndarray, least: float):
        """The blocks in which a passage's terms can reach the threshold, and in them the pivots that do."""
        entry, of = _spread(self.first[t], self.first[t + 1])
        blocks = int(self.block.max()) + 1
        names, nth = np.unique(passage, return_inverse=True)
        unit = nth[of] * blocks + self.block[entry]
        if len(names) * blocks > 4 * len(unit) + ROWS:  # few of all blocks are met
            met, unit = np.unique(unit, return_inverse=True)
        else:
            met = np.arange(len(names) * blocks)
        able = np.bincount(unit, weights=self.block_most[entry], minlength=len(met))[unit] >= least - SLACK
        yield from ((names[met[u] // blocks], i, s) for u, i, s in self._pivots(unit[able], entry[able], least))

    def _pivots(self, unit: np.ndarray, entry: np.ndarray, least: float):
        """(unit, item, score) of what reaches the threshold; unit: the passage and block that a term's list is read for.
        Every turn each unit that is left takes its next pivot."""
        at, end, most = self.edge[entry], self.edge[entry + 1], self.block_most[entry]
        while len(unit):
            item = self.item[at]
            order = np.lexsort((item, unit))
            unit, at, end, most, item = (x[order] for x in (unit, at, end, most, item))
            new = np.append(True, unit[1:] != unit[:-1])
            group, head = np.cumsum(new) - 1, np.flatnonzero(new)
            sums = np.cumsum(most)
            enough = sums - (sums[head] - most[head])[group] >= least - SLACK
            pivot = np.full(len(head), -1)
            here = np.flatnonzero(enough)[::-1]
            pivot[group[here]] = item[here]  # the first of each unit stays
            left = pivot[group] >= 0  # others can't reach the threshold any more
            unit, at, end, most, item, group = (x[left] for x in (unit, at, end, most, item, group))
            target = pivot[group]
            front = np.flatnonzero(item <= target)
            term = self.key[at[front]] // len(self.ids)
            at[front] = np.minimum(np.searchsorted(self.key, term * len(self.ids) + target[front]), end[front])
            hit = front[(at[front] < end[front])]
            hit = hit[self.item[at[hit]] == target[hit]]
            total = np.bincount(group[hit], weights=self.score[at[hit]], minlength=len(head))
            which = np.unique(group[hit])
            names = unit[np.searchsorted(group, which)]
            yield from ((u, pivot[g], total[g]) for u, g in zip(names, which, strict=True) if total[g] >= least - SLACK)
            at[hit] += 1
            left = at < end
            unit, at, end, most = (x[left] for x in (unit, at, end, most))


def _share(part: np.ndarray, text: np.ndarray) -> float | None:
    """Share of a part's word sequences that the text has; null for a part without words."""
    if not len(part):
        return None
    k = min(SHINGLE, len(part))
    return float(np.isin(_sequences(part, k), _sequences(text, k)).mean())


def _agrees(parts: tuple, text: np.ndarray, overlap: float) -> tuple[float, float, float] | None:
    """Overlaps of the item, its question and its answer with a passage; null if the passage does not contain it. Items of
    fewer words than a sequence has must stand in it as a whole."""
    whole, question, answer = (_share(p, text) for p in parts)
    both = len(parts[0]) >= SHINGLE and answer is not None and (question or 0) >= overlap and answer >= overlap
    return (whole, question or 0.0, answer or 0.0) if whole >= overlap or both else None


def indexes(ids: list[int], texts: list[str], stats: Statistics, longest: int) -> list[Index]:
    """One index for each class of item lengths; longest: the words of the longest item of all."""
    whole = _word_hashes(texts)
    asked = [question_answer(x) for x in texts]
    parts = list(zip(whole, _word_hashes([q for q, _ in asked]), _word_hashes([a for _, a in asked]), strict=True))
    out, low = [], 0
    for top in [*(c for c in CLASSES if c < longest), longest]:
        own = [i for i, p in enumerate(parts) if low < len(p[0]) <= top]
        if own:
            out.append(Index.of([ids[i] for i in own], [parts[i] for i in own], top, stats))
        low = top
    return out


def statistics(texts: list[str]) -> Statistics:
    """Of a list of items, in memory."""
    found = [np.unique(x) for x in _word_hashes(texts)]
    terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
    lengths = [len(x) for x in _word_hashes(texts) if len(x)]
    return Statistics(len(lengths), sum(lengths) / max(1, len(lengths)), terms, df)


def _terms(batches):
    """Of each item its words and its different terms."""
    for batch in batches:
        found = _word_hashes(batch.column("text").to_pylist())
        terms = [np.unique(x).view(np.int64) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([len(x) for x in found], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "text", "words", "terms"])


def index_table(items: DataFrame) -> DataFrame | None:
    """(part, index) for items (item_id, text): serialised indexes of at most about PART_TERMS terms each, made by the
    executors, as a table in the shared folder; None where no item has a word."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    cut = written(items.mapInArrow(batched(_terms), "item_id long, text string, words long, terms array<long>").where("words > 0"), "items")
    n, total, longest, n_terms = cut.agg(F.count("*"), F.sum("words"), F.max("words"), F.sum(F.size("terms"))).first()
    if not n:
        dropped(cut)
        return None
    parts = -(-n_terms // PART_TERMS)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    df = cut.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = dealt.select(F.col("part").alias("of"), F.explode("terms").alias("term")).distinct().join(df, "term")

    def build(rows: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(terms := counts.column("term").to_numpy().view(np.uint64))
        stats = Statistics(n, total / n, terms[order], counts.column("df").to_numpy()[order])
        rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
        made = indexes(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), stats, longest)
        return pa.table({"part": rows.column("part").slice(0, 1), "index": pa.array([pickle.dumps(made)], pa.binary())})

    table = written(dealt.select("part", "item_id", "text").groupBy("part").cogroup(df.groupBy("of")).applyInArrow(build, "part int, index binary"), "index")
    dropped(cut)
    return table


def _sent(items: DataFrame):
    """The indexes of items, one broadcast at a time."""
    if (table := index_table(items)) is None:
        return
    for row in table.select("part", F.octet_length("index").alias("bytes")).orderBy("part").collect():
        if row["bytes"] > PART_BYTES:
            raise ValueError(f"an index of {row['bytes']} bytes is too large to broadcast: PART_TERMS must be smaller")
        yield items.sparkSession.sparkContext.broadcast(table.where(F.col("part") == row["part"]).first()["index"])
    dropped(table)


def _hits(batch: pa.RecordBatch, found: list[Index], score: float, overlap: float):
    """(row, index, item, score, overlaps) of each item that a row's text contains, with its best passage."""
    raw, at = text_bytes(batch.column("text"))
    for lo, hi in chunks(at):
        hashes, _, _, first = words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], marks=False)
        best: dict = {}
        for which, index in enumerate(found):
            for d, a, b, i, s in index.search(hashes, first, score):
                if shares := _agrees(index.parts[i], hashes[a:b], overlap):
                    best[d, which, i] = max(best.get((d, which, i), ()), (shares[0], s, *shares[1:]))
        for (d, which, i), (whole, s, question, answer) in sorted(best.items()):
            yield lo + d, which, i, s, whole, question, answer


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: the pairs of a row of docs (doc_id, text) and
    an item (item_id, text) that it contains.

    score is the best passage's BM25 as a share of the item's own; overlap the share of the item's sequences of five
    words in that passage, and of its two parts'. A pair is kept when score reaches `score` and either the whole item or
    both parts reach `overlap`; items of fewer than five words must stand in the text as a whole. Null and empty texts
    contain nothing; null items and items without words are found nowhere; repeated items are reported each, repeated
    rows each, a null doc_id like any other; an empty table on either side gives no pairs. Other columns are ignored.
    Texts of any length are looked up in slices. One pass over docs is made for each index of index_table().
    """
    spark = docs.sparkSession
    tuned(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "overlap", "question_overlap", "answer_overlap"))])
    ddl = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    done, last = [], None
    for sent in _sent(items):

        def run(batches, sent=sent):
            found = pickle.loads(sent.value)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], int(found[which].ids[i]), *shares) for d, which, i, *shares in _hits(batch, found, score, overlap)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        if last:  # of several indexes the driver and the executors hold one at a time
            done.append(written(last[0], "hits"))
            last[1].destroy()
        last = docs.mapInArrow(batched(run), ddl), sent
    if not last:
        return spark.createDataFrame([], ddl)
    return reduce(DataFrame.unionByName, done, last[0])


def clean(docs: DataFrame, items: DataFrame, score: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs (doc_id, text, any more) that contain no item, as they are: a row's own text decides, whatever its
    doc_id, be it null or repeated. Null and empty texts stay; no items, or an empty table, leave all rows."""
    tuned(docs.sparkSession)
    last = None
    for sent in _sent(items):
        if last:
            docs = written(docs, "clean")
            last.destroy()
        last = sent

        def run(batches, sent=sent):
            found = pickle.loads(sent.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in _hits(batch, found, score, overlap)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(batched(run), docs.schema)
    return docs
