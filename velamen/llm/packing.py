"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, tuned, written
from .tokens import encode

#: Rows of a group that ranks are counted in, about.
RANK_ROWS = 100_000


def _pieces(size: int, end: int, path: str | None):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or "", path), end], "<u4")
                for a in range(0, len(ids), size):
                    part = ids[a : a + size]
                    rows.append((doc, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many packs, their lengths) for `counts` pieces of each length: longest lengths first, each piece into the
    emptiest pack that has room; a new pack only where none has. Packs that are alike are one pattern with a count, so
    that the pieces of a length are placed pattern by pattern: first one into each of the emptiest packs, and where no
    pack has room, new packs are filled one after another, as a new pack is the emptiest until it is full."""
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (room := max(by_room, default=0)) >= length:
            patterns = by_room[room]
            n, lengths = patterns.pop()
            if n > left:
                patterns.append((n - left, lengths))
                n = left
            if not patterns:
                del by_room[room]
            left -= n
            by_room.setdefault(room - length, []).append((n, [*lengths, length]))
        each = size // length
        for n, k in ((left // each, each), (1, left % each)):
            if n and k:
                by_room.setdefault(size - k * length, []).append((n, [length] * k))
    return [p for room in sorted(by_room) for p in by_room[room]]


def _ranked(pieces: DataFrame, groups: int) -> DataFrame:
    """rank of each piece among those of its length, from 0, without gathering a length in one task."""
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    sums = dealt.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    return dealt.withColumn("rank", F.row_number().over(order) - 1).join(sums.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def packed(docs: DataFrame, size: int = 2048, end: int = 1, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its ids and the id `end`; null text is empty, so it is one id. Documents longer than `size` are cut
    into pieces of `size` and a rest. Sequences are numbered from 0 without gaps; offsets in them run from 0 without
    gaps; what is left up to `size` is padding. Repeated rows and null doc_ids are packed like any other row; other
    columns are ignored; an empty table has no pieces.
    """
    spark = docs.sparkSession
    tuned(spark)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batched(_pieces(size, end, vocabulary)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = written(pieces, "pieces")
    counts = dict(pieces.groupBy("length").count().collect())  # at most `size` rows
    used, places, first = dict.fromkeys(counts, 0), [], 0
    for n, lengths in shortest_pack_first(counts, size):
        offset = 0
        for length in lengths:
            places.append((length, used[length], used[length] + n, first, offset))
            used[length] += n
            offset += length
        first += n
    # as many rows as patterns have lengths: the histogram bounds them, not the documents
    table = spark.createDataFrame(places, "length long, low long, high long, first long, offset long")
    ranked = _ranked(pieces, max(16, sum(counts.values()) // RANK_ROWS))
    found = ranked.join(F.broadcast(table), "length").where("rank >= low AND rank < high")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
