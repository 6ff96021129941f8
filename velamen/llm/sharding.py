"""Equal-size shards by histogram sort.

Rows are ordered by a 63-bit hash of their text and, within it, one of their doc_id, so equal texts lie together and
even a group that holds a third of all rows can be split. Splitters are found by counting: each round sums the exact
bytes of the bins inside every interval that still holds a wanted boundary, and cuts those intervals 64 times finer,
until a boundary is within tolerance of its target or falls between two rows. Only then rows move, once.
"""

from __future__ import annotations

import json
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, written

KEY_BITS, FIRST_BITS, STEP_BITS = 63, 9, 6
TOP = 2**63 - 1
#: Rows of a sorted piece, about.
PIECE_ROWS = 50_000


def _values(spark: SparkSession, pairs: list[tuple[int | None, int]]) -> DataFrame:
    """A small table (base, prefix), by SQL alone."""
    return spark.sql("SELECT CAST(base AS BIGINT) base, CAST(prefix AS BIGINT) prefix FROM VALUES " + ", ".join(f"({'NULL' if b is None else b}, {p})" for b, p in pairs) + " AS t(base, prefix)")


def refined(rows: DataFrame, targets: list[tuple[int, int, int]], base: dict, total: int) -> dict[int, tuple[int, int]]:
    """Boundary of each target as (key, bytes that lie below it in its base), by rounds of exact counts.

    rows: base, key, size. targets: (name, bytes wanted below the boundary, tolerance, base); base: where each begins.
    A boundary whose key bits are used up stays at its last interval's lower edge.
    """
    spark = rows.sparkSession
    done, bits = {}, FIRST_BITS
    held = {t: (0, 0, total if b is None else base[b]) for t, _, _, b in targets}  # prefix, bytes below, bytes inside
    wanted = {t: (want, slack, b) for t, want, slack, b in targets}
    shift = KEY_BITS
    while held:
        shift -= bits
        cuts = sorted({(wanted[t][2], held[t][0]) for t in held}, key=str)
        opened = _values(spark, cuts)
        binned = rows.select("base", F.shiftright("key", shift + bits).alias("prefix"), F.shiftright("key", shift).bitwiseAND((1 << bits) - 1).alias("bin"), "size")
        same = binned["base"].eqNullSafe(opened["base"]) & (binned["prefix"] == opened["prefix"])
        sums = binned.join(F.broadcast(opened), same).groupBy(binned["base"], binned["prefix"], "bin").agg(F.sum("size").alias("size")).collect()
        by: dict = {}
        for b, p, i, size in sums:
            by.setdefault((b, p), {})[i] = size
        for t in list(held):
            want, slack, b = wanted[t]
            prefix, below, _ = held.pop(t)
            bins = by.get((b, prefix), {})
            inside = 0
            for i in sorted(bins):
                inside = bins[i]
                if below + inside > want:
                    break
                below += inside
            else:
                i, inside = (1 << bits) - 1, 0
            edge = (prefix << bits) + i
            if want - below <= slack or inside == 0:
                done[t] = (edge << shift, below)
            elif below + inside - want <= slack:
                done[t] = ((edge + 1) << shift, below + inside)
            elif shift == 0:
                done[t] = (edge, below, inside)  # one key holds the boundary
            else:
                held[t] = (edge, below, inside)
        bits = min(STEP_BITS, shift) or 1
    return done


def cut_points(rows: DataFrame, targets: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """For each target (bytes wanted below it, tolerance; in rising order) where to cut rows (key, sub, size) in the order
    of (key, sub): a boundary that falls within one key is looked for among the subs of that key's rows."""
    alone = rows.select(F.lit(None).cast("long").alias("base"), "key", "size")
    found = refined(alone, [(j, want, slack, None) for j, (want, slack) in enumerate(targets)], {}, total) if total and targets else {}
    inner = {j: x for j, x in found.items() if len(x) == 3}
    finer = {}
    if inner:
        groups = {x[0]: x[2] for x in inner.values()}
        crowd = rows.join(F.broadcast(_values(rows.sparkSession, [(g, 0) for g in groups]).select(F.col("base").alias("key"))), "key")
        finer = refined(crowd.select(F.col("key").alias("base"), F.col("sub").alias("key"), "size"), [(j, targets[j][0] - x[1], targets[j][1], x[0]) for j, x in inner.items()], groups, total)
        for j, x in finer.items():
            if len(x) == 3:  # within one row, or rows that are alike: the nearer side
                finer[j] = (x[0] + (2 * (targets[j][0] - inner[j][1] - x[1]) > x[2]),)
    bounds = [(min(found[j][0], TOP), min(finer[j][0], TOP) if j in finer else 0) if j in found else (TOP, TOP) for j in range(len(targets))]
    return sorted(bounds)


def place(key: Column, sub: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at or below (key, sub), by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [[{"a": a, "b": b} for a, b in bounds[i : i + step]] for i in range(0, len(bounds), step)]
    pairs = "array<struct<a:bigint,b:bigint>>"
    own = F.struct(key.alias("a"), sub.alias("b"))
    at = F.size(F.filter(F.from_json(F.lit(json.dumps([r[0] for r in rows])), pairs), lambda x: x <= own))
    inner = F.size(F.filter(F.element_at(F.from_json(F.lit(json.dumps(rows)), f"array<{pairs}>"), F.greatest(at, F.lit(1))), lambda x: x <= own))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + inner)


class Pieces:
    """Cells of an order by (key, sub), cut once more where one key alone outweighs them: what lies before the key, so many
    parts of the key's own rows by their subs, and what lies behind it. The columns cell, hot and nth name a piece, and
    are in the order of the rows."""

    NAME = ("cell", "hot", "nth")

    def __init__(self, rows: DataFrame, weight: Column, most: int):
        """rows: key, sub, cell and what weight is made of; most: weight of a piece, about."""
        heavy = rows.groupBy("cell").agg(F.sum(weight).alias("w")).where(F.col("w") > 2 * most).select("cell")
        hot = only(rows, heavy, "cell").groupBy("cell", "key").agg(F.sum(weight).alias("w")).where(F.col("w") > 2 * most)
        splits = F.ceil(F.col("w") / most).cast("long")
        # as many as outweigh two pieces each
        self.hots = written(hot.groupBy("cell").agg(F.collect_list(F.struct("key", (F.lit(TOP) / splits).cast("long").alias("width"))).alias("hots")), "hots")

    def named(self, rows: DataFrame) -> DataFrame:
        """rows (key, sub, cell, any more) with hot and nth."""
        rows = only(rows, self.hots, "cell", "left")
        at = F.array_max(F.filter("hots", lambda x: x["key"] <= F.col("key")))
        nth = F.when(F.col("at.key") == F.col("key"), F.floor(F.col("sub") / F.col("at.width"))).otherwise(F.lit(TOP))
        return rows.withColumn("at", at).withColumn("hot", F.coalesce("at.key", F.lit(-1))).withColumn("nth", nth.cast("long")).drop("at", "hots")


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 1e-4) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null text: 1, with the checksum of an empty text). Law `bytes`: the shards'
    sizes differ by at most two tolerances of a shard's share and the size of a row, or of rows that are alike in
    doc_id and text, which stay together. slot numbers each shard's rows from 0 in the order of the sort.
    grown_shard is null. Columns other than doc_id and text are ignored; both may be null; an empty table has no rows.
    """
    text = F.coalesce("text", F.lit(""))
    key, sub = F.shiftrightunsigned(F.xxhash64("text"), 1), F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"), sub.alias("sub"))
    rows = written(rows, "shard-rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    bounds = cut_points(rows, [(total * j // shards, int(tolerance * total / shards)) for j in range(1, shards)], total)
    reached = lambda a, b: (F.col("key") > a) | ((F.col("key") == a) & (F.col("sub") >= b))
    shard = sum((reached(a, b).cast("int") for a, b in bounds), F.lit(0))
    # hashes are even: so many leading bits make pieces of the size that is wanted, but for the rows of one text
    bits = max(0, ceil(log2(max(1, n / PIECE_ROWS))))
    rows = rows.withColumn("cell", F.shiftright("key", KEY_BITS - bits))
    dealt = Pieces(rows, F.lit(1), PIECE_ROWS).named(rows.withColumn("shard", shard.cast("int")))
    pieces = dealt.groupBy("shard", *Pieces.NAME).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy(*Pieces.NAME)) - F.col("rows")
    dealt = only(dealt, pieces.select("shard", *Pieces.NAME, before.alias("before")), ["shard", *Pieces.NAME], "inner")
    order = Window.partitionBy("shard", *Pieces.NAME).orderBy("key", "sub", "doc_id", "size", "text_crc32")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
