"""Document fingerprints by winnowing, in SQL functions only.

Every K characters in a row are one gram. Of each WINDOW consecutive grams the one with the smallest hash is kept,
the rightmost where hashes tie, with its position: two texts that share K + WINDOW - 1 characters in a row share a
kept gram. Texts with fewer grams than a window are one window, texts shorter than a gram are one gram. An empty or
null text keeps nothing.

Long texts are read in segments of windows, so that the arrays of a step stay small whatever a text's length, and
positions are full longs. Window minima are formed by doubling: of two neighbours, then of two such pairs, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written
from .sharding import Pieces, cut_points, place

K, WINDOW = 12, 32
#: Characters beyond a window's first that belong to it, less one.
REACH = K + WINDOW - 2
#: Windows of a segment; low bits of a value that hold the place in it, counted down so that the smallest is the rightmost.
SEGMENT, PLACE_BITS = 1 << 18, 24
PLACES = (1 << PLACE_BITS) - 1
#: Characters of a range of documents, about; ranges at most (larger ones beyond 2 TB); ranges that are cut by counting.
RANGE_CHARS, RANGES_MOST, COARSE = 2_000_000, 1 << 20, 256


def _let(value: Column, f) -> Column:
    """f of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _grams(piece: Column) -> Column:
    """(hash, counted-down place) of each gram, in one long."""
    grams = F.when(F.char_length(piece) >= K, F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{K}}}))."), 1)).when(F.char_length(piece) > 0, F.array(piece)).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.xxhash64(g).bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES) - i))


def _wider(values: Column, step: int) -> Column:
    """The smaller of each value and the one `step` behind it; values that run over the end only hold what is left."""
    return F.zip_with(values, F.slice(values, F.lit(step + 1), F.greatest(F.size(values), F.lit(0))), lambda x, y: F.least(x, y))


def _steps() -> list[int]:
    out, span = [], 1
    while span < WINDOW:
        out.append(min(span, WINDOW - span))
        span += out[-1]
    return out


def _different(values: Column) -> Column:
    """The different minima of whole windows, in order; a short text's only window is the first."""
    return F.array_distinct(F.slice(values, F.lit(1), F.when(F.size(values) > WINDOW, F.size(values) - (WINDOW - 1)).otherwise(1)))


def _minima(piece: Column) -> Column:
    """_different() of one segment, as one expression."""

    def walk(values: Column, steps: list[int]) -> Column:
        return _let(_wider(values, steps[0]), lambda v: walk(v, steps[1:])) if steps else _different(values)

    return _let(piece, lambda p: _let(_grams(p), lambda v: walk(v, _steps())))


def _with_kept(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the arrays `out` (40-bit hashes of the kept grams) and `out`_at (their positions).

    A text of one segment is read column by column, which compiles to faster code; longer ones segment by segment within
    one expression, so that only what is kept of a segment stays.
    """
    length = F.char_length(text)
    long = length > SEGMENT + REACH
    df = df.withColumn("_one", _grams(F.when(long, F.lit("")).otherwise(F.col(text))))
    for step in _steps():
        df = df.withColumn("_one", _wider(F.col("_one"), step))
    df = df.withColumn("_one", _different(F.col("_one")))
    segments = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(length - (REACH + 1), F.lit(0)) / SEGMENT).cast("long"))
    piece = lambda s: F.substring(F.col(text), (s * SEGMENT + 1).cast("int"), F.lit(SEGMENT + REACH))
    place_of = lambda v, s: s * SEGMENT + (F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES)))
    df = df.withColumn("_parts", F.when(long, F.transform(segments, lambda s: _minima(piece(s)))))
    # a gram that two segments keep is the last of one and the first of the next
    again = lambda p, s: (s > 0) & (place_of(F.get(p, F.lit(0)), s) == place_of(F.element_at(F.get(F.col("_parts"), s - 1), -1), s - 1))
    df = df.withColumn("_parts", F.when(long, F.transform("_parts", lambda p, s: F.when(again(p, s), F.slice(p, F.lit(2), F.size(p))).otherwise(p))))
    hashes = lambda p: F.transform(p, lambda v: F.shiftright(v, PLACE_BITS))
    df = df.withColumn(out, F.when(long, F.flatten(F.transform("_parts", hashes))).otherwise(hashes(F.col("_one"))))
    places = F.when(long, F.flatten(F.transform("_parts", lambda p, s: F.transform(p, lambda v: place_of(v, s.cast("long"))))))
    return df.withColumn(f"{out}_at", places.otherwise(F.transform("_one", lambda v: F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES))))).drop("_parts", "_one")


def _print(kept: Column) -> Column:
    """Ten hexadecimal digits for each kept hash, in the order of the text."""
    return F.lower(F.concat_ws("", F.transform(kept, lambda v: F.substring(F.hex(v.bitwiseAND(F.lit((1 << 40) - 1)).bitwiseOR(F.lit(1 << 40))), 2, 10))))


def _likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common)).cast("double")


def _neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt out in ranges of the order by doc_id and text hash, with the first document of each range
    once more behind the last of the range before (`own` is false there), and the first of all behind the last of all."""
    number = F.coalesce("doc_id", F.lit(-(2**63)))
    # both orders in numbers from 0 up: all bits of the id but the last, and that one in front of the hash
    key = F.shiftrightunsigned(number.bitwiseXOR(F.lit(-(2**63))), 1)
    sub = F.shiftleft(number.bitwiseAND(F.lit(1)), 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("text"), 2))
    docs = docs.withColumn("key", key).withColumn("sub", sub)
    sizes = written(docs.select("key", "sub", (F.char_length("text") + 1).cast("long").alias("size")), "sizes")
    total, least, most = sizes.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    total, least, most = total or 0, least or 0, most or 0
    ranges = max(16, min(RANGES_MOST, total // RANGE_CHARS))
    coarse = min(COARSE, ranges)
    fine = -(-ranges // coarse)
    bounds = cut_points(sizes, [(total * j // coarse, total // coarse // 8) for j in range(1, coarse)], total)
    # within a coarse range keys are cut evenly
    lows, highs = [least, *(min(a, most) for a, _ in bounds)], [*(min(a, most) for a, _ in bounds), most]
    array = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def celled(df: DataFrame) -> DataFrame:
        df = df.withColumn("range", place(F.col("key"), F.col("sub"), bounds))
        low, width = (F.element_at(array(x), F.col("range") + 1) for x in (lows, [max(1, -(-(b - a + 1) // fine)) for a, b in zip(lows, highs, strict=True)]))
        nth = F.floor((F.greatest(F.col("key"), low) - low) / width)
        return df.withColumn("cell", (F.col("range") * fine + F.least(nth, F.lit(fine - 1))).cast("long")).drop("range")

    sizes = celled(sizes)
    pieces = Pieces(sizes, F.col("size"), max(RANGE_CHARS, total // ranges))
    name = F.struct(*Pieces.NAME)
    firsts = pieces.named(sizes).groupBy(*Pieces.NAME).agg(F.min(F.struct("key", "sub")).alias("first"))
    # one row a piece, whose number is bounded
    order = Window.orderBy(*Pieces.NAME)
    last = F.last(name).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ghosts = firsts.select(F.col("first.key").alias("key"), F.col("first.sub").alias("sub"), F.coalesce(F.lag(name).over(order), last).alias("to"), (F.row_number().over(order) == 1).cast("int").alias("round"))

    rows = only(pieces.named(celled(docs)), written(ghosts, "ghosts"), ["key", "sub"], "left")
    own = F.struct(name.alias("piece"), F.lit(0).alias("round"), F.lit(True).alias("own"))
    ghost = F.struct(F.col("to").alias("piece"), F.col("round").alias("round"), F.lit(False).alias("own"))
    rows = rows.select("doc_id", "key", "sub", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("at"))
    return rows.select("doc_id", "key", "sub", "text", "at.piece.*", "at.round", "at.own").repartition(*Pieces.NAME)


def winnowed(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, positions.

    The edited text has its last n_chars / 4 characters (rounded down) replaced by the first as many, or all, of the
    next document: ascending doc_id, the smallest after the largest; rows that repeat a doc_id follow each other in
    the order of their texts' hashes, a null doc_id comes first. Null texts are empty. positions are those of the
    fingerprint's grams. Texts may have any length, a doc_id any number of rows; rows that are alike in both stay in one
    range. Other columns are ignored; an empty table has no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _with_kept(_neighbours(docs), "text", "kept")
    order = Window.partitionBy(*Pieces.NAME).orderBy("round", "key", "sub", ~F.col("own"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_kept", F.lead("kept").over(order)).where("own").withColumn("set", F.array_distinct("kept"))

    length = F.char_length("text")
    rows = rows.withColumn("n_chars", length.cast("long")).withColumn("keep", length - F.floor(length / 4).cast("int"))
    rows = rows.withColumn("donor", F.substring("next_text", F.lit(1), F.col("n_chars").cast("int") - F.col("keep")))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("keep")), "donor"))
    # windows that lie within the kept characters are those of the text: so many, and so many grams that they keep
    rows = rows.withColumn("cut", F.greatest(F.col("keep") - REACH, F.lit(0)))
    # the gram of place i came with the window in which it entered as the smallest, or behind the one that left before it
    came = lambda i: F.when(i == 0, F.lit(0)).when(F.get("kept", i) <= F.get("kept", i - 1), F.get("kept_at", i) - (WINDOW - 1)).otherwise(F.get("kept_at", i - 1) + 1)
    rows = rows.withColumn("before", F.size(F.filter("kept_at", lambda p: p < F.col("cut"))))
    near = F.sequence(F.col("before"), F.least(F.col("before") + WINDOW, F.size("kept")))
    rows = rows.withColumn("same", F.col("before") + F.size(F.filter(near, lambda i: (i < F.size("kept")) & (came(i) < F.col("cut")))))
    rows = rows.withColumn("rest", F.when((F.col("cut") > 0) & (F.col("donor") == ""), F.lit("")).otherwise(F.substring("edited", F.col("cut") + 1, F.length("edited"))))
    rows = _with_kept(rows, "rest", "tail")
    twice = (F.col("same") > 0) & (F.get("tail_at", F.lit(0)) + F.col("cut") == F.get("kept_at", F.col("same") - 1))
    tail = F.when(twice, F.slice("tail", F.lit(2), F.size("tail"))).otherwise(F.col("tail"))
    rows = rows.withColumn("edited_kept", F.concat(F.slice("kept", F.lit(1), F.col("same")), tail)).withColumn("edited_set", F.array_distinct("edited_kept"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        _print(F.col("kept")).alias("fingerprint"),
        _print(F.col("edited_kept")).alias("edited_fingerprint"),
        _likeness(F.col("set"), F.col("edited_set")).alias("near_edited"),
        _likeness(F.col("set"), F.array_distinct("next_kept")).alias("near_next"),
        F.col("kept_at").alias("positions"),
    )
