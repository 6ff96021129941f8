"""N-gram Jaccard self-join of documents, and the groups that its links make.

Set relations do the skipping. Equal sets share one answer. A set that links with a very similar leader takes the
leader's cluster as its answer; where links are counted, its changes against the leader give its exact overlaps with
the other sets of the cluster. The other answers come from an inverted index over prefixes (a set of n shingles can only link with one that shares one of its first
n - ceil(0.75 n) + 1, in one order of all shingles). Its lists are split into blocks by set size, and the place of a
shingle in a set bounds how large a set can be that it still links with: blocks beyond that are skipped before anything
is paired. What is left is held against exact
sizes, then bit parities, then the texts themselves; only the last step makes a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, chunks, dealt, dropped, mix, only, shingle_sets, signed, text_bytes, tuned, words, written
from .components import components

#: Shingles that the order of the index knows as frequent: those in at least HOT_LEAST sets, at most HOT_MOST of them.
HOT_LEAST, HOT_MOST = 8, 1 << 20
#: Shingles of a count bucket, on average, and the bits of a shingle that a bucket keeps.
BUCKET, KEPT_BITS = 500_000, 24
#: Shingles that a task gathers before it writes them out.
FLUSH = 1_000_000
LEADERS, PARITY_WORDS = 3, 16
#: Sizes of sets in one block of a list differ by less than this factor.
BLOCK_STEP = 1.08
#: Pairs of a set that one task holds texts for; rows of a key that are joined in one task.
PAIRS, HOT_ROWS = 200, 50_000
#: Sets of a cluster and shingles of their changes that a block of it has, about; sets compared at a time; columns of a product.
BLOCK_SETS, BLOCK_CHANGES, TILE, COLUMNS = 1024, 1 << 20, 512, 4096


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _summaries(k: int):
    """Of each document: its set's size and fingerprint, its smallest shingles in three orders, and bit parities."""
    odd = mix(np.arange(1, LEADERS + 1, dtype=np.uint64)) | np.uint64(1)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("least", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for a, b in chunks(at):
                rows = []
                for s in shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], k):
                    if len(s):
                        bits = np.bincount((s & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                        rows.append((len(s), *_fingerprint(s), [int((s * o).min().astype(np.int64)) for o in odd], np.packbits(bits.astype(np.uint8)).view(np.int64)))
                    else:
                        rows.append((0, 0, 0, None, None))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], schema=schema)

    return run


def _deal(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the leading bits) and kept key (the next ones) of a shingle."""
    return (tokens >> np.uint64(64 - bits)).astype(np.int64), ((tokens >> np.uint64(64 - bits - KEPT_BITS)) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint32)


def _counted(k: int, bits: int):
    """Distinct shingles of many sets at a time with their counts, as one row a bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("once", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def flush(sets):
        short = np.sort(np.concatenate(sets) >> np.uint64(64 - bits - KEPT_BITS))
        at = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        key, count = short[at], np.diff(np.append(at, len(short))).astype(np.uint32)
        bucket, low = (key >> np.uint64(KEPT_BITS)).astype(np.int64), (key & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint32)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        rows = []
        for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
            x, c = low[a:b], count[a:b]
            rows.append((int(bucket[a]), x[c == 1].view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), x[c > 1].tobytes(), c[c > 1].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        sets, gathered, seen = [], 0, set()
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for a, b in chunks(at):
                for s in shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], k):
                    if len(s) and (f := _fingerprint(s)) not in seen:
                        seen.add(f)
                        sets.append(s)
                        gathered += len(s)
                        if gathered >= FLUSH:
                            yield flush(sets)
                            sets, gathered, seen = [], 0, set()
        if sets:
            yield flush(sets)

    return run


def _frequent(batch: pa.Table) -> pa.Table:
    """Of one bucket the keys that at least HOT_LEAST sets have."""
    bucket = batch.column("bucket")[0].as_py()
    once = np.frombuffer(b"".join(batch.column("once").to_pylist()), np.uint8).reshape(-1, 3).astype(np.uint32)
    once = once[:, 0] | once[:, 1] << np.uint32(8) | once[:, 2] << np.uint32(16)
    keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint32)
    counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint32)
    each = np.bincount(once, minlength=1 << KEPT_BITS) if len(once) > 1 << 20 else None
    if each is not None:
        np.add.at(each, keys, counts)
        key = np.flatnonzero(each >= HOT_LEAST)
        total = each[key]
    else:
        all_keys = np.concatenate([once, keys])
        order = np.argsort(all_keys, kind="stable")
        weight = np.concatenate([np.ones(len(once), np.int64), counts.astype(np.int64)])[order]
        all_keys = all_keys[order]
        at = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(all_keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, at) if len(at) else at
        key, total = all_keys[at][total >= HOT_LEAST], total[total >= HOT_LEAST]
    return pa.table({"token": pa.array((bucket << KEPT_BITS) + key.astype(np.int64), pa.int64()), "df": pa.array(total.astype(np.int64), pa.int64())})


def _ceil_part(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _indexed(k: int, percent: int, bits: int, hot):
    """The prefix entries of every set, as one row a bucket; those of frequent shingles go to buckets by task instead."""
    schema = pa.schema([("bucket", pa.int64()), ("token", pa.binary()), ("set", pa.binary()), ("size", pa.binary()), ("place", pa.binary())])
    shift = np.uint64(64 - bits - KEPT_BITS)

    def flush(found, task):
        token, owner, size, place, level = (np.concatenate(c) for c in zip(*found, strict=True))
        bucket = np.where(level > 0, (1 << bits) + task % (1 << bits), (token >> np.uint64(64 - bits)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        bucket, parts = bucket[order], [x[order] for x in (token >> shift, owner, size, place)]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        rows = [(int(bucket[a]), *(x[a:b].tobytes() for x in parts)) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        keys, levels = hot.value
        found, gathered, seen, task = [], 0, set(), 0
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            task ^= int(at[-1])
            for a, b in chunks(at):
                for s in shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], k):
                    if not len(s) or (f := _fingerprint(s)) in seen:
                        continue
                    seen.add(f)
                    level = np.zeros(len(s), np.uint8)
                    if len(keys):
                        short = s >> shift
                        i = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                        level = np.where(keys[i] == short, levels[i], 0).astype(np.uint8)
                    p = len(s) - _ceil_part(len(s), percent) + 1
                    calm = np.flatnonzero(level == 0)[:p]
                    if len(calm) < p:
                        rest = np.flatnonzero(level)
                        calm = np.append(calm, rest[np.argsort(level[rest], kind="stable")][: p - len(calm)])
                    # sizes are rounded to blocks, places down to 256ths of the set: bounds stay bounds
                    found.append((s[calm], np.full(p, f[0], np.int64), np.full(p, _size_block(len(s)), np.uint8), (np.arange(p) * 256 // len(s)).astype(np.uint8), level[calm]))
                    gathered += p
                    if gathered >= FLUSH // 2:
                        yield flush(found, task)
                        found, gathered, seen = [], 0, set()
        if found:
            yield flush(found, task)

    return run


def _size_block(n: int) -> int:
    return min(255, int(np.log(n) / np.log(BLOCK_STEP)))


def _block_of(n) :
    """_size_block() of a column, or the next block where n is the last size before it."""
    return F.least(F.lit(255), F.floor(F.log(n) / float(np.log(BLOCK_STEP)) + 1e-6)).cast("int")


def _shared(bits: int):
    """The entries of one bucket whose shingle more than one set has; all entries of a bucket of frequent shingles."""

    def run(batch: pa.Table) -> pa.Table:
        token, owner = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in ("token", "set"))
        size, place = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("size", "place"))
        if batch.column("bucket")[0].as_py() < 1 << bits:
            order = np.lexsort((owner, token))
            token, owner, size, place = (x[order] for x in (token, owner, size, place))
            same = token[1:] == token[:-1]
            new = np.append(True, ~(same & (owner[1:] == owner[:-1])))  # a set may come from several tasks
            token, owner, size, place = (x[new] for x in (token, owner, size, place))
            same = token[1:] == token[:-1]
            keep = np.append(same, False) | np.append(False, same)
            token, owner, size, place = (x[keep] for x in (token, owner, size, place))
        return pa.table({"token": signed(token), "f": signed(owner), "block": size.astype(np.int32), "place": place.astype(np.int32)})

    return run


def _fits(percent: int, a: str = "a", b: str = "b"):
    """Links need 100 * common >= percent * union, so common >= percent * (n_a + n_b) / (100 + percent)."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    differ = sum(F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(PARITY_WORDS))
    # differing bits never outnumber the shingles that only one of the two sets has
    return F.greatest(differ, F.abs(F.col(f"{a}.n") - F.col(f"{b}.n"))) * (100 + percent) <= total * (100 - percent)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b: sets' fingerprints) that link by their texts, with the documents (x, y) that stand for them, as
    a table."""
    needed = pairs.select(F.col("a").alias("f")).unionByName(pairs.select(F.col("b").alias("f"))).distinct()
    needed = written(classes.join(needed, "f", "left_semi").select("f", F.col("cls").alias("doc_id")), "needed")
    texts = only(docs.select("doc_id", "text"), needed.select("doc_id").distinct(), "doc_id").join(needed, "doc_id")
    ends = pairs
    for key, doc, other in (("a", "x", "b"), ("b", "y", "a")):  # a set of many pairs has its text in many tasks
        counts = pairs.groupBy(key).agg(F.count("*").alias("n"))
        own = texts.select(F.col("f").alias(key), F.col("doc_id").alias(doc), F.col("text").alias(f"text_{doc}"))
        ends = dealt(ends, only(own, counts, key), [key], other, counts, PAIRS)
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            sides = [text_bytes(batch.column(c)) for c in ("text_x", "text_y")]
            keep, i = [], 0
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            for lo, hi in chunks(sides[0][1] + sides[1][1]):
                left, right = (shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k) for raw, at in sides)
                for i, (p, q) in enumerate(zip(left, right, strict=True), lo):
                    if len(p) and len(q) and _fingerprint(p)[0] == ids[0][i] and _fingerprint(q)[0] == ids[1][i]:
                        common = len(np.intersect1d(p, q, assume_unique=True))
                        if 100 * common >= percent * (len(p) + len(q) - common):
                            keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(f.name).take(rows) for f in schema], schema=schema)

    out = written(ends.select("x", "y", "a", "b", "text_x", "text_y").mapInArrow(batched(run), "x long, y long, a long, b long").distinct(), name)
    dropped(needed)
    return out


def _changes(k: int):
    """Of each set in a cluster: the shingles that it has and its leader (base of them) lacks or the other way round; r are lacking."""
    schema = pa.schema([("cluster", pa.int64()), ("f", pa.int64()), ("w", pa.int64()), ("n", pa.int64()), ("r", pa.int64()), ("base", pa.int64()), ("delta", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sides = [text_bytes(batch.column(c)) for c in ("text", "leader")]
            cluster, f, w = (batch.column(c).to_pylist() for c in ("cluster", "f", "w"))
            for lo, hi in chunks(sides[0][1] + sides[1][1]):
                own, led = (shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k) for raw, at in sides)
                rows = []
                for i, (p, q) in enumerate(zip(own, led, strict=True), lo):
                    if len(p) and len(q) and _fingerprint(p)[0] == f[i] and _fingerprint(q)[0] == cluster[i]:
                        delta = np.setxor1d(p, q, assume_unique=True)
                        rows.append((cluster[i], f[i], w[i], len(p), (len(q) + len(delta) - len(p)) // 2, len(q), signed(delta)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _common_changes(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of a has in common with each of b."""
    at_a, at_b = (np.repeat(np.arange(len(x)), [len(d) for d in x]) for x in (a, b))
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(all_a, all_b)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        part = shared[lo : lo + COLUMNS]
        sides = []
        for tokens, at, rows in ((all_a, at_a, len(a)), (all_b, at_b, len(b))):
            i = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
            hit = part[i] == tokens
            x = np.zeros((rows, len(part)), np.float32)
            x[at[hit], i[hit]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _linked(percent: int, a: tuple, b: tuple) -> np.ndarray:
    """Which sets of a and b link, both as (n, r, delta, base) against the same leader: they have base - r_a - r_b
    shingles in common, and those that both changes hold. Only pairs that sizes leave open are looked up."""
    (n_a, r_a, d_a, base), (n_b, r_b, d_b, _) = a, b
    total = (n_a[:, None] + n_b[None, :]) * percent
    need = -(-total // (100 + percent)) - (base - r_a[:, None] - r_b[None, :])
    most = np.minimum(r_a[:, None], r_b[None, :]) + np.minimum((n_a - base + r_a)[:, None], (n_b - base + r_b)[None, :])
    link = need <= 0
    unsure = ~link & (need <= most)
    x, y = np.flatnonzero(unsure.any(1)), np.flatnonzero(unsure.any(0))
    if len(x):
        at = np.ix_(x, y)
        link[at] |= unsure[at] & (_common_changes([d_a[i] for i in x], [d_b[i] for i in y]) >= need[at])
    return link


def _block_links(percent: int):
    """Of pairs of blocks of clusters (cluster, i, j): per set the weight of the sets that link with it."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        keys = ["cluster", "i", "j", "block", "f"]
        cluster, i, j, block, f, w, n, r, base = (batch.column(c).to_numpy() for c in (*keys, "w", "n", "r", "base"))
        delta = batch.column("delta").combine_chunks()
        at, tokens = delta.offsets.to_numpy(), delta.values.to_numpy()
        order = np.lexsort((f, block, j, i, cluster))
        # a text may stand in several rows
        order = order[np.append(True, np.any([np.diff(x[order]) != 0 for x in (cluster, i, j, f)], axis=0))]
        cut = np.flatnonzero(np.append(True, np.any([np.diff(x[order]) != 0 for x in (cluster, i, j)], axis=0)))
        out = np.zeros(len(f), np.int64)
        for lo, hi in zip(cut, [*cut[1:], len(order)], strict=True):
            own = order[lo:hi]
            alone = i[own[0]] == j[own[0]]
            sides = [own, own] if alone else [own[block[own] == x[own[0]]] for x in (i, j)]
            tiles = [[side[x : x + TILE] for x in range(0, len(side), TILE)] for side in sides]
            for x, a in enumerate(tiles[0]):
                for b in tiles[1][x if alone else 0 :]:
                    link = _linked(percent, *((n[s], r[s], [tokens[at[e] : at[e + 1]] for e in s], base[own[0]]) for s in (a, b)))
                    if a[0] == b[0]:
                        np.fill_diagonal(link, False)
                    else:
                        out[b] += w[a] @ link
                    out[a] += link @ w[b]
        return pa.table({"f": pa.array(f[order]), "links": pa.array(out[order])})

    return run


def _links_within(cluster: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(f, links): how many rows of other sets of its cluster link with each set. Large clusters are dealt out in pairs
    of blocks; no pair of sets is a row."""
    several = cluster.groupBy("cluster").agg(F.count("*").alias("sets")).where("sets > 1").select("cluster")
    members = cluster.join(several, "cluster", "left_semi").withColumn("own", F.lit(True))
    # where leaders have leaders, a cluster's may itself be one of another cluster's sets
    away = cluster.where("f <> cluster").join(several.select(F.col("cluster").alias("f")), "f", "left_semi").withColumn("cluster", F.col("f")).withColumn("own", F.lit(False))
    members = written(members.unionByName(away).select("cluster", "f", F.col("n_equal").alias("w"), F.col("cls").alias("doc_id"), "own"), "members")
    texts = only(docs.select("doc_id", "text"), members.select("doc_id").distinct(), "doc_id").join(members, "doc_id")
    leaders = texts.where("f = cluster").select("cluster", F.col("text").alias("leader")).distinct()
    changes = texts.where("own").join(leaders, "cluster").select("cluster", "f", "w", "text", "leader")
    changes = written(changes.mapInArrow(batched(_changes(k)), "cluster long, f long, w long, n long, r long, base long, delta array<long>"), "changes")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.size("delta")) / BLOCK_CHANGES))
    large = changes.groupBy("cluster").agg(blocks.cast("long").alias("blocks")).where("blocks > 1")
    dealt = changes.join(F.broadcast(large), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("f"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(tasks))).drop("blocks", "other")
    links = written(dealt.groupBy("task").applyInArrow(_block_links(percent), "f long, links long").groupBy("f").agg(F.sum("links").alias("links")), "within")
    dropped(members, changes)
    return links


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, n_equal (rows with the same set).

    Two documents link when 100 * |common| >= percent * |union| over their sets of distinct k-word shingles
    (50 <= percent <= 100). A text of fewer words is one shingle; null, empty or wordless texts have an empty set and
    link with nothing. component_id is the smallest doc_id reachable by links. Rows that repeat a doc_id are one
    node; a null doc_id has a null component and makes no links. Other columns are ignored.
    """
    return _joined(docs, k, percent, False)


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of jaccard_groups with n_links: the other rows with a doc_id that link with this one, equal sets among
    them. It is 0 where doc_id is null or the set is empty."""
    return _joined(docs, k, percent, True)


def _joined(docs: DataFrame, k: int, percent: int, with_links: bool) -> DataFrame:
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    tuned(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(docs.mapInArrow(batched(_summaries(k)), "doc_id long, n long, f long, g long, least array<long>, parity array<long>"), "sets")
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets are one class; what belongs to a set is the same in all its rows
    facts = [F.first(c).alias(c) for c in ("n", "least", "parity")]
    classes = written(full.groupBy("f", "g").agg(F.min("doc_id").alias("cls"), F.count("*").alias("n_equal"), *facts), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total) / BUCKET))))

    # answers taken over from leaders: of the sets with the same smallest shingle, the one with most copies
    rank = F.struct(-F.col("n_equal"), "f")
    by_least = classes.select("f", "n", "n_equal", "parity", F.posexplode("least").alias("turn", "m"))
    heads = by_least.groupBy("turn", "m").agg(F.min_by(F.struct("f", "n", "parity"), rank).alias("b"), F.count("*").alias("n")).where("n > 1")
    star = dealt(by_least.select("turn", "m", F.struct("f", "n", "parity").alias("a")), heads.drop("n"), ["turn", "m"], "a.f", heads, HOT_ROWS).where("a.f <> b.f").where(_fits(percent))
    star = written(star.groupBy(F.col("a.f").alias("a"), F.col("b.f").alias("b")).agg(F.min("turn").alias("turn")), "star")
    near = _verified(star.select("a", "b"), classes, docs, k, percent, "near")
    led = near.join(star, ["a", "b"]).groupBy(F.col("a").alias("f")).agg(F.min_by("b", "turn").alias("head"))
    led = led.join(led.select(F.col("f").alias("head"), F.col("head").alias("top")), "head", "left")  # a leader may have one itself
    cluster = classes.join(led, "f", "left").select("f", "g", "cls", "n_equal", "n", "parity", F.coalesce("top", "head", "f").alias("cluster"))
    cluster = written(cluster, "cluster")

    # one order of all shingles: those that few sets have first
    counted = docs.select("text").mapInArrow(batched(_counted(k, bits)), "bucket long, once binary, keys binary, counts binary")
    hot = written(counted.groupBy("bucket").applyInArrow(_frequent, "token long, df long"), "hot")
    level = F.floor(F.log2("df")).cast("int")
    least, held = 99, 0
    for row in hot.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if held + row["count"] > HOT_MOST:
            break
        least, held = row["level"], held + row["count"]
    known = hot.where(level >= least).select("token", level.alias("level")).toPandas().sort_values("token")
    known = spark.sparkContext.broadcast((known["token"].to_numpy(np.uint64), known["level"].to_numpy(np.uint8)))

    entries = docs.select("text").mapInArrow(batched(_indexed(k, percent, bits, known)), "bucket long, token binary, set binary, size binary, place binary")
    entries = entries.groupBy("bucket").applyInArrow(_shared(bits), "token long, f long, block int, place int")
    entries = entries_at = written(entries.join(cluster.select("f", "cluster", "n"), "f"), "entries")
    mixed = entries.groupBy("token").agg(F.min("cluster").alias("p"), F.max("cluster").alias("q")).where("p <> q").select("token")
    entries = entries.join(mixed, "token", "left_semi")

    # so many shingles remain from a common one on that the other set has `reach` at most
    rest = F.col("n") - F.floor(F.col("place") * F.col("n") / 256)
    reach = F.least(F.floor(F.col("n") * 100 / percent), F.floor(rest * (100 + percent) / percent) - F.col("n"))
    entries = entries.withColumn("reach", reach)
    blocks = F.sequence(F.col("block"), F.greatest(F.col("block"), _block_of(F.greatest("reach", F.lit(1)))))
    left = entries.select("token", F.col("block").alias("own"), F.explode(blocks).alias("block"), F.struct("f", "cluster", "n", "reach").alias("a"))
    right = entries.select("token", "block", F.struct("f", "cluster", "n", "reach").alias("b"))
    pairs = left.join(right, ["token", "block"]).where(
        ((F.col("own") < F.col("block")) | (F.col("a.cluster") < F.col("b.cluster")))
        & (F.col("a.cluster") != F.col("b.cluster"))
        & (F.col("a.n") <= F.col("b.reach"))
        & (F.col("b.n") <= F.col("a.reach"))
    )
    pairs = pairs.select(F.least("a.f", "b.f").alias("a"), F.greatest("a.f", "b.f").alias("b")).distinct()
    facts = cluster.select("f", F.struct("n", "parity").alias("of"))
    pairs = pairs.join(facts.select(F.col("f").alias("a"), F.col("of").alias("p")), "a").join(facts.select(F.col("f").alias("b"), F.col("of").alias("q")), "b")
    pairs = written(pairs.where(_fits(percent, "p", "q")).select("a", "b"), "pairs")
    links = _verified(pairs, classes, docs, k, percent, "links")

    if with_links:
        across = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(cluster.select(F.col("f").alias("b"), F.col("n_equal").alias("links")), "b")
        within = _links_within(cluster, docs, k, percent)
        links_of = written(across.select(F.col("a").alias("f"), "links").unionByName(within).groupBy("f").agg(F.sum("links").alias("links")), "links_of")
        dropped(within)

    # rows that repeat a doc_id with another text tie their classes together
    ids = full.groupBy("doc_id").agg(F.min(F.struct("f", "g")).alias("p"), F.max(F.struct("f", "g")).alias("q")).where("p <> q").select("doc_id")
    edges, repeated = links.unionByName(near).select(F.col("x").alias("a"), F.col("y").alias("b")), []
    if not ids.isEmpty():
        repeated = [written(only(full.select("doc_id", "f", "g"), ids, "doc_id").join(classes.select("f", "g", "cls"), ["f", "g"]).select("doc_id", "cls").distinct(), "repeated")]
        edges = edges.unionByName(repeated[0].join(repeated[0].groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").select("a", F.col("cls").alias("b")))
    labels = components(edges)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("f", "g", "n_equal", F.coalesce("component", "cls").alias("component"))
    # sets that very many rows share are few: they come by broadcast, so that no task gets all those rows
    named = written(named, "named")
    dropped(star, near, cluster, hot, entries_at, pairs, links, classes, *repeated)
    # a row without words has the component of the other rows of its doc_id
    bare = sets.where("n = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    bare = written(only(full.select("doc_id", "f", "g"), bare, "doc_id"), "bare")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "f", "g")
    often = named.where(F.col("n_equal") > HOT_ROWS)
    out = only(rows, often, ["f", "g"], "left")
    out = out.where("n_equal IS NOT NULL").unionByName(only(rows, often.select("f", "g"), ["f", "g"], "left_anti").join(named, ["f", "g"], "left").select(out.columns))
    if not bare.isEmpty():
        nodes = written(bare.join(named, ["f", "g"]).groupBy("doc_id").agg(F.min("component").alias("of_id")), "nodes")
        out = only(out, nodes, "doc_id", "left").withColumn("component", F.coalesce("component", "of_id"))
    dropped(bare)
    columns = ["doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal")]
    if with_links:
        n_links = F.col("n_equal") - 1 + F.coalesce("links", F.lit(0))
        out = out.join(links_of, "f", "left")
        columns.append(F.when(F.col("doc_id").isNotNull(), F.coalesce(n_links, F.lit(0))).otherwise(0).alias("n_links"))
    return out.select(*columns)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs with the row of the smallest doc_id of each of its groups, as it is. Of rows that repeat a doc_id one stays;
    rows with a null doc_id stay."""
    groups = written(jaccard_groups(docs, k, percent).select("doc_id", "component_id"), "groups")
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    left = only(docs, copies, "doc_id", "left_anti")
    again = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    again = written(again, "again")
    return only(left, again, "doc_id", "left_anti").unionByName(only(left, again, "doc_id").dropDuplicates(["doc_id"]))
