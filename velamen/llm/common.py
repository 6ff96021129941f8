"""What the training-data operators share: tables, shared storage, and numpy views of Arrow text."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows up to which a key set may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Tasks that a hot key's rows are dealt out to.
SALTS = 32
#: Text bytes that numpy works on at a time.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch, so that a batch of long documents stays within a worker's memory.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches, as some documents are very long, where the session names no size of its own. The executors get
    this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a local session gets a folder of
    this machine; a cluster, whose executors would each write to their own disk, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "velamen-shared")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def trimmed(spark: SparkSession) -> str | None:
    """The driver's JVM gives native memory that it has freed back to the system, which glibc keeps else: after many large
    plans that is what compiling them took. What the JVM says; None where it has no such command."""
    java, new = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    try:
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new(java.Object, 4)
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and any executor can read it again. What dropped() has not
    deleted by then goes with the application, as plans that are returned may still read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/velamen-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._velamen_path = path
    trimmed(spark)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in tables:
        at, files = _file_system(df.sparkSession, df._velamen_path)
        files.delete(at, True)


def only(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi", spread: str | None = None) -> DataFrame:
    """Join with a key set, a semi join if nothing else is said: broadcast behind a check of its size, else shuffled.
    spread: a column of df by which a key's rows are dealt out to SALTS tasks, where keys may be hot."""
    on = [on] if isinstance(on, str) else on
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), on, how)
    if spread is None:
        return df.join(keys, on, how)
    keys = keys.withColumn("_salt", F.explode(F.lit(list(range(SALTS)))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(keys, [*on, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, keys: DataFrame, on: list[str], by: str, weights: DataFrame, most: int) -> DataFrame:
    """Inner join of df with keys, which has few rows for each value of `on`. weights (on, n) tells how many rows of df a
    value has: values with more than `most` are dealt out, by a hash of `by`, to as many tasks as it takes, and their rows
    of keys go to all of these. Such values are few, as each has so many rows."""
    hot = weights.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("_salts"))
    if hot.isEmpty():
        return df.join(keys, on)
    hot = written(hot, "hot")
    df = only(df, hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    keys = only(keys, hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return df.join(keys, [*on, "_salt"]).drop("_salt")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of whole rows of about `most` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(raw: np.ndarray, offsets: np.ndarray, marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each row with A-Z lower-cased: 64-bit hashes, byte starts, byte ends,
    and per row the index of its first word (n + 1 values). UTF-8 keeps ASCII white space out of other characters.
    Without marks, words are runs of ASCII letters and digits and of all characters beyond ASCII.

    Besides three bytes a byte of text, memory goes with the number of words: long texts are hashed in slices."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    if marks:
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    else:
        word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right")))
        hashes[a:b] = _hashed(low, starts[a:b], ends[a:b])
        a = b
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def _hashed(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word, by powers of its own length; a word of many chunks is summed chunk by chunk."""
    lengths = ends - starts
    if len(starts) == 1 and lengths[0] > CHUNK_BYTES:
        total, power, powers = 0, 1, _powers(CHUNK_BYTES + 1)
        for a in range(int(starts[0]), int(ends[0]), CHUNK_BYTES):
            part = low[a : min(a + CHUNK_BYTES, int(ends[0]))]
            total += int(((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)]).sum(dtype=np.uint64)) * power
            power = power * int(powers[CHUNK_BYTES]) % 2**64
        sums = np.array([total % 2**64], np.uint64)
    else:
        run = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(run, lengths)
        sums = np.add.reduceat((low[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place], run)
    return mix(sums ^ lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; the whole sequence where words are fewer."""
    hashes, _, _, first = words(raw, offsets)
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    n = max(0, len(hashes) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += hashes[j : j + n] * salt[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * salt[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@cache
def _libc():
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim.argtypes = [ctypes.c_size_t]
        return libc
    except (OSError, AttributeError):  # another C library
        return None


def batched(run):
    """run, for mapInArrow, with what it has freed given back to the system in the end: workers live on."""

    def wrapped(batches):
        yield from run(batches)
        if _libc() is not None:
            _libc().malloc_trim(0)

    return wrapped


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
