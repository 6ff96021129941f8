"""Language identification by interpolated Kneser-Ney character models.

All languages share one table a gram length: sorted 64-bit hashes of the grams any of them has, with one column of
log probabilities a language (what a language has not seen is backed off when the table is made). A gram that no
language has adds its context's back-off weights and is looked up one character shorter. A text gets the language of
the lowest cross-entropy per character. It is rejected where that cross-entropy lies far above what the language's
own texts of such a length have, as measured on sample texts that the tables were not made of.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, mix, tuned

ORDER = 5
#: Texts of a language that the model is made of, at most: a bounded sample, by the smallest hashes of doc_id.
SAMPLE = 160
#: One text in so many of the sample is kept for calibration.
CALIBRATION = 5
#: A text is rejected this far between its language's mean cross-entropy and that of evenly drawn characters, and
#: so many standard deviations of a text of its length above it.
REJECT_AT, REJECT_SPREAD = 0.5, 6.0
PAD, PREFIX_BITS = 1, 18
UNDETERMINED = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


#: Code points of texts that are scored at a time.
STEP = 1 << 17


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, one blank for each run of non-letters, behind ORDER - 1 pads a text; where
    each text begins (n + 1 values); how many letters it has."""
    pad = chr(PAD) * (ORDER - 1)
    low = [pad + x.lower() + " " for x in texts]
    at = np.cumsum([0, *map(len, low)])
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    letter[high] = [chr(c).isalpha() for c in cp[high].tolist()]
    pads = (at[:-1, None] + np.arange(ORDER - 1)).ravel()
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter is the blank
    keep[pads] = True
    cp = np.where(letter, cp, np.uint32(32))
    cp[pads] = PAD
    each = lambda x: np.add.reduceat(x, at[:-1], dtype=np.int64) if len(texts) else at[:-1]
    return cp[keep], np.concatenate([[0], np.cumsum(each(keep))]), each(letter)


def _keys(cp: np.ndarray) -> list[np.ndarray]:
    """keys[n - 1][i]: hash of the n code points that end at i."""
    salt = mix(np.arange(11, 11 + ORDER, dtype=np.uint64)) | np.uint64(1)
    sums, out = np.zeros(len(cp), np.uint64), []
    wide = cp.astype(np.uint64) + np.uint64(1)
    for j in range(ORDER):
        sums[j:] += wide[: len(cp) - j] * salt[j]
        out.append(mix(sums ^ np.uint64(j)))
    return out


@dataclass
class SortedHashes:
    """Sorted keys with a row of values each, and where each leading-bits prefix begins."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        self.first = np.searchsorted(self.keys >> np.uint64(64 - PREFIX_BITS), np.arange(1 << PREFIX_BITS, dtype=np.uint64)).astype(np.int32)
        self.ends = np.append(self.keys, np.uint64(2**64 - 1))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each wanted key, or -1."""
        i = self.first[(wanted >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)]
        behind = np.flatnonzero(self.ends[i] < wanted)
        while len(behind):
            i[behind] += 1
            behind = behind[self.ends[i[behind]] < wanted[behind]]
        return np.where((self.ends[i] == wanted) & (i < len(self.keys)), i, -1)


@dataclass
class Model:
    languages: list[str]
    grams: list[SortedHashes]
    contexts: list[SortedHashes]
    unknown: np.ndarray
    heat: float = 0.1
    limits: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean cross-entropy (texts, languages), scored characters, letters."""
        cp, at, letters = _letters(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(cp), STEP):
            hi, back = min(len(cp), lo + STEP), max(0, lo - ORDER)
            score = self._scores(cp[back:hi])[lo - back :]
            of = np.searchsorted(at, np.arange(lo, hi), "right") - 1 if len(texts) > 1 else np.zeros(hi - lo, np.int64)
            cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            sums[of[cut]] += np.add.reduceat(score, cut, axis=0, dtype=np.float64)
        n = np.diff(at) - (ORDER - 1)
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def _scores(self, cp: np.ndarray) -> np.ndarray:
        """Log probability of each code point behind those before it; pads have none."""
        keys = _keys(cp)
        score = np.zeros((len(cp), len(self.languages)), np.float32)
        todo = np.arange(len(cp))
        for n in range(ORDER, 0, -1):
            row = self.grams[n - 1].find(keys[n - 1][todo])
            hit = row >= 0
            score[todo[hit]] += self.grams[n - 1].values[row[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                row = self.contexts[n - 1].find(keys[n - 2][todo - 1])
                score[todo[row >= 0]] += self.contexts[n - 1].values[row[row >= 0]]
        score[todo] += self.unknown
        score[cp == PAD] = 0
        return score

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        entropy, n, letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp((lowest[:, None] - entropy) / self.heat).sum(axis=1)
        mean, spread, each = (x[best] for x in self.limits)
        even = np.log(len(self.grams[0].keys) + 1)
        limit = mean + np.maximum(REJECT_AT * (even - mean), 0) + REJECT_SPREAD * np.sqrt(spread**2 + each**2 / np.maximum(n, 1))
        rejected = (letters == 0) | (lowest > limit)
        language = [UNDETERMINED if k == 0 else self.languages[b] for k, b in zip(letters.tolist(), best.tolist(), strict=True)]
        return language, np.where(letters == 0, 0.0, np.clip(score, 0, 1)), np.where(letters == 0, np.nan, lowest), rejected


def train(rows: list[tuple[str, str]]) -> Model:
    """The model of (language, text) rows."""
    languages = sorted({lang for lang, _ in rows})
    size = len(languages)
    kept, aside = _parted(rows)
    cp, at, _ = _letters([text for _, text in kept])
    lang = np.repeat([languages.index(x) for x, _ in kept], np.diff(at))
    keys, real = _keys(cp), cp != PAD
    grams: list = [None] * ORDER
    unique, first, inverse = [None] * ORDER, [None] * ORDER, None
    counts: list[np.ndarray] = [None] * ORDER  # type: ignore[list-item]
    where = np.flatnonzero(real)
    for n in range(ORDER, 0, -1):
        unique[n - 1], at_first, inverse = np.unique(keys[n - 1][where], return_index=True, return_inverse=True)
        first[n - 1] = where[at_first]
        if n == ORDER:
            counts[n - 1] = np.bincount(inverse * size + lang[where], minlength=len(at_first) * size).reshape(-1, size).astype(np.float64)
        else:  # how many different characters stand before it
            suffix = np.searchsorted(unique[n - 1], keys[n - 1][first[n]])
            counts[n - 1] = np.zeros((len(at_first), size))
            np.add.at(counts[n - 1], suffix, counts[n] > 0)
    contexts: list = [None] * ORDER
    lower = None
    for n in range(1, ORDER + 1):
        c = counts[n - 1]
        once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        if n == 1:
            total, kinds = np.maximum(c.sum(axis=0), 1), (c > 0).sum(axis=0)
            floor = np.maximum(discount * kinds / total, 1e-9) / (len(c) + 1)
            p = np.maximum(c - discount, 0) / total + floor
            unknown = np.log(floor)
        else:
            held, of = np.unique(keys[n - 2][first[n - 1] - 1], return_inverse=True)
            total, kinds = np.zeros((len(held), size)), np.zeros((len(held), size))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            suffix = np.searchsorted(unique[n - 2], keys[n - 2][first[n - 1]])
            p = np.maximum(c - discount, 0) / np.maximum(total[of], 1) + back[of] * lower[suffix]
            contexts[n - 1] = SortedHashes(held, np.log(np.maximum(back, 1e-9)).astype(np.float32))
        lower = p
        grams[n - 1] = SortedHashes(unique[n - 1], np.log(p).astype(np.float32))
    model = Model(languages, grams, contexts, unknown.astype(np.float32))
    _calibrate(model, aside or rows)
    return model


def _parted(rows: list[tuple[str, str]]) -> tuple[list, list]:
    """Rows to train on and rows kept for calibration: of each language every CALIBRATION-th, so that one with fewer
    trains on all it has."""
    seen: dict[str, int] = {}
    parts: tuple[list, list] = ([], [])
    for lang, text in rows:
        seen[lang] = seen.get(lang, 0) + 1
        parts[seen[lang] % CALIBRATION == 0].append((lang, text))
    return parts


def _calibrate(model: Model, rows: list[tuple[str, str]]) -> None:
    """Sharpness of the scores, and mean and spread of each language's cross-entropy, from texts held out."""
    entropy, n, letters = model.entropies([text for _, text in rows])
    own = np.array([model.languages.index(lang) for lang, _ in rows])
    usable = letters > 0
    entropy, n, own = entropy[usable], n[usable], own[usable]
    fits = []
    for heat in (0.02, 0.05, 0.1, 0.2, 0.4):
        z = -entropy / heat
        z -= z.max(axis=1, keepdims=True)
        fits.append((-(z[np.arange(len(own)), own] - np.log(np.exp(z).sum(axis=1))).mean() if len(own) else heat, heat))
    model.heat = min(fits)[1]
    size = len(model.languages)
    mean, spread, each = np.full(size, 3.0), np.full(size, 0.5), np.full(size, 3.0)
    best = entropy.argmin(axis=1) if len(entropy) else own
    for k in range(size):
        at = (own == k) & (best == k)
        if at.sum() >= 3:
            values, lengths = entropy[at, k], n[at]
            mean[k] = np.average(values, weights=lengths)
            far = (values - mean[k]) ** 2
            long = lengths >= np.median(lengths)
            # at least a twentieth of a nat: texts differ in what they tell, too
            spread[k] = max(0.05, float(np.sqrt(far[long].mean())))
            each[k] = max(1.0, float(np.sqrt((far * lengths).mean())))
    model.limits = (mean, spread, each)


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most `sample` texts a language of docs (doc_id, text, lang), whose crc32(doc_id) mod 4 is not 2: those
    of the smallest hashes, however many rows share an id. None where no row can teach anything."""
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL AND pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) <> 2")
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return None
    # so large a share that it all but surely holds enough; of rows that are alike, or by chance too many, a task passes on
    # no more than the sample takes
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * sample / n + 20.0 / n))])
    rows = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("rank")).where(F.col("rank") <= F.element_at(share, F.col("lang")) * float(2**63))
    order = Window.partitionBy("lang").orderBy("rank", "text")
    found = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample).collect()
    return train([(r["lang"], r["text"]) for r in sorted(found, key=lambda r: (r["lang"], r["nth"]))]) if found else None


def groups(texts: list[str], most: int = 200_000):
    """Ranges of texts of about `most` characters."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= most):
            held += len(texts[b])
            b += 1
        yield a, b
        a = b


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    held_out is whether crc32 of doc_id as text, mod 4, is 2 (a null doc_id: false, and no training); only the other
    rows with a lang train. lang_pred is `und` where text is null or has no letter, and where nothing could be learned;
    score is 0 then and the row counts as rejected. Extra columns are ignored, repeated rows judged each, texts of any
    length scored whole; an empty table has no rows.
    """
    spark = docs.sparkSession
    tuned(spark)
    model = fitted(docs, sample)
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in groups(texts):
                lang, score, entropy, rejected = sent.value.judge(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("held_out").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64(), mask=np.isnan(entropy)), pa.array(rejected, pa.bool_())], schema=schema)

    return rows.mapInArrow(batched(run), "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text, lang, any more) that languages() does not reject, as they are. Where no row has a
    language to learn from, only texts without letters go; null and empty texts have none. Repeated rows are judged each,
    null ids and languages kept; an empty table stays empty."""
    spark = docs.sparkSession
    tuned(spark)
    model = fitted(docs, sample)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            keep = [~sent.value.judge(texts[a:b])[3] for a, b in groups(texts)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool), pa.bool_()))

    return docs.mapInArrow(batched(run), docs.schema)
