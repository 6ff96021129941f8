"""Exact token counts for every context limit, from one histogram of encoded lengths."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, tuned, written
from .tokens import encode

#: Lengths of a block that running sums are formed in.
BLOCK = 512


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length, n_docs: how many rows of docs (text) have so many tokens, as a table in the shared folder: texts are
    encoded once, whatever is asked of the histogram. Null and empty texts have no tokens; repeated rows count each; an
    empty table has no lengths. Other columns are ignored."""
    tuned(docs.sparkSession)
    schema = pa.schema([("length", pa.int64()), ("n_docs", pa.int64())])

    def run(batches):
        found = Counter()
        for batch in batches:
            found.update(len(encode(x.as_py() or "", vocabulary)) for x in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], schema=schema)

    counts = docs.select("text").mapInArrow(batched(run), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    return written(counts, "lengths")


def length_totals(histogram: DataFrame) -> DataFrame:
    """For each length L of a histogram (length, n_docs), as a context limit: n_docs, docs_at_most, docs_over,
    tokens_at_most, tokens_over, truncated_total (tokens that are left when documents are cut at L), lost_tokens and
    quantile (share of documents with at most L tokens).

    Sums over blocks of lengths and sums within blocks are formed apart, so that no task needs all lengths. A histogram
    names each length once; an empty one gives no rows.
    """
    block = F.floor(F.col("length") / BLOCK)
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), block.alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    # as many rows as the longest document has blocks
    lower, every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("docs").over(lower), F.lit(0)).alias("docs_below"), F.coalesce(F.sum("toks").over(lower), F.lit(0)).alias("toks_below"), F.sum("docs").over(every).alias("docs_all"), F.sum("toks").over(every).alias("toks_all"))
    inner = Window.partitionBy("block").orderBy("length")
    out = rows.withColumn("docs_in", F.sum("n_docs").over(inner)).withColumn("toks_in", F.sum("tokens").over(inner)).join(blocks, "block")
    docs, toks = F.col("docs_below") + F.col("docs_in"), F.col("toks_below") + F.col("toks_in")
    over = F.col("docs_all") - docs
    return out.select(
        "length",
        "n_docs",
        docs.alias("docs_at_most"),
        over.alias("docs_over"),
        toks.alias("tokens_at_most"),
        (F.col("toks_all") - toks).alias("tokens_over"),
        (toks + F.col("length") * over).alias("truncated_total"),
        (F.col("toks_all") - toks - F.col("length") * over).alias("lost_tokens"),
        (docs / F.col("docs_all")).alias("quantile"),
    )


def at_limits(totals: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_total for any limits: between two lengths the lower one's sums hold. A limit below
    all lengths cuts every document."""
    last = [F.max_by(F.struct("docs_over", "tokens_at_most"), F.when(F.col("length") <= x, F.col("length"))).alias(f"at{i}") for i, x in enumerate(limits)]
    one = totals.agg(F.sum("n_docs").alias("all"), *last)
    rows = [F.struct(F.lit(x).cast("long").alias("limit"), F.coalesce(F.col(f"at{i}.docs_over"), F.col("all"), F.lit(0)).alias("docs_over"), F.coalesce(F.col(f"at{i}.tokens_at_most"), F.lit(0)).alias("below")) for i, x in enumerate(limits)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.limit", "r.docs_over", (F.col("r.below") + F.col("r.limit") * F.col("r.docs_over")).alias("truncated_total"))
