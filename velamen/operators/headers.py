"""Headers and footers that pages repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_words, strip

#: Lines from a page's top and bottom that may be one; pages and share of pages that make a line one; shortest key.
ZONE, LEAST_PAGES, SHARE, LEAST_KEY = 3, 3, 0.5, 3


def line_key(line: Column) -> Column:
    """Lines with one key count as the same: numbers, case, accents and blanks do not matter."""
    return canonical_words(F.regexp_replace(F.regexp_replace(strip(line), "\\s+", " "), "[0-9]+", "#"))


def strip_headers_footers(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, lines) with the lines left in `lines`, and how many went in `removed_lines`.

    A line goes if it stands among the first or last three of its page and its key does so on half the document's pages
    or more, at least two; documents of fewer than three pages stay as they are.
    """
    lines = pages.select("doc_id", "page_no", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "line"))
    zone = (F.col("line_no") < ZONE) | (F.col("line_no") >= F.col("n") - ZONE)
    # six lines of each page at most; a key's places are those of one document
    keyed = lines.where(zone).select("doc_id", line_key(F.col("line")).alias("key"), F.struct("page_no", "line_no").alias("at"))
    repeated = keyed.groupBy("doc_id", "key").agg(F.collect_set("at").alias("at")).where(F.char_length("key") >= LEAST_KEY)
    repeated = repeated.withColumn("on_pages", F.size(F.array_distinct(F.transform("at", lambda x: x["page_no"])))).where("on_pages >= 2")
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    repeated = repeated.join(counts, "doc_id").where(F.col("on_pages") >= F.ceil(F.col("n_pages") * SHARE))
    gone = repeated.select("doc_id", F.explode("at").alias("at")).groupBy("doc_id", F.col("at.page_no").alias("page_no")).agg(F.collect_set("at.line_no").alias("gone"))
    out = pages.join(gone, ["doc_id", "page_no"], "left")
    left = F.filter("lines", lambda line, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return out.withColumn("removed_lines", F.coalesce(F.size("gone"), F.lit(0))).withColumn("removed_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.col("removed_lines"))).withColumn("lines", left).drop("gone")


def paginated(docs: DataFrame, lines: int) -> DataFrame:
    """docs (doc_id, text) as pages of so many lines: for texts that come without pages."""
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("all"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / lines).cast("int"))
    return split.select("doc_id", "all", F.explode(numbers).alias("page")).select("doc_id", (F.col("page") + 1).alias("page_no"), F.slice("all", F.col("page") * lines + 1, F.lit(lines)).alias("lines"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text: the pages' lines, in order, joined by line breaks."""
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "lines"))).alias("pages")).select("doc_id", F.array_join(F.flatten(F.transform("pages", lambda p: p["lines"])), "\n").alias("text"))
