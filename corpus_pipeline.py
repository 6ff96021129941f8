"""A corpus from raw documents to packed sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the one before it kept; all but the last
return the columns of documents. Their results are written as Parquet and read again.
"""

from __future__ import annotations

from velamen.llm import common, decontaminate, jaccard_join, language_id, packing, personal


def language(spark, docs, sf_dir):
    """Documents whose language can't be told go: no letters, or nothing like any language learned. Without any labelled
    document only those without letters go."""
    return language_id.accepted(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each group that links of 75 % common five-word shingles make, the document with the smallest id stays.
    Of rows that repeat an id one stays; rows without an id stay."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark, docs, sf_dir):
    """Documents that contain a benchmark item go, whatever their id."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data and secrets in texts give way to the name of their kind; null texts stay null."""
    return personal.masked(docs)


def pack(spark, docs, sf_dir):
    """Texts become pieces of sequences of 2048 tokens; a null text is one piece, the end mark."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", pack)]
#: Language models, Viterbi decoding and byte-pair encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what each keeps is written to the shared folder, read by the next, and then deleted.
    The last stage's table goes with the application. Documents with null ids, texts or languages, repeated rows, further
    columns and an empty table are treated as each stage's operator says."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.dropped(before)
        before = docs
    return docs
