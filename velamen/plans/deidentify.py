"""The whole run: documents in, redacted texts, findings and reports out.

Everything is local to a document. One column of spans travels with the text; nothing is shuffled but by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import kernels as K
from ..functions import text as X
from ..functions.udfs import arrow_udf
from ..operators import detect, guard, headers, persons, review, verify
from ..shipping import ship


@dataclass
class Rules:
    """What a user names: always or never to be found."""

    person: list[str] = field(default_factory=list)
    organization: list[str] = field(default_factory=list)
    term: list[str] = field(default_factory=list)
    exclude_person: list[str] = field(default_factory=list)
    exclude_organization: list[str] = field(default_factory=list)
    exclude_term: list[str] = field(default_factory=list)


@arrow_udf("struct<text:string,starts:array<int>,ends:array<int>>")
def _mapped(source):
    return None if source is None else dict(zip(("text", "starts", "ends"), K.normalized(source), strict=True))


def mapped_normalization(text: Column) -> Column:
    """The text that detection reads, and where each of its characters comes from (null arrays: from its own place). Only
    texts that normalization may change leave the JVM."""
    same = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("ends"))
    return F.coalesce(_mapped(F.when(text.rlike(X.CHANGING), text)), same)


LABELS = "array<struct<entity_key:string,label:string>>"
DONE = {"labels": LABELS, "output": "string", "findings": verify.FINDINGS, "deliverable": "boolean"}


def _done(text: str, accepted: list[dict], original: list[dict] | None, rejected: list[str]) -> dict:
    """Labels, output, findings and verdict of one document."""
    labels = K.pseudonyms(accepted)
    output = K.redacted(text, accepted, labels) if accepted else text
    found = K.findings(output, accepted, labels, original, rejected, text)
    return {"labels": [{"entity_key": k, "label": v} for k, v in labels.items()], "output": output, "findings": [dict(zip(verify.FIELDS, f, strict=True)) for f in found], "deliverable": all(f[1] != "BLOCKING" for f in found)}


def _walked(docs: DataFrame, rules: Rules | None, surnames: list[str], finish: bool) -> DataFrame:
    """docs with `candidates` and, to finish, all that follows where every candidate is accepted: one pass in Arrow batches
    over what the patterns have found in the JVM."""
    rules = rules or Rules()
    gazetteer = persons.Gazetteer(surnames=surnames, more_given=rules.person)
    forms = lambda names: frozenset(K.canonical_words(n) for n in names)
    excluded = (forms(rules.exclude_person), forms(rules.exclude_organization), forms(rules.exclude_term))
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    norm = F.col("_norm.text")
    found = docs.withColumn("_norm", mapped_normalization(F.col("text")))
    found = found.withColumn("_first", detect.all_spans(norm, [*detect.DETERMINISTIC, *detect.CONTEXTUAL])).withColumn("_names", persons.candidates(norm))
    found = found.withColumn("_last", detect.all_spans(norm, [*detect.organizations(rules.organization), *detect.terms(rules.term)]))
    # texts that nothing was found in need no normal form here
    some = (F.size("_first") > 0) | (F.size("_last") > 0) | (sum(F.size(f"_names.{c}") for c in persons.CANDIDATES) > 0)
    found = found.withColumn("_norm", F.when(some, F.col("_norm")))
    more = {"candidates": detect.SPANS} | ({"accepted": detect.SPANS, "rejected": "array<string>"} | DONE if finish else {})
    kinds, kept = {name: to_arrow_type(DataType.fromDDL(kind)) for name, kind in more.items()}, docs.columns

    def spans_of(source: str, norm: dict | None, first, names, last) -> list[dict]:
        if norm is None:
            return []
        people = [*persons.structural_spans(norm["text"], names, gazetteer), *persons.dictionary_spans(norm["text"], names, gazetteer)]
        return K.analyzed(source, norm["text"], norm["starts"], norm["ends"], first, people, last, excluded)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = zip(texts, *(batch.column(c).to_pylist() for c in ("_norm", "_first", "_names", "_last")), strict=True)
            candidates = [spans_of(*row) for row in rows]
            columns = {"candidates": candidates}
            if finish:
                done = [_done(text, spans, spans, []) for text, spans in zip(texts, candidates, strict=True)]
                columns |= {"accepted": candidates, "rejected": [[]] * len(texts)} | {c: [d[c] for d in done] for c in DONE}
            own = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(columns[c], kinds[c]) for c in kinds)], names=[*kept, *kinds])

    ship(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *(StructField(name, DataType.fromDDL(kind)) for name, kind in more.items())])
    return found.mapInArrow(run, schema)


def analyze(docs: DataFrame, rules: Rules | None = None, surnames: list[str] = ()) -> DataFrame:
    """docs (doc_id, text, any more) with `candidates`: arbitrated spans in the text's own offsets. Null text is empty.

    Patterns run in the JVM over the normalized text; what depends on the whole document (names' ends, mentions,
    arbitration, the way back to the source) is one pass over the spans that they found.
    """
    return _walked(docs, rules, surnames, False)


@arrow_udf(f"struct<{','.join(f'{name}:{kind}' for name, kind in DONE.items())}>")
def _finished(text, accepted, candidates, rejected):
    return _done(text or "", accepted or [], candidates, rejected or [])


def finished(text: Column, accepted: Column, candidates: Column | None = None, rejected: Column | None = None) -> Column:
    """struct(labels, output, findings, deliverable) of a text and its accepted spans."""
    return _finished(text, accepted, F.lit(None).cast(detect.SPANS) if candidates is None else candidates, F.array().cast("array<string>") if rejected is None else rejected)


def complete(analysis: DataFrame) -> DataFrame:
    """analysis (text, candidates; after a review also accepted, rejected) with labels, output, findings, deliverable."""
    out = analysis
    if "accepted" not in out.columns:
        out = out.withColumn("accepted", review.accept_all(F.col("candidates")))
    if "rejected" not in out.columns:
        out = out.withColumn("rejected", F.array().cast("array<string>"))
    out = out.withColumn("done", finished(F.col("text"), F.col("accepted"), F.col("candidates"), F.col("rejected")))
    return out.select("*", "done.labels", "done.output", "done.findings", "done.deliverable").drop("done")


def reviewed(analysis: DataFrame, logs: DataFrame) -> DataFrame:
    """analysis with accepted and rejected from logs (doc_id, log); documents without a log are accepted as they are, one
    with an invalid log gets its `review_error` and is accepted as it is."""
    out = analysis.join(logs.select("doc_id", "log"), "doc_id", "left")
    out = out.withColumn("replay", F.when(F.col("log").isNotNull(), review.replay_review(F.col("text"), F.col("candidates"), F.col("log"))))
    out = out.withColumn("accepted", F.coalesce("replay.effective", "candidates")).withColumn("rejected", F.coalesce("replay.rejected", F.array().cast("array<string>"))).withColumn("review_error", F.col("replay.error"))
    return out.drop("replay", "log")


def deidentify(docs: DataFrame, rules: Rules | None = None, surnames: list[str] = ()) -> DataFrame:
    """docs (doc_id, text) redacted: doc_id, text, candidates, accepted, rejected, labels, output, findings, deliverable.
    The same as complete(analyze(docs)), in one pass."""
    return _walked(docs, rules, surnames, True)


def deidentify_pages(pages: DataFrame, rules: Rules | None = None, surnames: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(results, rejected) of pages (doc_id, page_no, lines, native_text): documents whose text can't be trusted are kept
    apart with their reason; headers and footers go before anything is looked for."""
    joined = headers.joined_pages(pages).join(pages.groupBy("doc_id").agg(F.bool_and("native_text").alias("native_text"), F.count("*").cast("int").alias("page_count")), "doc_id")
    checked = joined.withColumn("reason", guard.rejection(F.col("text"), F.col("native_text")))
    usable = checked.where("reason IS NULL").select("doc_id", "page_count")
    clean = headers.joined_pages(headers.strip_headers_footers(pages.select("doc_id", "page_no", "lines").join(usable, "doc_id", "left_semi")))
    return deidentify(clean.join(usable, "doc_id"), rules, surnames), checked.where("reason IS NOT NULL").select("doc_id", "reason")
