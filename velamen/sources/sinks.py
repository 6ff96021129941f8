"""Where results go: outputs that may be handed out, the others apart, reports and JSON without values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import arrow_udf
from ..functions.vocabulary import TYPES
from ..operators.report import span_json, technical_report
from ..operators.spans import label


def rendered(text: Column) -> Column:
    """The output as Markdown: it is plain text already."""
    return text


def write_results(results: DataFrame, folder: str) -> None:
    """Outputs to `outputs`, findings of those that are withheld to `withheld`, reports to `reports`, as Parquet. A
    withheld text is written nowhere."""
    results.where("deliverable").select("doc_id", rendered(F.col("output")).alias("output")).write.mode("overwrite").parquet(f"{folder}/outputs")
    results.where("NOT deliverable").select("doc_id", "findings").write.mode("overwrite").parquet(f"{folder}/withheld")
    if {"source_sha256", "page_count"} <= set(results.columns):
        technical_report(results).write.mode("overwrite").parquet(f"{folder}/reports")


def exit_code(results: DataFrame) -> int:
    """0 if every output may be handed out, 2 if one may not."""
    return 0 if results.where("NOT deliverable").isEmpty() else 2


def analysis_json(analysis: DataFrame) -> DataFrame:
    """doc_id and the JSON that a review screen reads: the text once, spans as ranges without their values."""
    kinds = F.array(*[F.lit(name) for _, name, _ in TYPES])
    body = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("text"), kinds.alias("types"))), "\\}\\z", ""), F.lit(',"detections":'), span_json(F.col("candidates")), F.lit("}"))
    return analysis.select("doc_id", body.alias("json"))


def result_json(results: DataFrame) -> DataFrame:
    """doc_id and the JSON of a finished document: output, labels, findings without their control's name."""
    shown = F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["detail"].alias("detail"), f["output_start"].alias("outputStart"), f["output_end"].alias("outputEnd")))
    names = F.transform("labels", lambda x: F.struct(x["entity_key"].alias("entityKey"), x["label"].alias("label")))
    return results.select("doc_id", F.to_json(F.struct(F.when(F.col("deliverable"), F.col("output")).alias("markdown"), F.col("deliverable"), F.size("accepted").alias("substitutions"), names.alias("labels"), shown.alias("findings"))).alias("json"))


def listing(spans: DataFrame) -> DataFrame:
    """Spans as a person reads them: type, provenance, confidence, value, label of the type."""
    return spans.select("doc_id", "type", "provenance", F.format_string("%.2f", F.col("confidence")).alias("confidence"), "value", label(F.col("type")).alias("label"))


def run_scoped_id(value: Column, key: bytes) -> Column:
    """Eight hexadecimal digits that stand for a value within a run: HMAC-SHA-256 under the run's own key."""
    import hashlib
    import hmac

    return arrow_udf("string")(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:8])(value)
