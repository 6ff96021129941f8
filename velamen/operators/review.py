"""Review: exact further places of a value, and the replay of a reviewer's log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K
from .detect import SPANS
from ..functions.udfs import arrow_udf


def _plain(spans) -> list[dict]:
    return [dict(s) for s in spans or []]


@arrow_udf(SPANS)
def exact_occurrences(text, spans):
    """The spans, and each further place where a value stands exactly; values that differ become entities."""
    return K.expanded(text or "", _plain(spans))


@arrow_udf(f"struct<effective:{SPANS},rejected:array<string>,error:string>")
def _replay(text, spans, log):
    try:
        kept, gone = K.replayed(text or "", _plain(spans), log or "")
        return {"effective": kept, "rejected": gone, "error": None}
    except K.InvalidReview as e:
        return {"effective": None, "rejected": None, "error": str(e)}


def replay_review(text: Column, spans: Column, log: Column) -> Column:
    """struct(effective, rejected, error) after a review log; an invalid log changes nothing and says why."""
    return _replay(text, spans, log)


def accept_all(spans: Column) -> Column:
    """The review that changes nothing."""
    return spans
