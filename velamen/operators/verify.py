"""The gate: what in an output speaks against handing it out."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.udfs import arrow_udf
from .detect import SPANS

FINDINGS = "array<struct<control:string,severity:string,detail:string,output_start:int,output_end:int>>"
FIELDS = ("control", "severity", "detail", "output_start", "output_end")


@arrow_udf(f"struct<findings:{FINDINGS},passed:boolean,n:map<string,long>>")
def _report(output, accepted, labels, original, rejected, source):
    names = {x["entity_key"]: x["label"] for x in labels or []}
    found = K.findings(output or "", list(accepted or []), names, None if original is None else list(original), rejected or [], source or "")
    return {"findings": [dict(zip(FIELDS, f, strict=True)) for f in found], "passed": all(f[1] != "BLOCKING" for f in found), "n": list(Counter(f[0] for f in found).items())}


def verify(output: Column, accepted: Column, labels: Column, original: Column | None = None, rejected: Column | None = None, source: Column | None = None) -> Column:
    """struct(findings, passed, n: findings by control) of the controls: values that are still there as they stand (C1) or in another form (C2), parts of names
    (C3), entities without their label (C4), an empty output (C5); a single INFO row if there are none.

    original: the spans before review, whose persons count whatever type a reviewer gave them; rejected: ids of those
    that a reviewer let stand, each of which excuses one mention; source: the text that lines are counted in.
    """
    none = F.lit(None).cast(SPANS)
    return _report(output, accepted, labels, none if original is None else original, F.array().cast("array<string>") if rejected is None else rejected, F.lit("") if source is None else source)
