"""Persons across a document: further mentions of a name, and shorter mentions of the same person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.text import canonical, significant_tokens
from .detect import SPANS
from ..functions.udfs import arrow_udf


@arrow_udf(SPANS)
def _mentions(text, spans):
    out = [dict(s) for s in spans or []]
    for p in [s for s in out if s["type"] == "PERSON"]:
        for i, (a, b, key) in enumerate(K.propagated(text, [(p["value"], p["entity_key"])])):
            out.append({"span_id": f"prop-{p['span_id']}-{i}", "type": "PERSON", "start": a, "end": b, "value": text[a:b], "entity_key": key, "provenance": "PROPAGATED", "confidence": 0.70})
    return K.arbitrated(out)


def propagate(text: Column, spans: Column) -> Column:
    """The spans and every mention of each person among them, by its whole name, its surnames and its single words,
    arbitrated."""
    return _mentions(text, spans)


@arrow_udf(SPANS)
def _unified(spans):
    to = K.merged_keys([(s["entity_key"], s["value"]) for s in spans or [] if s["type"] == "PERSON"])
    return [{**s, "entity_key": to.get(s["entity_key"], s["entity_key"])} for s in spans or []]


def unify(spans: Column) -> Column:
    """Persons whose words are a strict subset of exactly one other person's take its key."""
    return _unified(spans)


def unique_supersets(entities: DataFrame) -> DataFrame:
    """doc_id, entity_key, merged_into for entities (doc_id, entity_key, value) whose name's words are a strict subset
    of exactly one other's in their document: the relational form of one step of unify().

    Words are the join's key, so only names that share a word meet; a name's candidates are counted, not gathered.
    """
    named = entities.select("doc_id", "entity_key", F.transform(significant_tokens(F.col("value")), canonical).alias("words")).withColumn("words", F.array_distinct("words"))
    word = named.select("doc_id", "entity_key", F.size("words").alias("n"), F.explode("words").alias("word"))
    a, b = word.alias("a"), word.alias("b")
    shared = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.n") < F.col("b.n")) & (F.col("a.entity_key") != F.col("b.entity_key")))
    shared = shared.groupBy("a.doc_id", F.col("a.entity_key").alias("entity_key"), F.col("a.n").alias("n"), F.col("b.entity_key").alias("above")).agg(F.count("*").alias("common"))
    only = shared.where("common = n").groupBy("doc_id", "entity_key").agg(F.count("*").alias("supersets"), F.min("above").alias("merged_into"))
    return only.where("supersets = 1").drop("supersets")
