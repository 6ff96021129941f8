"""Spans of a document as an array: arbitration, exclusions, pseudonyms and substitution, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import canonical_words
from ..functions.vocabulary import LABEL, PRIORITY
from .detect import SPANS


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def priority(kind: Column) -> Column:
    return _lookup(PRIORITY, kind)


def label(kind: Column) -> Column:
    return _lookup(LABEL, kind)


def by_start(spans: Column) -> Column:
    """Spans in the order of the text."""
    ranked = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("b"), s.alias("s")))
    return F.transform(F.array_sort(ranked), lambda r: r["s"])


def arbitrate(spans: Column) -> Column:
    """No two overlap: the higher priority of type wins, then the longer, then the earlier, then the one named first."""
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct((-priority(s["type"])).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), i.alias("d"), s.alias("s"))))
    taken = F.aggregate(
        ranked,
        F.array().cast(SPANS),
        lambda acc, r: F.when(F.exists(acc, lambda a: (a["start"] < r["s"]["end"]) & (r["s"]["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(r["s"]))),
    )
    return by_start(taken)


def exclude(spans: Column, people: list[str] = (), organizations: list[str] = (), terms: list[str] = ()) -> Column:
    """Without excluded spans; a person goes with all spans of its entity if one of them is excluded."""
    form = lambda values: [canonical_words(F.lit(v)) for v in values]
    named = lambda s, values: canonical_words(s["value"]).isin(*form(values)) if values else F.lit(False)
    gone = F.transform(F.filter(spans, lambda s: (s["type"] == "PERSON") & named(s, people)), lambda s: s["entity_key"])
    return F.filter(
        spans,
        lambda s: F.when(s["type"] == "PERSON", ~F.array_contains(gone, s["entity_key"])).when(s["type"] == "ORGANIZATION", ~named(s, organizations)).when(s["type"] == "TERM", ~named(s, terms)).otherwise(True),
    )


def pseudonyms(spans: Column) -> Column:
    """entity_key and label of each entity in the order of its first span; numbers count by label."""
    keys = F.array_distinct(F.transform(spans, lambda s: s["entity_key"]))
    named = F.transform(keys, lambda k: F.struct(k.alias("entity_key"), label(F.element_at(F.filter(spans, lambda s: s["entity_key"] == k), 1)["type"]).alias("kind")))

    def numbered(acc: Column, x: Column) -> Column:
        nth = F.size(F.filter(acc, lambda y: y["kind"] == x["kind"])) + 1
        return F.concat(acc, F.array(F.struct(x["entity_key"].alias("entity_key"), F.format_string("[%s_%03d]", x["kind"], nth).alias("label"), x["kind"].alias("kind"))))

    found = F.aggregate(named, F.array().cast("array<struct<entity_key:string,label:string,kind:string>>"), numbered)
    return F.transform(found, lambda x: F.struct(x["entity_key"].alias("entity_key"), x["label"].alias("label")))


def redact(text: Column, spans: Column, labels: Column, breaks: bool = True) -> Column:
    """text with each span's label in its place; line breaks of a span stay behind its label, or go if not `breaks`."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        name = F.get(F.filter(labels, lambda x: x["entity_key"] == s["entity_key"]), F.lit(0))["label"]
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        named = F.when(name.isNull(), F.raise_error(F.concat(F.lit("a span without a label: "), s["span_id"])).cast("string")).otherwise(name)
        stays = F.regexp_replace(value, "[^\\r\\n]", "") if breaks else F.lit("")
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), named, stays).alias("out"))

    return F.aggregate(by_start(spans), empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def effective(spans: Column, order: Column | None = None) -> Column:
    """Left to right, the outermost of nested spans; of equal ranges the one edited last. order: map of span_id to the
    number of its last edit."""
    edited = (lambda s: F.coalesce(F.element_at(order, s["span_id"]), F.lit(0))) if order is not None else (lambda s: F.lit(0))
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-edited(s)).alias("c"), i.alias("d"), s.alias("s"))))
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(ranked, empty, lambda acc, r: F.when(r["s"]["start"] >= acc["end"], F.struct(r["s"]["end"].alias("end"), F.concat(acc["out"], F.array(r["s"])).alias("out"))).otherwise(acc), lambda acc: acc["out"])


def map_to_source(spans: Column, starts: Column, ends: Column, source: Column) -> Column:
    """Spans of a normalized text as ranges of its source. Null starts: the text is the source."""

    def moved(s: Column) -> Column:
        a = F.when(starts.isNull(), s["start"]).otherwise(F.element_at(starts, s["start"] + 1))
        b = F.when(starts.isNull(), s["end"]).otherwise(F.element_at(ends, s["end"]))
        return F.struct(s["span_id"].alias("span_id"), s["type"].alias("type"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.substring(source, a + 1, b - a).alias("value"), s["entity_key"].alias("entity_key"), s["provenance"].alias("provenance"), s["confidence"].alias("confidence"))

    return F.transform(spans, moved)
