"""Counts, entity tables and reports over spans (doc_id, span_id, type, start, end, value, entity_key, provenance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import review_form
from .spans import label

# Fixed values. The report's wording.
TITLE = "# Informe tecnico de desidentificacion"
CAVEATS = [
    "- El resultado es un documento **desidentificado**, no anonimo. Las etiquetas mantienen distinguibles a las personas, que es lo que conserva el sentido del texto y a la vez lo que permite reidentificar por estructura.",
    "- Fechas, importes, cargos, localidades pequenas y hechos singulares permanecen intactos y pueden bastar para identificar a alguien.",
    "- La deteccion automatica no garantiza haber encontrado todo. Los falsos negativos no aparecen en este informe porque, por definicion, el sistema no sabe que existen.",
    "- Salida en texto plano: mas facil de procesar en masa que un PDF, y por tanto mas facil de correlacionar. Tratar en consecuencia.",
]


def counts_by_type(spans: DataFrame) -> DataFrame:
    return spans.groupBy(label(F.col("type")).alias("label")).agg(F.count("*").alias("n_spans"))


def counts_by_provenance(spans: DataFrame) -> DataFrame:
    return spans.groupBy("provenance").agg(F.count("*").alias("n_spans"))


def entity_stats(spans: DataFrame) -> DataFrame:
    """One row an entity: type, longest value (the first of equals), number of distinct ranges and of spans."""
    first = F.struct(-F.char_length(review_form(F.col("value"))), "start", "end")
    return spans.groupBy("doc_id", "entity_key").agg(
        F.min_by("type", F.struct("start", "end")).alias("type"),
        F.min_by("value", first).alias("best"),
        F.count_distinct(F.struct("start", "end")).alias("n_ranges"),
        F.count("*").alias("n_spans"),
    )


def sorted_entities(entities: DataFrame, search: str = "", kind: str = "") -> DataFrame:
    """Entities by type and falling count; only those whose value holds `search`, and of one type, where given."""
    found = entities
    if search.strip():
        found = found.where(F.contains(F.lower(review_form(F.col("best"))), F.lower(review_form(F.lit(search)))))
    if kind:
        found = found.where(F.col("type") == kind)
    return found.orderBy("doc_id", "type", F.desc("n_ranges"), "entity_key")


def occurrence_list(spans: DataFrame) -> DataFrame:
    """One span for each range of an entity, numbered in the order of the text."""
    same = Window.partitionBy("doc_id", "entity_key", "start", "end").orderBy("span_id")
    order = Window.partitionBy("doc_id", "entity_key").orderBy("start", "end", "span_id")
    return spans.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth").withColumn("place", F.row_number().over(order))


def output_ranges(text: Column, spans: Column, labels: Column, breaks: bool = True) -> Column:
    """Where each span's label stands in the redacted text, with the span's line breaks if `breaks`; spans in the order of
    the text, without overlaps."""
    empty = F.struct(F.lit(0).alias("shift"), F.array().cast("array<struct<span_id:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        name = F.get(F.filter(labels, lambda x: x["entity_key"] == s["entity_key"]), F.lit(0))["label"]
        stays = F.regexp_replace(F.substring(text, s["start"] + 1, s["end"] - s["start"]), "[^\\r\\n]", "") if breaks else F.lit("")
        size = F.char_length(name) + F.char_length(stays)
        begin = s["start"] + acc["shift"]
        found = F.struct(s["span_id"].alias("span_id"), begin.cast("int").alias("start"), (begin + size).cast("int").alias("end"))
        return F.struct((acc["shift"] + size - (s["end"] - s["start"])).cast("int").alias("shift"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate(spans, empty, step, lambda acc: acc["out"])


def compared_ranges(text: Column, output: Column, spans: Column, labels: Column, all_spans: Column) -> Column:
    """output_ranges(), and where spans that were not replaced now stand; empty unless the output is what spans and
    labels make of text."""
    from .spans import by_start, redact

    own = by_start(spans)
    moved = output_ranges(text, own, labels)
    outer = F.transform(F.array_sort(F.transform(all_spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s")))), lambda r: r["s"])
    apart = F.filter(outer, lambda s: ~F.exists(own, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])))

    def shifted(s: Column) -> Column:
        pairs = F.filter(F.arrays_zip(own.alias("o"), moved.alias("m")), lambda p: p["o"]["end"] <= s["start"])
        by = F.aggregate(pairs, F.lit(0), lambda acc, p: acc + p["m"]["end"] - p["m"]["start"] - p["o"]["end"] + p["o"]["start"])
        return F.struct(s["span_id"].alias("span_id"), (s["start"] + by).cast("int").alias("start"), (s["end"] + by).cast("int").alias("end"))

    stays = F.aggregate(F.transform(apart, shifted), moved, lambda acc, s: F.when(F.exists(acc, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])), acc).otherwise(F.concat(acc, F.array(s))))
    named = F.forall(own, lambda s: F.exists(labels, lambda x: x["entity_key"] == s["entity_key"]))
    ordered = F.array_sort(F.transform(stays, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["span_id"].alias("span_id"))))
    found = F.when(named, F.when(redact(text, F.when(named, own), labels) == output, ordered))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int,span_id:string>>"))


def leaked_values(edited: Column, values: Column) -> Column:
    """Whether an edited text holds one of the values of two characters or more, whatever their case and accents."""
    from ..functions.text import fold

    folded = fold(edited)
    return F.exists(values, lambda v: (F.char_length(F.trim(v)) >= 2) & F.contains(folded, fold(F.trim(v))))


def span_json(spans: Column) -> Column:
    """The spans as JSON without their values: the reader has the text."""
    return F.to_json(F.transform(spans, lambda s: F.struct(s["span_id"].alias("id"), label(s["type"]).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["entity_key"].alias("entityKey"), s["provenance"].alias("provenance"), F.round(s["confidence"], 2).alias("confidence"))))


def _table(title: str, keys: Column) -> Column:
    """A count of each key as a Markdown table."""
    kinds = F.array_sort(F.array_distinct(keys))
    rows = F.transform(kinds, lambda k: F.concat(F.lit("| "), k, F.lit(" | "), F.size(F.filter(keys, lambda x: x == k)).cast("string"), F.lit(" |\n")))
    return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(keys) == 0, "_Sin detecciones._\n\n").otherwise(F.concat(F.lit("| Clave | Recuento |\n|---|---|\n"), F.array_join(rows, ""), F.lit("\n"))))


def technical_report(results: DataFrame, version: str = "velamen 0.1.0", generated: Column | None = None) -> DataFrame:
    """doc_id and report of results (doc_id, source_sha256, page_count, accepted, labels, findings, deliverable): counts
    and controls, no values and no file names."""
    at = F.date_format(F.current_timestamp() if generated is None else generated, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n"))
    controls = F.array_join(F.transform("findings", lambda f: F.concat(F.lit("| "), f["control"], F.lit(" | "), f["severity"], F.lit(" | "), f["detail"], F.lit(" |\n"))), "")
    report = F.concat(
        F.lit(f"{TITLE}\n\n| Campo | Valor |\n|---|---|\n"),
        row("herramienta", F.lit(version)),
        row("generado", at),
        row("origen sha-256", F.concat(F.lit("`"), F.col("source_sha256"), F.lit("`"))),
        row("paginas", F.col("page_count").cast("string")),
        row("entidades distintas", F.size("labels").cast("string")),
        row("sustituciones", F.size("accepted").cast("string")),
        row("resultado", F.when(F.col("deliverable"), "**ENTREGABLE**").otherwise("**BLOQUEADO**")),
        F.lit("\n"),
        _table("Sustituciones por tipo", F.transform("accepted", lambda s: label(s["type"]))),
        _table("Candidatos por procedencia", F.transform("accepted", lambda s: s["provenance"])),
        F.lit("## Controles de verificacion\n\n| Control | Gravedad | Detalle |\n|---|---|---|\n"),
        controls,
        F.lit("\n## Limitaciones declaradas\n\n" + "\n".join(CAVEATS) + "\n"),
    )
    return results.select("doc_id", report.alias("report"))
