"""Span algebra: column expressions against the walks, and fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

from velamen.functions import kernels as K
from velamen.functions.vocabulary import PRIORITY
from velamen.operators import entities, report, review, spans, verify
from velamen.operators.detect import SPANS


def span(kind, a, b, value=None, key=None, name=None, provenance="REGEX"):
    return {"span_id": name or f"{kind}-{a}-{b}", "type": kind, "start": a, "end": b, "value": value or "x" * (b - a), "entity_key": key or f"{kind}:{a}", "provenance": provenance, "confidence": 0.5}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, [tuple(s.values()) for s in ss]) for i, (t, ss) in enumerate(rows)], f"doc_id long, text string, s {SPANS}").cache()


def plain(rows):
    return [[x.asDict() for x in r["x"]] for r in rows]


def test_arbitration(spark):
    r = random.Random(3)
    rows = [("", [span(r.choice(list(PRIORITY)), a := r.randint(0, 40), a + r.randint(1, 12), name=str(i)) for i in range(r.randint(0, 14))]) for _ in range(120)]
    got = plain(frame(spark, rows).select("doc_id", spans.arbitrate(F.col("s")).alias("x")).orderBy("doc_id").collect())
    assert got == [K.arbitrated(s) for _, s in rows]
    iban = frame(spark, [("", [span("PHONE", 5, 14), span("IBAN", 0, 24)])]).select(spans.arbitrate(F.col("s")).alias("x"))
    assert [s["type"] for s in iban.first()["x"]] == ["IBAN"]


def test_pseudonyms_and_redaction(spark):
    text = "Ana vio a Ana\nGil, DNI 1; Luis"
    found = [span("PERSON", 0, 3, "Ana", "p1"), span("PERSON", 10, 17, "Ana\nGil", "p1"), span("DNI", 23, 24, "1", "d1"), span("PERSON", 26, 30, "Luis", "p2")]
    r = frame(spark, [(text, found), ("", [])]).withColumn("l", spans.pseudonyms(F.col("s"))).withColumn("o", spans.redact(F.col("text"), F.col("s"), F.col("l"))).orderBy("doc_id").collect()
    assert [(x["entity_key"], x["label"]) for x in r[0]["l"]] == [("p1", "[PERSONA_001]"), ("d1", "[DNI_001]"), ("p2", "[PERSONA_002]")] and r[1]["l"] == []
    assert r[0]["o"] == "[PERSONA_001] vio a [PERSONA_001]\n, DNI [DNI_001]; [PERSONA_002]" and r[1]["o"] == ""
    assert K.redacted(text, found, K.pseudonyms(found)) == r[0]["o"]


def test_redaction_needs_labels(spark):
    df = frame(spark, [("abc", [span("DNI", 0, 1)])])
    with pytest.raises(Exception, match="without a label"):
        df.select(spans.redact(F.col("text"), F.col("s"), F.array().cast("array<struct<entity_key:string,label:string>>"))).collect()


def test_labels_grow_past_999(spark):
    found = [span("CODIGO", 2 * i, 2 * i + 1, "1", f"k{i}") for i in range(1001)]
    assert K.pseudonyms(found)["k1000"] == "[CODIGO_1001]"


def test_exclusions(spark):
    found = [span("PERSON", 0, 8, "Ana Ruíz", "p1"), span("PERSON", 9, 12, "Ana", "p1"), span("ORGANIZATION", 13, 20, "Banco  X", "o"), span("TERM", 21, 22, "T", "t"), span("DNI", 30, 39, "T", "d")]
    df = frame(spark, [("", found)])
    got = df.select(spans.exclude(F.col("s"), ["ana ruiz"], ["banco x"], ["otro"]).alias("x"))
    assert [s["type"] for s in got.first()["x"]] == ["TERM", "DNI"]
    assert K.without_excluded(found, {"ana ruiz"}, {"banco x"}, {"otro"}) == plain(got.collect())[0]


def test_effective_takes_the_outermost(spark):
    found = [span("TEXT", 2, 4, name="in"), span("TEXT", 0, 6, name="out"), span("TEXT", 0, 6, name="later"), span("TEXT", 6, 8, name="next")]
    order = F.create_map(F.lit("later"), F.lit(3))
    r = frame(spark, [("", found)]).select(spans.effective(F.col("s")).alias("a"), spans.effective(F.col("s"), order).alias("b")).first()
    assert [s["span_id"] for s in r["a"]] == ["out", "next"] and [s["span_id"] for s in r["b"]] == ["later", "next"]


def test_map_to_source(spark):
    source = "con manifesta-\nciones"
    text, starts, ends = K.normalized(source)
    df = frame(spark, [(source, [span("TERM", 4, 19, "manifestaciones")])]).withColumn("st", F.lit(starts)).withColumn("en", F.lit(ends))
    s = df.select(spans.map_to_source(F.col("s"), F.col("st"), F.col("en"), F.col("text")).alias("x")).first()["x"][0]
    assert (s["start"], s["end"], s["value"]) == (4, 21, "manifesta-\nciones")


def test_mentions_of_a_person(spark):
    text = "Juan Perez Lopez. Ana Perez Torres. Perez"
    seeds = [span("PERSON", 0, 16, "Juan Perez Lopez", "PERSON:juan perez lopez"), span("PERSON", 18, 34, "Ana Perez Torres", "PERSON:ana perez torres")]
    got = frame(spark, [(text, seeds), (text, [])]).select("doc_id", entities.propagate(F.col("text"), F.col("s")).alias("x")).orderBy("doc_id").collect()
    assert [(s["value"], s["entity_key"]) for s in got[0]["x"]][-1] == ("Perez", "PERSON:juan perez lopez") and got[1]["x"] == []


def test_shorter_mentions_merge():
    keys = lambda *names: K.merged_keys([(n, n) for n in names])
    assert keys("Juan Perez Lopez", "Perez Lopez") == {"Perez Lopez": "Juan Perez Lopez"}
    assert keys("Juan Perez Lopez", "Marta Perez Lopez", "Perez Lopez") == {}
    assert keys("Ana Gil", "Gil", "Ana Gil Ruiz") == {"Ana Gil": "Ana Gil Ruiz"}
    assert keys("Sr. Don", "Ana") == {}


def test_unique_supersets(spark):
    df = spark.createDataFrame([(1, "a", "Juan Perez Lopez"), (1, "b", "Perez Lopez"), (1, "c", "Lopez Gil"), (2, "a", "Ana Sol"), (2, "b", "Ana Luz"), (2, "c", "Ana"), (3, "a", "de la")], "doc_id long, entity_key string, value string")
    assert [tuple(r) for r in entities.unique_supersets(df).collect()] == [(1, "b", "a")]


def controls(output, accepted, labels, original=None, rejected=(), source=""):
    return [f[0][:2] for f in K.findings(output, accepted, labels, original, rejected, source) if f[1] == "BLOCKING"]


def test_the_gate_fails_when_it_must():
    dni = span("DNI", 0, 9, "12345678Z", "d")
    ana = span("PERSON", 0, 8, "Ana Ruiz", "p")
    assert controls("[DNI_001]", [dni], {"d": "[DNI_001]"}) == []
    assert controls("[DNI_001] 12345678z", [dni], {"d": "[DNI_001]"}) == ["C1", "C2"]
    assert controls("[DNI_001] 12.345.678-Z", [dni], {"d": "[DNI_001]"}) == ["C2"]
    assert controls("[PERSONA_001] y Ruiz", [ana], {"p": "[PERSONA_001]"}) == ["C3"]
    assert controls("nada", [ana], {"p": "[PERSONA_001]"}) == ["C4"] and controls("nada", [ana], {}) == ["C4"]
    assert controls(" \n", [], {}) == ["C5"]
    # a mention that a reviewer let stand is excused once
    other = span("PERSON", 20, 24, "Ruiz", "q", name="r")
    assert controls("[PERSONA_001] Ruiz", [ana], {"p": "[PERSONA_001]"}, [ana, other], ["r"]) == []
    assert controls("[PERSONA_001] Ruiz Ruiz", [ana], {"p": "[PERSONA_001]"}, [ana, other], ["r"]) == ["C3"]
    # a person within a larger accepted span still counts
    box = span("TEXT", 0, 20, "Ana Ruiz y otros más", "t")
    assert controls("[TEXTO_001] Ruiz", [box], {"t": "[TEXTO_001]"}, [ana, box]) == ["C3"]
    assert all("12345678" not in f[2] for f in K.findings("[DNI_001] 12345678z", [dni], {"d": "[DNI_001]"}))


def test_verify_column(spark):
    df = frame(spark, [("12345678Z", [span("DNI", 0, 9, "12345678Z", "d")]), ("", [])]).withColumn("l", spans.pseudonyms(F.col("s")))
    r = df.select("doc_id", verify.verify(F.col("text"), F.col("s"), F.col("l"), source=F.col("text")).alias("v")).orderBy("doc_id").collect()
    assert not r[0]["v"]["passed"] and r[0]["v"]["n"] == {"C1-VALOR-LITERAL": 1, "C2-VALOR-REFORMATEADO": 1, "C4-COBERTURA-DE-SUSTITUCION": 1}
    assert [f["control"] for f in r[1]["v"]["findings"]] == ["C5-SALIDA-NO-VACIA"]


TEXT = "Ana Ruiz llama a Ana  Ruiz. Ana Ruizo. Tel 612345678 y 6123456789. Banco Pastor, Banco Pastor_"
FOUND = [span("PERSON", 0, 8, "Ana Ruiz", "PERSON:ana ruiz", "p"), span("PHONE", 43, 52, "612345678", "PHONE:612345678", "t"), span("ORGANIZATION", 67, 79, "Banco Pastor", "organization:banco pastor", "o")]


def test_exact_occurrences():
    got = [(s["span_id"], s["value"]) for s in K.expanded(TEXT, FOUND)]
    assert got == [("p", "Ana Ruiz"), ("t", "612345678"), ("o", "Banco Pastor"), ("exact:p:17:26", "Ana  Ruiz"), ("exact:p:28:36", "Ana Ruiz")]


def test_values_that_differ_are_entities():
    found = [span("PERSON", 0, 3, "Ana", "k", "a"), span("PERSON", 4, 8, "Ruiz", "k", "b"), span("PERSON", 9, 12, "ANA", "k", "c")]
    assert [s["entity_key"] for s in K._split_by_value(found)] == ["k", "review:b", "k"]


def test_replay():
    run = lambda log: K.replayed(TEXT, FOUND, log)
    kept, gone = run("review-v1\n")
    assert [s["span_id"] for s in kept] == ["p", "exact:p:17:26", "exact:p:28:36", "t", "o"] and gone == []
    kept, gone = run("review-v1\nreject\tp\ttrue")
    assert [s["span_id"] for s in kept] == ["t", "o"] and gone == ["p", "exact:p:17:26", "exact:p:28:36"]
    assert run("review-v1\nreject\tp\ttrue\nreject\tp\tfalse") == run("review-v1\n")
    kept, _ = run("review-v1\ntype\tt\tCODIGO\ntext\tp\tAna")
    assert [(s["type"], s["value"]) for s in kept][0] == ("PERSON", "Ana") and ("CODIGO", "612345678") in [(s["type"], s["value"]) for s in kept]
    kept, _ = run("review-v1\nadd\tmanual:1\tllama%20a")
    assert ("TEXT", "llama a", "manual:1") in [(s["type"], s["value"], s["entity_key"]) for s in kept]
    kept, gone = run("t,o")
    assert gone == ["t", "o"] and all(s["type"] == "PERSON" for s in kept)


@pytest.mark.parametrize("log", ["review-v1\nreject\tp", "review-v1\nreject\tx\ttrue", "review-v1\nreject\tp\tmaybe", "review-v1\ntype\tp\tNADA", "review-v1\nadd\tmanual:0\tllama", "review-v1\nadd\tmanual:1\tno%20hay", "review-v1\ntext\tp\tTel", "review-v1\nadd\tmanual:1\ta+b", "review-v1\nwhat\tp\ttrue", "x"])
def test_invalid_logs(log):
    with pytest.raises(K.InvalidReview):
        K.replayed(TEXT, FOUND, log)


def test_replay_column(spark):
    df = frame(spark, [(TEXT, FOUND)])
    r = df.select(review.replay_review(F.col("text"), F.col("s"), F.lit("t")).alias("a"), review.replay_review(F.col("text"), F.col("s"), F.lit("review-v1\nbad")).alias("b")).first()
    assert r["a"]["rejected"] == ["t"] and r["a"]["error"] is None and r["b"]["effective"] is None and r["b"]["error"]
    assert [s["span_id"] for s in df.select(review.exact_occurrences(F.col("text"), F.col("s")).alias("x")).first()["x"]][3:] == ["exact:p:17:26", "exact:p:28:36"]


def test_reports(spark):
    text = "Ana Ruiz y Ana; DNI 12345678Z"
    found = [span("PERSON", 0, 8, "Ana Ruiz", "p"), span("PERSON", 11, 14, "Ana", "p", provenance="PROPAGATED"), span("DNI", 20, 29, "12345678Z", "d")]
    df = frame(spark, [(text, found)])
    rows = df.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")
    assert {tuple(r) for r in report.counts_by_type(rows).collect()} == {("PERSONA", 2), ("DNI", 1)}
    assert {tuple(r) for r in report.counts_by_provenance(rows).collect()} == {("REGEX", 2), ("PROPAGATED", 1)}
    stats = report.entity_stats(rows)
    assert {tuple(r) for r in stats.collect()} == {(0, "p", "PERSON", "Ana Ruiz", 2, 2), (0, "d", "DNI", "12345678Z", 1, 1)}
    assert [r["entity_key"] for r in report.sorted_entities(stats).collect()] == ["d", "p"] and [r["entity_key"] for r in report.sorted_entities(stats, "ruiz", "PERSON").collect()] == ["p"]
    assert [(r["span_id"], r["place"]) for r in report.occurrence_list(rows).where("entity_key = 'p'").orderBy("place").collect()] == [("PERSON-0-8", 1), ("PERSON-11-14", 2)]
    out = df.withColumn("kept", F.slice("s", 1, 2)).withColumn("l", spans.pseudonyms(F.col("kept"))).withColumn("o", spans.redact(F.col("text"), F.col("kept"), F.col("l")))
    r = out.select(report.compared_ranges(F.col("text"), F.col("o"), F.col("kept"), F.col("l"), F.col("s")).alias("x"), report.compared_ranges(F.col("text"), F.lit("?"), F.col("kept"), F.col("l"), F.col("s")).alias("y"), "o", report.leaked_values(F.col("o"), F.array(F.lit("ana ruiz"), F.lit("12345678z"))).alias("leak"), report.span_json(F.col("s")).alias("j")).first()
    assert [r["o"][x["start"] : x["end"]] for x in r["x"]] == ["[PERSONA_001]", "[PERSONA_001]", "12345678Z"] and r["y"] == [] and r["leak"]
    assert '"type":"DNI"' in r["j"] and "12345678Z" not in r["j"]
