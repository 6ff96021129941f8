"""Spans with exact offsets, and look-alikes that must not be found."""

import pytest

from velamen.operators import detect
from velamen.plans import deidentify as plan
from velamen.plans.deidentify import Rules

GOLDEN = "Documento: DNI 12345678Z; NIE X1234567L; IBAN ES9121000418450200051332; Email juan.perez@example.com; Número de cliente: ABC12345; Matrícula:1234 BCD; Teléfono:612345678; Dirección:Calle Mayor15; Código postal:28013; D. Juan Perez Lopez"
EXPECTED = [
    ("DNI", "12345678Z", 15), ("NIE", "X1234567L", 30), ("IBAN", "ES9121000418450200051332", 46), ("EMAIL", "juan.perez@example.com", 78), ("CUSTOMER_ID", "ABC12345", 121),
    ("PLATE", "1234 BCD", 141), ("PHONE", "612345678", 160), ("ADDRESS", "Calle Mayor15", 181), ("POSTAL_CODE", "28013", 210), ("PERSON", "Juan Perez Lopez", 220),
]


@pytest.fixture(scope="module")
def found(spark):
    """Arbitrated spans of a text as (type, value, start)."""

    def run(texts, rules=None, surnames=()):
        df = plan.analyze(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules, surnames)
        return [[(s["type"], s["value"], s["start"]) for s in r["candidates"]] for r in df.orderBy("doc_id").collect()]

    return run


def test_golden_sentence(found):
    assert found([GOLDEN])[0] == EXPECTED


def test_astral_characters_count_once(found):
    assert found(["😀 DNI 12345678Z"])[0] == [("DNI", "12345678Z", 6)]


NEGATIVE = [
    ("DNI12345678A", "DNI"), ("DNI12345678Z", "DNI"), ("IBAN ES9121000418450200051333", "IBAN"), ("Cliente: ABC12345", "CUSTOMER_ID"), ("28013 alone", "POSTAL_CODE"), ("Mayor 15", "ADDRESS"),
    ("D. juan", "PERSON"), ("Sradio Pérez", "PERSON"), ("1234 BCD. Xuxo Pérez", "PERSON"), ("D Xuxo Pérez", "PERSON"), ("15701 Unlisted García", "PERSON"), ("12345678 ABCD", "PLATE"), ("5551234567890123", "PHONE"),
]


def test_look_alikes(found):
    texts = [t for t, _ in NEGATIVE]
    for (text, kind), got in zip(NEGATIVE, found(texts), strict=True):
        assert kind not in [t for t, _, _ in got], text


def test_codes(found):
    texts = [
        "1234 12345 123456789012345 ABC12345Z 1234-1234", "con DNI 35.933.864, vecino de Madrid", "expedientes 12345678 y 87654321 a revisar", "importe de 12.345.678 €", "12.345.678 euros", "pasaporte PAA123456", "pasaporte AB1234567", "DNI 12345678A",
    ]
    got = [[(t, v) for t, v, _ in r] for r in found(texts)]
    assert got[0] == [("CODIGO", "12345"), ("CODIGO", "123456789012345"), ("CODIGO", "12345")]
    assert got[1] == [("CODIGO", "35.933.864")]
    assert got[2] == [("CODIGO", "12345678"), ("CODIGO", "87654321")]
    assert got[3] == [] and got[4] == []
    assert got[5] == [("PASSPORT", "PAA123456")]
    assert got[6] == [("CODIGO", "AB1234567")]
    assert got[7] == [("CODIGO", "12345678A")]


def test_identifiers_in_their_other_forms(found):
    texts = ["NIE X - 1234567L", "35.933.864-B", "IBAN ES91 2100 0418 4502 0005 1332.", "tel. +34 612 34 56 78", "correo a.b@c-d.example.org.", "C.P. 28013", "en 15707 SANTIAGO", "Carrer del Beat Oriol, 12 2B", "NÚMERO de cliente 12345"]
    got = [[(t, v) for t, v, _ in r] for r in found(texts)]
    assert got[0] == [("NIE", "X - 1234567L")]
    assert got[2] == [("IBAN", "ES91 2100 0418 4502 0005 1332")]
    assert got[3] == [("PHONE", "+34 612 34 56 78")]
    assert got[4] == [("EMAIL", "a.b@c-d.example.org")]
    assert got[5] == [("POSTAL_CODE", "28013")]
    assert got[6] == [("POSTAL_CODE", "15707")]
    assert got[7] == [("ADDRESS", "Carrer del Beat Oriol, 12 2B")]
    assert got[8] == [("CODIGO", "12345")]  # the label's capital Ú is beyond an ASCII comparison


def test_organizations_and_terms(found):
    got = found(["Banco Pastor, BANCO  POPULAR; Banco Pastoral; XBanco Pastor; Plan A+ y Plan A+B"], Rules(term=["Plan A+"], organization=["Caja Uno"]))[0]
    assert [(t, v) for t, v, _ in got] == [("ORGANIZATION", "Banco Pastor"), ("ORGANIZATION", "BANCO  POPULAR"), ("TERM", "Plan A+"), ("TERM", "Plan A+")][: len(got)]


def test_structural_persons(found):
    texts = [
        "comparece Dña. María García Pérez, mayor de edad", "Juan Ruiz Gómez, con DNI 1", "representado por Luis Martín Sáez en", "Sra. Torres firma", "D.\tAna Gil Ríos", "D. Juan Pérez\nCalle Mayor 3", "D. Juan Pérez\n\nLópez", "D. José de la Torre y Vega",
        "Sr. Nuria Mª Pérez Gil",
    ]
    got = [[v for t, v, _ in r if t == "PERSON"] for r in found(texts)]
    assert got[0] == ["María García Pérez"]
    assert got[1] == ["Juan Ruiz Gómez"]
    assert got[2] == ["Luis Martín Sáez"]
    assert got[3] == ["Torres"]
    assert got[4] == ["Ana Gil Ríos"]
    assert got[5] == ["Juan Pérez"]
    assert got[6] == ["Juan Pérez"]
    assert got[7] == ["José de la Torre y Vega"]
    assert got[8] == ["Nuria Mª Pérez Gil"]


def test_dictionary_persons(found):
    texts = ["Titular\tBrayden López Ruiz", "según Pedro Unknownname", "15707 SANTIAGO DE COMPOSTELA", "declara Ana Ruiz Molina ante", "Juzgado López Ruiz", "mediante Ruiz se"]
    got = [[v for t, v, _ in r if t == "PERSON"] for r in found(texts, surnames=["López", "Ruiz"])]
    assert got[0] == ["Brayden López Ruiz"]
    assert got[1] == ["Pedro Unknownname"]
    assert got[2] == []
    assert got[3] == ["Ana Ruiz Molina"]
    assert got[4] == []
    assert got[5] == ["Ruiz"]


def test_detect_gives_rows(spark):
    df = spark.createDataFrame([(1, "a 12345 b 67890"), (2, None), (3, "")], "doc_id long, text string")
    rows = detect.detect(df, [detect.BY_NAME["codigo"]]).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["end"], r["value"], r["entity_key"]) for r in rows] == [(1, 2, 7, "12345", "CODIGO:12345"), (1, 10, 15, "67890", "CODIGO:67890")]
