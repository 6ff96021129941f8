"""Text forms: the column expressions, the walk that keeps source ranges, and their equality."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velamen.functions import kernels as K
from velamen.functions import text as X
from velamen.functions import validators as V

CASES = [
    ("las manifesta-\nciones recogidas", "las manifestaciones recogidas"),
    ("domicilio en Vitoria-\nGasteiz, provincia", "domicilio en Vitoria-\nGasteiz, provincia"),
    ("A C T A   D E   M A N I F E S T A C I O N E S", "ACTA DE MANIFESTACIONES"),
    ("J U A N   G A R C Í A \tP É R E Z", "JUAN GARCÍA\tPÉREZ"),
    ("12345678­Z", "12345678Z"),
    ("612 345 678", "612 345 678"),
    ("12345678–Z", "12345678-Z"),
    ("primer    parrafo\n\n\n\nsegundo parrafo", "primer parrafo\n\nsegundo parrafo"),
    ("a \t b", "a\tb"),
    ("uno  \ndos\r\ntres\rcuatro", "uno\ndos\ntres\ncuatro"),
    ("él", "él"),
    ("", ""),
    ("  \n ", ""),
]


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, [a for a, _ in CASES], X.normalize) == [b for _, b in CASES]
    assert column(spark, [None], X.normalize) == [None]


def test_normalize_keeps_ranges():
    for source, expected in CASES:
        text, starts, ends = K.normalized(source)
        assert text == expected, source
        if starts is not None:
            assert len(starts) == len(ends) == len(text)
            assert all(a < b <= len(source) for a, b in zip(starts, ends))
            assert starts == sorted(starts)
    text, starts, ends = K.normalized("ver manifesta-\nciones y 😀 fin")
    a = text.index("manifestaciones")
    assert "ver manifesta-\nciones"[4:] == "ver manifesta-\nciones y 😀 fin"[starts[a] : ends[a + 14]]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aÉ B\t\n\r-­– éZ9"), max_size=40))
def test_ranges_rise_and_text_is_normal(source):
    text, starts, ends = K.normalized(source)
    if starts is not None:
        assert len(starts) == len(ends) == len(text) and starts == sorted(starts)
    assert "\r" not in text and "­" not in text and "  " not in text and "\n\n\n" not in text
    assert text == text.strip()


def test_both_normalizations_agree(spark):
    import random

    r = random.Random(5)
    alphabet = ["a", "É", "B", " ", "  ", "\t", "\n", "\n\n", "-\n", "­", "–", " ", "é", "Z", "9", "A C T A ", "\r\n"]
    values = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(400)]
    assert column(spark, values, X.normalize) == [K.normalized(v)[0] for v in values]


def test_canonical_and_fold(spark):
    values = ["García  Pérez", "GARCÍA-PÉREZ 12", "ş ễ ó Ł Ø ª", "12.345.678-Z", "", "éA", "Ñandú çÿ"]
    assert column(spark, values, X.canonical) == [K.canonical(v) for v in values]
    assert column(spark, values, X.canonical_words) == [K.canonical_words(v) for v in values]
    assert column(spark, values, X.canonical)[:2] == ["garciaperez", "garciaperez12"]
    folded = column(spark, values, X.fold)
    assert folded == [K.fold(v) for v in values] and all(len(a) == len(b) for a, b in zip(folded, values))


def test_names(spark):
    values = ["Juan de la Cruz Pérez", "Ana Gil", "Li", "María de los Ángeles Sanz"]
    assert column(spark, values, X.significant_tokens) == [K.significant_tokens(v) for v in values]
    assert column(spark, values, X.surname_group) == ["de la Cruz Pérez", None, None, "de los Ángeles Sanz"]


def test_occurrences():
    text = "Gil GIL gil Wei WEI wei Li LI li Paz PAZ paz FERNÁNDEZ fernandez A"
    at = lambda v: [text[a:b] for a, b in K.name_occurrences(text, v)]
    assert at("Gil") == ["Gil", "GIL"] and at("Li") == ["Li", "LI"] and at("Fernández") == ["FERNÁNDEZ", "fernandez"] and at("A") == []
    assert K.occurrences("Juan\tPérez Juan\n\nPérez Juan \n Pérez", "juan perez") == [(0, 10), (11, 22), (23, 35)]
    assert K.occurrences("Juan\tPérez Juan\n\nPérez Juan \n Pérez", "juan perez", within_cell=True) == [(23, 35)]
    assert K.occurrences("XPérez Pérez1 Pérez", "Pérez") == [(14, 19)]


def test_scalar_forms(spark):
    df = spark.createDataFrame([("a\nb😀c", "Informe final.docx")], "t string, n string")
    r = df.select(X.line_number(F.col("t"), F.lit(2)).alias("line"), X.utf16_offset(F.col("t"), F.lit(4)).alias("u"), X.download_name(F.col("n")).alias("d"), X.upload_suffix(F.col("n")).alias("s"), X.json_quote(F.lit('a"\n\x01')).alias("j"), X.review_form(F.lit(" a   b ")).alias("r"), X.whole_word_count(F.lit("Banco  Pastor, banco pastor, Bancos Pastor"), "Banco Pastor").alias("w")).first()
    assert (r["line"], r["u"], r["d"], r["s"], r["r"], r["w"]) == (2, 5, "Informe final-redacted.md", ".docx", "a b", 2)
    assert r["j"] == '"a\\"\\n\\u0001"'
    names = ["", ".", "..", "a/b.md", "x", ".env"]
    assert column(spark, names, X.download_name) == ["documento-redacted.md"] * 4 + ["x-redacted.md", ".env-redacted.md"]


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (V.valid_dni, ["12345678Z", "12345678-Z", "12345678 z", "00000000T"], ["12345678A", "87654321A", "1234567Z", "", "123456789"]),
        (V.valid_nie, ["X1234567L", "Y0000000Z", "Z0000000M"], ["W1234567L", "X1234567A"]),
        (V.valid_iban, ["ES9121000418450200051332", "es91 2100 0418 4502 0005 1332", "GB82WEST12345698765432"], ["ES9121000418450200051333", "ES91", "1191210004184502"]),
        (V.valid_postal_code, ["28013", "01001", "52001"], ["00123", "53001", "2801"]),
    ],
)
def test_validators(spark, check, good, bad):
    assert column(spark, [*good, *bad], check) == [True] * len(good) + [False] * len(bad)


def test_overlap_predicates(spark):
    df = spark.createDataFrame([(0, 5, 4, 9), (0, 5, 5, 9), (0, 9, 2, 4)], "a int, b int, c int, d int")
    r = df.select(V.overlaps(*map(F.col, "abcd")).alias("o"), V.partially_overlaps(*map(F.col, "abcd")).alias("p")).collect()
    assert [(x["o"], x["p"]) for x in r] == [(True, True), (False, False), (True, False)]
