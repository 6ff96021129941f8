"""Queries against their SQL on texts and values that few documents hold: very long ones, and other white space."""

import duckdb
import pytest

from velamen import queries
from velamen.operators import detect


@pytest.fixture(scope="module")
def compared(spark, tmp_path_factory):
    def compare(name, texts):
        out = str(tmp_path_factory.mktemp("odd"))
        spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1).write.parquet(f"{out}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{out}/documents.parquet/*.parquet')")
        df = queries.Q[name](spark, out)
        found = con.execute(queries.SQL[name])
        order = [[c[0] for c in found.description].index(c) for c in df.columns]
        expected = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
        assert sorted((tuple(r) for r in df.collect()), key=repr) == expected

    return compare


def test_review_of_a_very_long_text(compared):
    compared("review_json", ["word " * 4_000_001 + "a@b.co", "a@b.co"])


LABELS = ["x a@" + "b." * k + "com y 612345678" for k in (1, 300, 20_000)] + ["a@" + "b.c1." * 20_000 + "com9 c@d.org"]


@pytest.mark.parametrize("name", ["verify_reformatted", "counts_by_provenance"])
def test_email_of_many_labels(compared, name):
    compared(name, LABELS)


PHONES = [f"Tel{a}{b}612345678 or 0034{b}712 345 678" for a in (" +34", "+\t34", "00 34") for b in ("\x0b", "\f", "\n", "\r", "\t", " ", ".")]


@pytest.mark.parametrize("name", ["list_spans", "occurrence_list", "entity_stats", "verify_literal"])
def test_white_space_in_a_phone(compared, name):
    compared(name, PHONES)


def test_whole_runs_take_all_white_space(spark):
    df = spark.createDataFrame([(1, "+34\x0b612345678")], "doc_id long, text string")
    assert [r["value"] for r in detect.detect(df, [detect.BY_NAME["telefono"]]).collect()] == ["+34\x0b612345678"]
