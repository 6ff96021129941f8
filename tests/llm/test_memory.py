"""The driver's JVM gives back what it has freed."""

from py4j.protocol import Py4JError

from velamen.llm import common


def test_written_tables_trim_the_driver(spark, monkeypatch):
    said = []
    trimmed = common.trimmed
    monkeypatch.setattr(common, "trimmed", lambda s: said.append(trimmed(s)))
    out = common.written(spark.range(3).toDF("doc_id"), "trim")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2]
    common.dropped(out)
    assert len(said) == 1 and (said[0] is None or "Trim native heap" in said[0])


def test_a_jvm_without_the_command(spark):
    class Without:
        def forName(self, name):
            raise Py4JError("no such command")

    class Java:
        Class = Without()

    class Session:
        class _jvm:
            class java:
                lang = Java()

        sparkContext = spark.sparkContext

    assert common.trimmed(Session()) is None
