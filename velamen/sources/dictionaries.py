"""Dictionaries and rules as tables, and the building of dictionaries from name lists."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..plans.deidentify import Rules

# Fixed values. What a line of a rules file may begin with.
KINDS = ["person", "organization", "term", "exclude-person", "exclude-organization", "exclude-term"]


def read_dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """canonical: the distinct words of text files, plain or gzip, one a line; empty lines and `#` lines are left out."""
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("word"))
    return lines.where("word <> '' AND NOT startswith(word, '#')").select(canonical(F.col("word")).alias("canonical")).distinct()


def parse_rules(content: bytes, name: str = "rules") -> Rules:
    """Rules of a file's bytes: `kind: value`, one a line, UTF-8. The first line that is none of these is named."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError(f"Invalid UTF-8 rules file: {name}") from e
    out = Rules()
    for i, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        kind, colon, value = line.partition(":")
        if not colon or not value.startswith(" ") or not value.strip() or "\0" in value or kind not in KINDS:
            raise ValueError(f"Invalid rule at {name}:{i}; expected one of {', '.join(KINDS)} and a value")
        getattr(out, kind.replace("-", "_")).append(value.strip())
    return out


def load_rules(path: str) -> Rules:
    return parse_rules(Path(path).read_bytes(), path)


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """kind, value of every rule."""
    rows = [(k, v) for k in KINDS for v in getattr(rules, k.replace("-", "_"))]
    return spark.createDataFrame(rows, "kind string, value string")


def usable_names(names: DataFrame) -> DataFrame:
    """names (name) that are Latin letters with hyphens and apostrophes inside, two letters or more."""
    name = F.trim("name")
    fits = name.rlike("\\A\\p{IsLatin}(?:[\\p{IsLatin}'’-]*\\p{IsLatin})?\\z") & ~name.rlike("['’-]{2}") & (F.char_length(F.regexp_replace(name, "['’-]", "")) >= 2)
    return names.where(fits).withColumn("name", name)


def build_dictionary(names: DataFrame, excluded: DataFrame, least: int = 1) -> DataFrame:
    """canonical, name, n of names (name, n) that are usable, not excluded (canonical) and held by `least` or more in
    all sources together; of several spellings the first in order."""
    found = usable_names(names).withColumn("canonical", canonical(F.col("name")))
    found = found.groupBy("canonical").agg(F.min("name").alias("name"), F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.join(excluded, "canonical", "left_anti")
