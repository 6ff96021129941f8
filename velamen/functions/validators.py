"""Checks of identifiers that have an official check digit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value. Check letters by remainder.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def cleaned(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, "[^\\p{L}\\p{Nd}]", ""))


def _letter_fits(digits: Column, letter: Column) -> Column:
    return F.substring(F.lit(CHECK_LETTERS), (digits.cast("int") % 23 + 1).cast("int"), F.lit(1)) == letter


def valid_dni(raw: Column) -> Column:
    """Eight digits and the letter of their remainder by 23."""
    c = cleaned(raw)
    return F.when(c.rlike("\\A[0-9]{8}[A-Z]\\z"), _letter_fits(F.substring(c, 1, 8), F.substring(c, 9, 1))).otherwise(False)


def valid_nie(raw: Column) -> Column:
    """X, Y or Z for 0, 1 or 2, seven digits and the letter."""
    c = cleaned(raw)
    return F.when(c.rlike("\\A[XYZ][0-9]{7}[A-Z]\\z"), _letter_fits(F.translate(F.substring(c, 1, 8), "XYZ", "012"), F.substring(c, 9, 1))).otherwise(False)


def valid_iban(raw: Column) -> Column:
    """Fifteen to 34 letters and digits, two letters first; the first four moved behind, letters as numbers, leave 1
    when divided by 97."""
    c = cleaned(raw)
    moved = F.concat(F.substring(c, F.lit(5), F.char_length(c)), F.substring(c, 1, 4))
    step = lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + F.when(x.rlike("[0-9]"), x).otherwise("0").cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step)
    return F.when(c.rlike("\\A[A-Z]{2}[A-Z0-9]{13,32}\\z"), rest == 1).otherwise(False)


def valid_postal_code(raw: Column) -> Column:
    """Five digits, the first two a province from 01 to 52."""
    c = cleaned(raw)
    return F.when(c.rlike("\\A[0-9]{5}\\z"), F.substring(c, 1, 2).cast("int").between(1, 52)).otherwise(False)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def partially_overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap in which neither range holds the other."""
    inside = ((a_start <= b_start) & (a_end >= b_end)) | ((b_start <= a_start) & (b_end >= a_end))
    return overlaps(a_start, a_end, b_start, b_end) & ~inside
