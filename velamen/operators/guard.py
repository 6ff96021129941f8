"""Whether an extracted text can be trusted at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vocabulary import GUARD_BLANK, GUARD_FEW, GUARD_LETTERS, GUARD_UNMAPPED, GUARD_UNRELIABLE, GUARD_USABLE

#: Characters that a usable text has at least; share of unmapped ones and of letters that it has at most and at least.
LEAST_CHARS, MOST_SUSPICIOUS, LEAST_LETTERS = 40, 0.05, 0.45


def sanity(text: Column) -> Column:
    """struct(meaningful, letters, suspicious, usable, reason) of an extracted text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\\u001C-\\u001F\\u1680\\u2000-\\u2006\\u2008-\\u200A\\u2028\\u2029\\u205F\\u3000]", "")
    n = F.char_length(bare)
    letters, odd = F.regexp_count(bare, F.lit("\\p{L}")), F.regexp_count(bare, F.lit("[\\uFFFD\\uE000-\\uF8FF\\p{Cc}]"))
    share = lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)
    reason = (
        F.when(n < LEAST_CHARS, F.concat(F.lit(GUARD_FEW[0]), n.cast("string"), F.lit(GUARD_FEW[1])))
        .when(share(odd) > MOST_SUSPICIOUS, F.concat(F.format_string("%.1f", share(odd) * 100), F.lit(GUARD_UNMAPPED)))
        .when(share(letters) < LEAST_LETTERS, F.concat(F.lit(GUARD_LETTERS[0]), F.format_string("%.1f", share(letters) * 100), F.lit(GUARD_LETTERS[1])))
        .otherwise(GUARD_USABLE)
    )
    return F.struct(n.alias("meaningful"), letters.alias("letters"), odd.alias("suspicious"), (reason == GUARD_USABLE).alias("usable"), reason.alias("reason"))


def rejection(text: Column, native: Column) -> Column:
    """Why a document is not processed; null if it is. Native text only has to hold something."""
    checked = sanity(text)
    blank = F.when(~F.coalesce(text, F.lit("")).rlike("\\S"), GUARD_BLANK)
    return F.when(native, blank).otherwise(F.when(~checked["usable"], F.concat(F.lit(GUARD_UNRELIABLE), checked["reason"])))


def needs_ocr(has_image: Column, image_coverage: Column, meaningful_chars: Column) -> Column:
    """A page with an image and next to no text, or one that images cover by half, is read as a picture."""
    return has_image & ((meaningful_chars < LEAST_CHARS) | (image_coverage >= 0.5))
