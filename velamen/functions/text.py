"""Text forms as column expressions: everything but Unicode composition stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import NAME_PARTICLES
from .udfs import arrow_udf

#: White space as ECMAScript has it: what the review screen collapses.
REVIEW_SPACE = "[\\u0009-\\u000D\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Characters of a folded text that keep their place, and what they become.
FOLD_FROM, FOLD_TO = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def _base_letters() -> tuple[str, str]:
    """Letters up to U+1FFF that Unicode decomposes into one letter and marks, and that letter."""
    pairs = []
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        parts = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(parts) == 1 and parts[0] != c and unicodedata.category(c)[0] == "L":
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


BASE_FROM, BASE_TO = _base_letters()


#: Characters from here on may change when a text is composed; no earlier one does.
COMPOSING = "[\\u0300-\\x{10FFFF}]"
#: Two single capitals side by side, as any heading written letter by letter has them.
SPACED = "(?<!\\S)\\p{Lu}[^\\S\\n\\t]+\\p{Lu}(?!\\S)"
#: What some step of normalization may change; all other texts are their own normal form.
CHANGING = (
    "\\r|[\\u0085\\u00A0\\u00AD\\u001C-\\u001F]|" + COMPOSING + "|\\p{Ll}-\\n\\p{Ll}|" + SPACED + "|[ \\t]\\n|[ \\t]{2}|\\n{3}|\\A[ \\t\\n\\x0B\\f]|[ \\t\\n\\x0B\\f]\\z"
)


@arrow_udf("string")
def _composed(text):
    return None if text is None else unicodedata.normalize("NFC", text)


def nfc(text: Column) -> Column:
    """Unicode composition; the one text form without a built-in function, so only texts that may need it leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(COMPOSING), text)), text)


def unify_line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n|\\r", "\n")


def strip_invisibles(text: Column) -> Column:
    """Soft hyphens, byte order marks and zero-width characters go; typographic spaces become plain ones."""
    return F.regexp_replace(F.regexp_replace(text, "[\\u00AD\\uFEFF\\u200B-\\u200D]", ""), "[\\u00A0\\u2000-\\u200A\\u202F]", " ")


def unify_dashes(text: Column) -> Column:
    return F.regexp_replace(text, "[\\u2010-\\u2015\\u2212]", "-")


def join_hyphenated(text: Column) -> Column:
    """Words broken at a line's end, between lower-case letters only."""
    return F.regexp_replace(text, "(\\p{Ll})-\\n(\\p{Ll})", "$1$2")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "\\A[\\s\\u001C-\\u001F]+|[\\s\\u001C-\\u001F]+\\z", "")


def join_spaced_letters(text: Column) -> Column:
    """Headings written letter by letter: cells in which at least four tokens, and three in five, are single capitals."""

    def cell(c: Column) -> Column:
        tokens = F.split(strip(c), "\\s+", -1)
        singles = F.size(F.filter(tokens, lambda t: t.rlike("\\A\\p{Lu}\\z")))
        joined = F.array_join(F.transform(F.split(strip(c), " {2,}", -1), lambda w: F.regexp_replace(w, "\\s+", "")), " ")
        return F.when((singles >= 4) & (singles >= F.size(tokens) * 0.6), joined).otherwise(c)

    # more than half of a heading's tokens are single letters, so two of them stand side by side
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.when(line.rlike(SPACED), F.array_join(F.transform(F.split(line, "\t", -1), cell), "\t")).otherwise(line))
    return F.when(text.rlike(SPACED), F.array_join(lines, "\n")).otherwise(text)


def tidy_blanks(text: Column) -> Column:
    """No blanks before line ends; a run of blanks is one, a tab if it holds a tab; at most one empty line; stripped."""
    text = F.regexp_replace(text, "[ \\t]+\\n", "\n")
    text = F.regexp_replace(F.regexp_replace(text, " *\\t[ \\t]*", "\t"), " {2,}", " ")
    return strip(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def normalize(text: Column, composed: bool = False) -> Column:
    """The form that detection reads. composed: text is known to be in composed form. Texts that no step may change are
    done with after one look."""
    plain = text if composed else nfc(text)
    changed = tidy_blanks(join_spaced_letters(join_hyphenated(unify_dashes(strip_invisibles(unify_line_endings(plain))))))
    return F.when(text.rlike(CHANGING), changed).otherwise(text)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, BASE_FROM, BASE_TO), "\\p{Mn}", "")


def canonical(text: Column) -> Column:
    """Lower-case letters and digits without accents; nothing else."""
    return F.lower(F.regexp_replace(_bare(text), "[^\\p{L}\\p{Nd}]", ""))


def canonical_words(text: Column) -> Column:
    """canonical() with one blank between words."""
    return F.trim(F.lower(F.regexp_replace(_bare(text), "[^\\p{L}\\p{Nd}]+", " ")))


def fold(text: Column) -> Column:
    """Lower case without common accents, character by character: offsets hold."""
    same = F.char_length(F.lower(text)) == F.char_length(text)
    return F.translate(F.when(same, F.lower(text)).otherwise(F.lower(F.translate(text, "İ", "i"))), FOLD_FROM, FOLD_TO)


def significant_tokens(name: Column) -> Column:
    """Words of a name that identify by themselves: two characters or more, no particles, each once."""
    words = F.filter(F.split(name, "\\s+", -1), lambda w: (F.char_length(canonical(w)) >= 2) & ~canonical(w).isin(NAME_PARTICLES))
    return F.array_distinct(words)


def surname_group(name: Column) -> Column:
    """All words but the first of a name of three or more; else null."""
    words = F.filter(F.split(name, "\\s+", -1), lambda w: w != "")
    return F.when(F.size(words) >= 3, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), " "))


def whole_word_count(text: Column, needle: str, within_cell: bool = False) -> Column:
    """How often a literal stands in text as whole words, whatever its case and accents. Between its words any blanks
    may stand, or within a cell only spaces and one line break."""
    import re

    folded = needle.strip().lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    gap = "(?: +\\n? *|\\n *)(?![\\t\\n])" if within_cell else "[ \\n\\t]+"
    pattern = gap.join(re.escape(w) for w in folded.split(" ") if w)
    return F.regexp_count(fold(text), F.lit(f"(?<![\\p{{L}}\\p{{Nd}}]){pattern}(?![\\p{{L}}\\p{{Nd}}])"))


def review_form(text: Column) -> Column:
    """White space collapsed and trimmed, as the review screen compares values."""
    return F.trim(F.regexp_replace(text, REVIEW_SPACE + "+", " "))


def json_quote(text: Column) -> Column:
    """A JSON string, control characters escaped."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), '\\A\\{"v":(.*)\\}\\z', 1)


def entity_key(kind: Column | str, value: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), canonical(value))


def line_number(text: Column, start: Column) -> Column:
    """Line that an offset lies in, from 1."""
    return F.regexp_count(F.substring(text, F.lit(1), start), F.lit("\n")) + 1


def utf16_offset(text: Column, offset: Column) -> Column:
    """An offset in code points as one in UTF-16 code units."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), offset), "UTF-16BE")) / 2).cast("int")


def download_name(name: Column, suffix: str = "-redacted.md") -> Column:
    """Name of a redacted file: the stem with a suffix, or a plain name where it can't be used."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    stem = F.when(F.locate(".", trimmed, 2) > 0, F.regexp_replace(trimmed, "\\.[^.]*\\z", "")).otherwise(trimmed)
    usable = (trimmed != "") & ~trimmed.rlike("[\\\\/\\x00-\\x1F]") & ~stem.isin("", ".", "..")
    return F.when(usable, F.concat(stem, F.lit(suffix))).otherwise(f"documento{suffix}")


def file_extension(name: Column) -> Column:
    """Lower-case extension with its dot, or nothing."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), "(\\.[^.]*)\\z", 1))


def upload_suffix(name: Column) -> Column:
    """Extension that an uploaded file's copy gets: letters and digits only, else `.bin`."""
    found = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), "(\\.[a-z0-9]{1,10})\\z", 1)
    return F.when(found == "", ".bin").otherwise(found)
