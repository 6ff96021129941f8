"""Persons: candidates by pattern in the JVM, their ends by a walk over words in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.udfs import arrow_udf
from ..functions.vocabulary import EXCLUDED_WORDS, GIVEN_NAMES
from .detect import NOT_AFTER_LETTER, PARTICLE, SPANS, matches

# Fixed values. The grammar of names and of what stands before or behind them.
SOFT_SPACE = r"(?: |\n(?!\n))+"
CUE_SPACE = r"(?:[ \t]|\n(?!\n))+"
NAME_WORD = r"(?-i:(?!Mª(?!\p{L}))\p{Lu}(?:\p{L}+|[-'’]\p{L}+)(?:[-'’]\p{L}+)*)"
LOWER_WORD = r"(?-i:\p{Ll}(?:\p{Ll}+|[-'’]\p{Ll}+)(?:[-'’]\p{Ll}+)*)"
HONORIFIC = NOT_AFTER_LETTER + r"(?:D\.ª|Dª|D\.|Sres\.|Señora|Señor|(?:Dña|Doña|Don|Srta|Sra|Sr)\.?)(?![\p{L}])"
FUNCTION_WORD = r"(?iu:seg[uú]n|conforme|ante|tras|desde|hasta|mediante|durante|contra|sobre|entre)(?!\p{L})"
ROLE = r"(?:representad[oa] por|en nombre de|a favor de|demandante|demandado)"
DOCUMENT_CUE = r"(?:con|provisto de|provista de|titular del|titular de)" + CUE_SPACE + r"(?:D\.?N\.?I\.?|N\.?I\.?F\.?|N\.?I\.?E\.?|documento)(?![\p{L}])"


def full_name(word: str) -> str:
    """Two to five words, a particle before any but the first; `Mª` may stand for a first or second word."""
    tail = f"{SOFT_SPACE}(?:{PARTICLE}{SOFT_SPACE})?{word}"
    return f"(?:Mª{SOFT_SPACE}{word}{tail}|{word}{SOFT_SPACE}Mª{tail}|{word}{tail})(?:{tail}){{0,3}}"


CUED_NAME = full_name(f"(?:{NAME_WORD}|{LOWER_WORD})")
SINGLE_NAME = f"(?!{PARTICLE}){NAME_WORD}(?![\\p{{L}}'’-])(?!{SOFT_SPACE}Mª(?!\\p{{L}}))"
GUARDED_WORD = f"(?!{FUNCTION_WORD}){NAME_WORD}"
PLAIN_NAME = NOT_AFTER_LETTER + full_name(f"(?!(?iu:{HONORIFIC})(?:{SOFT_SPACE}|$)){GUARDED_WORD}")

AFTER_HONORIFIC = f"(?iu){HONORIFIC}{CUE_SPACE}({CUED_NAME}|{SINGLE_NAME})"
BEFORE_DOCUMENT = f"(?iu)({CUED_NAME})[ \\t]*,?{CUE_SPACE}(?:mayor de edad[ \\t]*,?{CUE_SPACE})?{NOT_AFTER_LETTER}{DOCUMENT_CUE}"
AFTER_ROLE = f"(?iu){NOT_AFTER_LETTER}{ROLE}{CUE_SPACE}(?!{HONORIFIC}{CUE_SPACE})({CUED_NAME})"
CANDIDATE = f"{PLAIN_NAME}|{NOT_AFTER_LETTER}{FUNCTION_WORD}{SOFT_SPACE}(?:{PLAIN_NAME}|{GUARDED_WORD}(?!\\p{{L}}))"
#: What each structural pattern is worth, in the order in which they are asked.
CUES = [("honorific", AFTER_HONORIFIC, False, 0.95), ("document", BEFORE_DOCUMENT, True, 0.97), ("role", AFTER_ROLE, False, 0.90)]
#: What a text must have for a cue's pattern to be worth its while.
NEEDS = {"honorific": f"(?iu){HONORIFIC}{CUE_SPACE}", "document": f"(?iu){NOT_AFTER_LETTER}{DOCUMENT_CUE}", "role": f"(?iu){NOT_AFTER_LETTER}{ROLE}{CUE_SPACE}"}


#: Columns of candidates().
CANDIDATES = [*(name for name, _, _, _ in CUES), "plain"]


class Gazetteer:
    """Given names, surnames and words that are no names, in canonical form."""

    def __init__(self, given=GIVEN_NAMES, surnames=(), excluded=EXCLUDED_WORDS, more_given=()):
        forms = lambda words: frozenset(K.canonical(w) for w in words)
        self.given, self.surnames, self.excluded = forms([*given, *more_given]), forms(surnames), forms(excluded)

    def known(self, canonical: str) -> bool:
        return canonical in self.given or canonical in self.surnames


def candidates(text: Column, cued: bool = True, plain: bool = True) -> Column:
    """struct(honorific, document, role, plain): where the patterns see names, each an array of (start, value)."""
    found = [matches(text, pattern, 1, prefix, NEEDS[name]).alias(name) for name, pattern, prefix, _ in CUES] if cued else []
    return F.struct(*found, *([matches(text, CANDIDATE).alias("plain")] if plain else []))


def structural_spans(text: str, found, gazetteer: Gazetteer) -> list[dict]:
    """Spans of one text from its candidates behind or before a cue."""
    out = []
    for name, _, _, confidence in CUES:
        for c in found[name] or []:
            a = c["start"]
            if at := K.cued_name(text, a, a + len(c["value"]), name == "honorific", gazetteer.known):
                out.append(K.person_span(f"pers-{name}", *at, text, "STRUCTURAL_CUE", confidence))
    return out


def dictionary_spans(text: str, found, gazetteer: Gazetteer) -> list[dict]:
    """Spans of one text from its plain candidates."""
    out = []
    for c in found["plain"] or []:
        if x := K.dictionary_person(text, c["start"], c["start"] + len(c["value"]), gazetteer.given, gazetteer.surnames, gazetteer.excluded):
            out.append(K.person_span("pers-dic", x[0], x[1], text, "GAZETTEER", x[2]))
    return out


def structural_persons(text: Column, gazetteer: Gazetteer) -> Column:
    """Names behind a form of address or a role, or in front of an identity document."""
    return arrow_udf(SPANS)(lambda t, found: structural_spans(t or "", found, gazetteer))(text, candidates(text, plain=False))


def dictionary_persons(text: Column, gazetteer: Gazetteer) -> Column:
    """Names that begin with a known given name, or have a known surname further on."""
    return arrow_udf(SPANS)(lambda t, found: dictionary_spans(t or "", found, gazetteer))(text, candidates(text, cued=False))
