"""Detectors: regular expressions that give spans with offsets, all within the JVM.

Built-in functions give all matches of a pattern but not where they are. The pieces between the matches do: a match
begins behind all pieces and matches before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.text import canonical, entity_key
from ..functions.vocabulary import ORGANIZATIONS

SPAN = "struct<span_id:string,type:string,start:int,end:int,value:string,entity_key:string,provenance:string,confidence:double>"
SPANS = f"array<{SPAN}>"

# Fixed values. The parts of patterns that several detectors share.
LETTER_SUFFIX = r"(?:\s?-?\s?[A-Za-z])?(?![0-9A-Za-z]|[.,]\d)"
DNI_BODY = r"(?:\d{8}|\d{2}\.\d{3}\.\d{3})"
NIE_DIGITS = r"(?:\d{7}|\d\.\d{3}\.\d{3})"
NIE_BODY = r"(?:[XYZ][\s.-]?|[xyz]-?)" + NIE_DIGITS
VALIDATED_NIE_BODY = r"[XYZxyz](?:\s?-?\s?|\.)" + NIE_DIGITS
NOT_AN_AMOUNT = r"(?!\s?(?:€|(?i:eur(?:os?)?)(?![A-Za-z])))"
PARTICLE = r"(?:(?:del|de|das|dos|da|do|las|los|la|el|y|i)(?![\p{L}]))"
NOT_AFTER_LETTER = r"(?<![\p{L}.])"
STREET_WORD = r"(?:[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+|[A-ZÁÉÍÓÚÜÑ]{2,}|" + PARTICLE + ")"
NUMBER = r"(?:\s*,?\s*(?:n[ºo°]\.?\s*)?\d{1,4}[ºª]?(?:\s*[-,]?\s*\d{1,3}[ºª]?[A-Za-z]?)*)?"
STREET_TYPE = (
    NOT_AFTER_LETTER + r"(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Plza\.|Pza\.|Paseo|Camino"
    r"|Carretera|Ctra\.|Travesía|Travesia|Ronda|Glorieta|Polígono|Poligono"
    r"|Rúa|Rua|Carrer|Avinguda|Praça|Praza|Plaça|Camiño|Passeig|Travessera"
    r"|Kalea|Etorbidea|Errepidea|Urbanización|Urbanizacion|Urb\.)"
)

# Fixed values. The detectors' patterns.
DNI = r"(?<![0-9A-Za-z])" + DNI_BODY + LETTER_SUFFIX
NIE = r"(?<![0-9A-Za-z])" + VALIDATED_NIE_BODY + LETTER_SUFFIX
PASSPORT = r"(?iu)(?<![\p{L}\p{N}])(?:pasaporte|passport)(?:\s+(?:n\.?\s?[º°o]\.?|n[uú]m(?:ero|\.)?|number|nr\.?))?\s*[:#]?\s*([A-Za-z0-9]{6,9})(?![\p{L}\p{N}])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}\s?[A-Z0-9]{0,4}(?![0-9A-Za-z])"
EMAIL_LABEL, EMAIL_END = r"[A-Za-z0-9-]++\.", r"[A-Za-z]{2,}+(?![A-Za-z0-9-])"
# each step of the possessive loop goes on to the next dot that the address may end behind, so that nothing is taken back:
# Java follows (?:label)+ by recursion and fails on an address of a few thousand labels
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:(?:" + EMAIL_LABEL + f"(?!{EMAIL_END}))*+{EMAIL_LABEL}(?={EMAIL_END}))++{EMAIL_END}"
PHONE = r"(?<!\d)(?:(?:\+|00)[ \t]?34[\s.-]?)?[6789](?:[ \t.-]?\d){8}(?!\d)"
PLATE = r"(?<![0-9A-Za-z])\d{4}\s?-?\s?[BCDFGHJKLMNPRSTVWXYZ]{3}(?![0-9A-Za-z])"
DOCUMENT_CODE = r"(?<![0-9A-Za-z])(?:" + DNI_BODY + "|" + NIE_BODY + r")(?:\s?-?\s?[A-Za-z]|" + NOT_AN_AMOUNT + r")(?![0-9A-Za-z]|[.,]\d)"
CODE = r"(?<![0-9])[0-9]{5,}(?![0-9])"
CUSTOMER = r"(?i:(?:n[uú]mero|n[uú]m\.?|n[.ºo°]{1,2})\s+de\s+(?:cliente|pedido|abonado|p[oó]liza|expediente|contrato|socio))\s*[:.]?\s*([A-Z]{0,3}\d{5,20})(?![\dA-Za-z])"
POSTAL_MARKED = r"(?:C\.?\s?P\.?|[Cc][oó]digo\s+[Pp]ostal)[\s:]*(\d{5})(?!\d)"
POSTAL_CITY = r"(?<!\d)(\d{5})(?=\s+(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}|[A-ZÁÉÍÓÚÑ]{3,}))"
ADDRESS = STREET_TYPE + r"\s+" + STREET_WORD + r"(?:\s+" + STREET_WORD + "){0,5}" + NUMBER


def matches(text: Column, pattern: str, group: int = 0, prefix: bool = False, needs: str | None = None, right: str | None = None) -> Column:
    """(start, value) of all matches, or of their group 1, which must end where the match ends, or begin where it
    begins if `prefix`. needs: a cheaper pattern that every text with a match has, too. right: a character that may not
    follow a match; such a match is dropped, and the search goes on behind it. The pattern has no group 1 then."""
    if right:
        pattern = f"{pattern}(?=({right})?)"
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v")] if group else []
    values += [F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("right")] if right else []
    zipped = F.arrays_zip(whole.alias("m"), gaps.alias("gap"), *values)
    own = "v" if group else "m"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["m"])
        start = end - F.char_length(x[own]) if group and not prefix else begin
        found = F.struct(start.cast("int").alias("start"), x[own].alias("value"))
        out = F.concat(acc["out"], F.array(found))
        if right:
            out = F.when(x["right"] == "", out).otherwise(acc["out"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.cast("int").alias("at"), out.alias("out")))

    found = F.aggregate(zipped, empty, step, lambda acc: acc["out"])
    # most texts have no match: one cheap pass for them
    some = text.rlike(needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(some, found).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


@dataclass(frozen=True)
class Detector:
    """A pattern and what becomes of its matches. accepts and trim work on the value's column; needs is a simple pattern
    that every accepted match has within it, so that most texts are done with quickly; right is what matches() takes."""

    name: str
    type: str
    pattern: str
    confidence: float
    provenance: str = "REGEX"
    group: int = 0
    trim: Callable[[Column], Column] | None = None
    accepts: Callable[[Column], Column] | None = None
    key: Callable[[Column], Column] | None = None
    needs: str | None = None
    right: str | None = None

    def spans(self, text: Column) -> Column:
        found = matches(text, self.pattern, self.group, needs=self.needs, right=self.right)
        if self.trim:
            found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), self.trim(x["value"]).alias("value")))
        found = F.filter(found, lambda x: x["value"].rlike("\\S") & (self.accepts(x["value"]) if self.accepts else F.lit(True)))
        key = self.key or (lambda v: entity_key(self.type, v))

        def span(x: Column) -> Column:
            end = (x["start"] + F.char_length(x["value"])).cast("int")
            name = F.concat(F.lit(f"{self.name}-"), x["start"].cast("string"), F.lit("-"), end.cast("string"))
            return F.struct(name.alias("span_id"), F.lit(self.type).alias("type"), x["start"].alias("start"), end.alias("end"), x["value"].alias("value"), key(x["value"]).alias("entity_key"), F.lit(self.provenance).alias("provenance"), F.lit(float(self.confidence)).alias("confidence"))

        return F.transform(found, span)


def _without_word(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A lower-case letter behind blanks that does not fit the check is the next word, not a check letter."""
    return lambda v: F.when(v.rlike(r"(?s)\d\s+\p{Ll}\z") & ~check(v), F.regexp_replace(v, r"(?s)\s+\p{Ll}\z", "")).otherwise(v)


def _document(v: Column) -> Column:
    return V.valid_dni(v) | V.valid_nie(v)


def _spanish_passport(v: Column) -> Column:
    return v.rlike(r"\A[A-Z]{3}\d{6}\z")


def literal_pattern(phrase: str) -> str:
    """A phrase as whole words, whatever its case and the blanks between its words."""
    words = r"\s+".join("".join("\\" + c if re.match(r"[^\w]", c) and ord(c) < 128 else c for c in w) for w in phrase.split())
    return r"(?iu)(?<![\p{L}\p{N}_])" + words + r"(?![\p{L}\p{N}_])"


def _literal(name: str, kind: str, prefix: str, phrase: str) -> Detector:
    return Detector(name, kind, literal_pattern(phrase), 0.95, key=lambda v: F.concat(F.lit(prefix), F.lower(F.regexp_replace(v, r"\s+", " "))))


DETERMINISTIC = [
    Detector("dni", "DNI", DNI, 0.99, "CHECKSUM_VALIDATED", trim=_without_word(V.valid_dni), accepts=V.valid_dni, needs="[0-9]{3}"),
    Detector("nie", "NIE", NIE, 0.99, "CHECKSUM_VALIDATED", trim=_without_word(V.valid_nie), accepts=V.valid_nie, needs="[0-9]{3}"),
    Detector("pasaporte", "PASSPORT", PASSPORT, 0.90, group=1, accepts=_spanish_passport, needs="[0-9]{6}"),
    Detector("iban", "IBAN", IBAN, 0.99, "CHECKSUM_VALIDATED", accepts=V.valid_iban, needs="[A-Z]{2}[0-9]{2}"),
    Detector("email", "EMAIL", EMAIL, 0.95, needs="@"),
    Detector("telefono", "PHONE", PHONE, 0.80, needs="[0-9]"),
    Detector("matricula", "PLATE", PLATE, 0.85, needs="[0-9]{4}"),
    Detector("codigo-documento", "CODIGO", DOCUMENT_CODE, 0.80, trim=_without_word(_document), accepts=lambda v: ~_document(v), needs="[0-9]{3}"),
    Detector("codigo-pasaporte", "CODIGO", PASSPORT, 0.80, group=1, accepts=lambda v: v.rlike(r"\d") & ~_spanish_passport(v), needs="[0-9]"),
    Detector("codigo", "CODIGO", CODE, 0.80, needs="[0-9]{5}"),
]
CONTEXTUAL = [
    Detector("cliente", "CUSTOMER_ID", CUSTOMER, 0.90, group=1, needs="[0-9]{5}"),
    Detector("cp-marca", "POSTAL_CODE", POSTAL_MARKED, 0.70, group=1, accepts=V.valid_postal_code, needs="[0-9]{5}"),
    Detector("cp", "POSTAL_CODE", POSTAL_CITY, 0.70, group=1, accepts=V.valid_postal_code, needs="[0-9]{5}"),
    Detector("direccion", "ADDRESS", ADDRESS, 0.75),
]


def organizations(phrases: list[str] = ()) -> list[Detector]:
    if any(not p.strip() for p in phrases):
        raise ValueError("an organization needs a name")
    return [_literal("org", "ORGANIZATION", "organization:", p) for p in [*ORGANIZATIONS, *phrases]]


def terms(phrases: list[str] = ()) -> list[Detector]:
    return [_literal("term", "TERM", "term:", p) for p in phrases]


BY_NAME = {d.name: d for d in [*DETERMINISTIC, *CONTEXTUAL]}


def unretried(detector: Detector, right: str, left: str | None = None) -> Detector:
    """detector, whose pattern ends with (?!right), with one search from left to right: a match with `right` behind it is
    dropped, and the search goes on behind it. left: what the pattern lets no match begin behind, in its (?<!left) at the
    front; a match may then begin there where another one ends."""
    core = detector.pattern.replace(f"(?!{right})", "")
    if not detector.pattern.endswith(f"(?!{right})") or detector.group or left and not core.startswith(f"(?<!{left})"):
        raise ValueError("the pattern must end with what may not follow it, begin with what may not stand before it, and be the value")
    if left:
        core = f"(?:\\G|(?<!{left}))" + core.removeprefix(f"(?<!{left})")
    return replace(detector, pattern=core, right=right)


def all_spans(text: Column, detectors: list[Detector]) -> Column:
    """What all detectors find, in their order."""
    return F.concat(F.array().cast(SPANS), *[d.spans(text) for d in detectors])


def detect(docs: DataFrame, detectors: list[Detector], key: str = "doc_id") -> DataFrame:
    """One row for each span that the detectors find in docs (doc_id, text), before any arbitration."""
    found = docs.select(key, F.explode(all_spans(F.col("text"), detectors)).alias("s"))
    return found.select(key, "s.*")


__all__ = ["BY_NAME", "CONTEXTUAL", "DETERMINISTIC", "SPANS", "Detector", "all_spans", "canonical", "detect", "literal_pattern", "matches", "organizations", "terms", "unretried"]
