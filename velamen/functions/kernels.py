"""What has no column expression: walks over words and characters of one document at a time.

Offsets are code points. Each function takes and returns plain values; the operators call them in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote

import regex

from .text import FOLD_FROM, FOLD_TO
from .vocabulary import ADDRESS_WORDS, FINDING_LINE, FINDING_PERSON, FINDINGS, LABEL, NAME_PARTICLES, PRIORITY, PROSE_VERBS

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_PARTICLES, _ADDRESS, _VERBS = frozenset(NAME_PARTICLES), frozenset(ADDRESS_WORDS), frozenset(PROSE_VERBS)
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


# --- forms


_NOT_WORD = regex.compile(r"[^\p{L}\p{Nd}]+")


def canonical(text: str) -> str:
    return _NOT_WORD.sub("", unicodedata.normalize("NFD", text)).lower()


_MARKS = regex.compile(r"\p{Mn}+")


def canonical_words(text: str) -> str:
    return _NOT_WORD.sub(" ", _MARKS.sub("", unicodedata.normalize("NFD", text))).strip(" ").lower()


def fold(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_FOLD)


_folded = lru_cache(maxsize=4)(fold)


def _word_char(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c) == "Nd"


def significant_tokens(name: str) -> list[str]:
    out = dict.fromkeys(w for w in _BLANKS.split(name) if len(canonical(w)) >= 2 and canonical(w) not in _PARTICLES)
    return list(out)


def surname_group(name: str) -> list[str]:
    words = [w for w in _BLANKS.split(name) if w]
    return [" ".join(words[1:])] if len(words) >= 3 else []


# --- normalization with the range of the source that each character comes from


def _replaced(text: str, spans: list[tuple[int, int]], pattern: regex.Pattern, change, begin: int) -> tuple[str, list[tuple[int, int]]]:
    """text with every match from `begin` on changed. A character that stays keeps its range, one that is new takes the
    place it has in the match; the first and the last of a match reach to the match's ends."""
    out, ranges, last = [], [], 0
    for m in pattern.finditer(text, begin):
        a, b = m.span()
        new = change(m.group())
        if new == m.group():
            continue
        out.append(text[last:a])
        ranges += spans[last:a]
        at, own = a, []
        for c in new:
            found = text.find(c, at, b)
            own.append(spans[found if found >= 0 else min(at, b - 1)])
            if found >= 0:
                at = found + 1
        if own:
            own[0] = (spans[a][0], own[0][1])
            own[-1] = (own[-1][0], spans[b - 1][1])
        out.append(new)
        ranges += own
        last = b
    if not last and not out:
        return text, spans
    out.append(text[last:])
    return "".join(out), ranges + spans[last:]


def _heading(cell: str) -> str:
    tokens = cell.split()
    singles = sum(len(t) == 1 and t.isupper() for t in tokens)
    if singles < 4 or singles < 0.6 * len(tokens):
        return cell
    return " ".join("".join(w.split()) for w in re.split(" {2,}", cell.strip()))


_STEPS = [
    (regex.compile("\r\n|\r"), lambda m: "\n"),
    (regex.compile("[\u00ad\ufeff\u200b-\u200d]"), lambda m: ""),
    (regex.compile("[\u00a0\u2000-\u200a\u202f]"), lambda m: " "),
    (regex.compile("[\u2010-\u2015\u2212]"), lambda m: "-"),
    (regex.compile(r"(\p{Ll})-\n(\p{Ll})"), lambda m: m[0] + m[-1]),
    (regex.compile(r"[^\n\t]+"), _heading),
    (regex.compile(r"[ \t]+\n"), lambda m: "\n"),
    (regex.compile(r"[ \t]{2,}"), lambda m: "\t" if "\t" in m else " "),
    (regex.compile(r"\n{3,}"), lambda m: "\n\n"),
]


def normalized(source: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The text that detection reads, and for each of its characters where its part of the source begins and ends;
    null arrays where the text is the source itself."""
    text, spans = source, None
    if not unicodedata.is_normalized("NFC", source):
        out, spans = [], []
        for m in regex.finditer(r"\X", source, regex.DOTALL):
            new = unicodedata.normalize("NFC", m.group())
            out.append(new)
            spans += [m.span()] * len(new)
        text = "".join(out)
    for pattern, change in _STEPS:
        if m := next((m for m in pattern.finditer(text) if change(m.group()) != m.group()), None):
            if spans is None:
                spans = [(i, i + 1) for i in range(len(text))]
            text, spans = _replaced(text, spans, pattern, change, m.start())
    blank = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
    a, b = len(text) - len(text.lstrip(blank)), len(text.rstrip(blank))
    if spans is None and b - a == len(source):
        return source, None, None
    if b <= a:
        return "", [], []
    spans = [(i, i + 1) for i in range(len(text))] if spans is None else spans
    return text[a:b], [s[0] for s in spans[a:b]], [s[1] for s in spans[a:b]]


# --- occurrences


def occurrences(text: str, needle: str, within_cell: bool = False) -> list[tuple[int, int]]:
    """Where a value stands in text as whole words, whatever its case and accents. Between its words any blanks may
    stand; within a cell only spaces and one line break, and neither a tab nor another line break behind them."""
    hay, wanted = _folded(text), fold(needle.strip())
    if not wanted:
        return []
    words = [w for w in wanted.split(" ") if w] if " " in wanted else [wanted]
    gap = r"(?: *\n *| +)(?![\t\n ])" if within_cell else r"[ \n\t]+"
    pattern = re.compile(gap.join(map(re.escape, words)))
    out, at = [], 0
    while m := pattern.search(hay, at):
        a, b = m.span()
        if (a == 0 or not _word_char(hay[a - 1])) and (b == len(hay) or not _word_char(hay[b])):
            out.append((a, b))
            at = b if len(words) > 1 else a + 1
        else:
            at = a + 1
    return out


def name_occurrences(text: str, variant: str, within_cell: bool = False) -> list[tuple[int, int]]:
    """occurrences() of a name or a part of it. A single word of fewer than four letters only counts where it is
    written as a name, and a particle never does."""
    hits, word = occurrences(text, variant, within_cell), variant.strip()
    if _BLANKS.search(word) or len(canonical(word)) >= 4:
        return hits
    if not significant_tokens(word):
        return []
    return [h for h in hits if regex.fullmatch(r"\p{Lu}\p{Ll}+|\p{Lu}+", text[h[0] : h[1]])]


# --- names

# Fixed values. The grammar of names.
SOFT_SPACE = r"(?: |\n(?!\n))+"
NAME_WORD = r"(?-i:(?!Mª(?!\p{L}))\p{Lu}(?:\p{L}+|[-'’]\p{L}+)(?:[-'’]\p{L}+)*)"
PARTICLE = r"(?:(?:del|de|das|dos|da|do|las|los|la|el|y|i)(?![\p{L}]))"
FUNCTION_WORD = r"(?i:seg[uú]n|conforme|ante|tras|desde|hasta|mediante|durante|contra|sobre|entre)(?!\p{L})"

_NAME_WORD, _PARTICLE = regex.compile(NAME_WORD), regex.compile(PARTICLE, regex.IGNORECASE)
_SINGLE = regex.compile(f"(?!{PARTICLE}){NAME_WORD}(?![\\p{{L}}'’-])(?!{SOFT_SPACE}Mª(?!\\p{{L}}))", regex.IGNORECASE)
_LEADING = regex.compile(FUNCTION_WORD + SOFT_SPACE)


@dataclass(frozen=True)
class NameWord:
    """A word of what a pattern has taken for a name, and what tells whether it is one."""

    start: int
    end: int
    value: str
    below: bool  # on another line than the word before
    capitals: bool

    @property
    def form(self) -> str:
        return canonical(self.value)

    @property
    def kind(self) -> str:
        """p: a particle; n: written as a name; x: neither."""
        if _PARTICLE.fullmatch(self.value):
            return "p"
        return "n" if self.value == "Mª" or _NAME_WORD.fullmatch(self.value) else "x"


def name_words(text: str, a: int, b: int) -> list[NameWord]:
    out, last = [], a
    for m in re.finditer(r"\S+", text[a:b]):
        value, start = m.group(), a + m.start()
        out.append(NameWord(start, a + m.end(), value, "\n" in text[last:start], len(value) >= 2 and not any(c.islower() for c in value)))
        last = a + m.end()
    return out


def one_field(words: list[NameWord]) -> list[NameWord]:
    """The words that are still the field that the first one opened: a line that begins with an address word, or changes
    between capitals and mixed case, is another; on the same line a verb of prose behind two words is."""

    def foreign(nth: int, word: NameWord) -> bool:
        return word.form in _ADDRESS or word.capitals != words[0].capitals if word.below else nth >= 2 and word.form in _VERBS

    return words[: next((i for i, w in enumerate(words) if i and foreign(i, w)), None)]


def _suffices(words: list[NameWord], text: str, alone: bool) -> bool:
    """Two words make a name; one does where it may stand alone and has the form of a name."""
    return len(words) >= 2 or bool(words and alone and _SINGLE.fullmatch(text[words[0].start : words[0].end]))


#: By the kinds of words: a name begins with a name and ends with one; particles stand between; a stranger ends it.
_NAME_KINDS = re.compile("n(?:p*n)*")


def cued_name(text: str, a: int, b: int, alone: bool, known) -> tuple[int, int] | None:
    """The name that stands behind a cue in text[a:b]. Words in lower case count if they are known names; alone: one word
    is enough, as behind a form of address."""
    words = one_field(name_words(text, a, b))
    kinds = "".join("n" if w.kind == "x" and known(w.form) else w.kind for w in words)
    found = _NAME_KINDS.match(kinds)
    words = words[: found.end()] if found else []
    return (words[0].start, words[-1].end) if _suffices(words, text, alone) else None


def behind_postal_code(text: str, start: int) -> bool:
    before = text[:start].rstrip(" \n\t")[-5:]
    return len(before) == 5 and before.isdigit() and 1 <= int(before[:2]) <= 52


#: Confidence in a name by what the dictionaries say of it.
_GIVEN, _SURNAME = 0.85, 0.80


def dictionary_person(text: str, a: int, b: int, given, surnames, excluded) -> tuple[int, int, float] | None:
    """(start, end, confidence) of a plain candidate that the dictionaries bear out: its first word is a given name, or a
    later one a surname; behind a function word, which is not part of it, a surname by itself is enough."""
    lead = _LEADING.match(text, a, b)
    words = name_words(text, lead.end() if lead else a, b)
    by_itself = lead is not None and len(words) == 1 and _NAME_WORD.fullmatch(words[0].value) is not None
    words = words if by_itself else one_field(words)
    if not words or not (by_itself or _suffices(words, text, False)) or behind_postal_code(text, a):
        return None
    first, later = words[0].form, [w.form for w in words[1:] if w.kind != "p"]
    if first in excluded:
        return None
    borne_out = first in surnames if lead else False
    borne_out = borne_out or any(w in surnames and w not in excluded for w in later)
    confidence = _GIVEN if first in given else _SURNAME if borne_out else None
    return None if confidence is None else (words[0].start, words[-1].end, confidence)


def propagated(text: str, seeds: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, key) of all mentions of persons (value, key): the whole name, its surnames, its single words."""
    out = []
    for value, key in seeds:
        for variant in dict.fromkeys([value.strip(), *surname_group(value), *significant_tokens(value)]):
            out += [(a, b, key) for a, b in name_occurrences(text, variant, within_cell=True)]
    return out


def merged_keys(people: list[tuple[str, str]]) -> dict[str, str]:
    """Which person (key, value) is a shorter mention of which: the one whose words are the only strict superset."""
    longest: dict[str, str] = {}
    for key, value in people:
        if key not in longest or len(value) > len(longest[key]):
            longest[key] = value
    tokens = {k: {canonical(t) for t in significant_tokens(v)} for k, v in longest.items()}
    to = {}
    for k, own in tokens.items():
        above = [o for o, other in tokens.items() if own and o != k and own < other]
        if len(above) == 1:
            to[k] = above[0]
    out = {}
    for k in to:
        end = to[k]
        while end in to:  # supersets only grow: no circles
            end = to[end]
        out[k] = end
    return out


# --- the span algebra once more, for runs that have the whole document at hand


def arbitrated(spans: list[dict]) -> list[dict]:
    """operators.spans.arbitrate for one document."""
    starts: list[int] = []  # of what is taken, which never overlaps: only the neighbours can be in the way
    taken: list[dict] = []
    for s in sorted(spans, key=lambda s: (-PRIORITY[s["type"]], s["start"] - s["end"], s["start"])):
        i = bisect_left(starts, s["end"])
        if i == 0 or taken[i - 1]["end"] <= s["start"]:
            starts.insert(i, s["start"])
            taken.insert(i, s)
    return taken


def without_excluded(spans: list[dict], people, organizations, terms) -> list[dict]:
    """operators.spans.exclude for one document; the names are canonical."""
    gone = {s["entity_key"] for s in spans if s["type"] == "PERSON" and canonical_words(s["value"]) in people}
    named = {"ORGANIZATION": organizations, "TERM": terms}
    return [s for s in spans if not (s["type"] == "PERSON" and s["entity_key"] in gone) and canonical_words(s["value"]) not in named.get(s["type"], ())]


def pseudonyms(spans: list[dict]) -> dict[str, str]:
    out, counts = {}, {}
    for s in spans:
        if s["entity_key"] not in out:
            name = LABEL[s["type"]]
            counts[name] = counts.get(name, 0) + 1
            out[s["entity_key"]] = f"[{name}_{counts[name]:03d}]"
    return out


def redacted(text: str, spans: list[dict], labels: dict[str, str]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        breaks = "".join(c for c in text[s["start"] : s["end"]] if c in "\r\n")
        out += [text[at : s["start"]], labels[s["entity_key"]], breaks]
        at = s["end"]
    return "".join([*out, text[at:]])


def person_span(name: str, a: int, b: int, text: str, provenance: str, confidence: float) -> dict:
    value = text[a:b]
    return {"span_id": f"{name}-{a}-{b}", "type": "PERSON", "start": a, "end": b, "value": value, "entity_key": f"PERSON:{canonical_words(value)}", "provenance": provenance, "confidence": confidence}


def analyzed(source: str, text: str, starts, ends, first: list[dict], people: list[dict], last: list[dict], exclusions) -> list[dict]:
    """Spans of a source, from what detectors found in its normalized text, in the order of the detectors."""
    found = arbitrated([*first, *people, *last])
    seeds = [(s["value"], s["entity_key"], s["span_id"]) for s in found if s["type"] == "PERSON"]
    seen = set()
    for value, key, name in seeds:
        if (value, key) in seen:  # the same mentions again
            continue
        seen.add((value, key))
        for i, (a, b, _) in enumerate(propagated(text, [(value, key)])):
            found.append({**person_span("prop", a, b, text, "PROPAGATED", 0.70), "span_id": f"prop-{name}-{i}", "entity_key": key})
    found = arbitrated(found)
    to = merged_keys([(s["entity_key"], s["value"]) for s in found if s["type"] == "PERSON"])
    out = []
    for s in found:
        a, b = (s["start"], s["end"]) if starts is None else (starts[s["start"]], ends[s["end"] - 1])
        out.append({**s, "entity_key": to.get(s["entity_key"], s["entity_key"]), "start": a, "end": b, "value": source[a:b]})
    return without_excluded(arbitrated(out), *exclusions)


# --- verification


def _described(span, source: str | None = None) -> str:
    name = FINDING_PERSON if span["type"] == "PERSON" else LABEL[span["type"]]
    return name if source is None else FINDING_LINE.format(name=name, line=source[: span["start"]].count("\n") + 1)


def _longest_by_key(spans) -> list:
    out: dict = {}
    for s in spans:
        if s["entity_key"] not in out or len(s["value"]) > len(out[s["entity_key"]]["value"]):
            out[s["entity_key"]] = s
    return list(out.values())


def _literal(output, accepted):
    """C1: values that still stand there."""
    for s in accepted:
        if hits := (name_occurrences if s["type"] == "PERSON" else occurrences)(output, s["value"]):
            yield "C1", _described(s), hits[0]


def _reformatted(output, accepted, source):
    """C2: values that stand there in another form."""
    values = [(s, canonical(s["value"])) for s in accepted if s["type"] not in ("ORGANIZATION", "TERM", "PERSON")]
    values = [(s, v) for s, v in values if len(v) >= 8]
    squashed = canonical(output) if values else ""
    yield from (("C2", _described(s, source), None) for s, v in values if v in squashed)


def _name_parts(output, accepted, original, rejected):
    """C3: single words of persons, also of those that another span has taken in. What a reviewer has let stand hides one
    mention each."""
    rest = output
    for s in original:
        if s["type"] == "PERSON" and s["span_id"] in rejected and (hits := occurrences(rest, s["value"])):
            a, b = hits[0]
            rest = rest[:a] + " " * (b - a) + rest[b:]
    people, kept = {s["span_id"] for s in original if s["type"] == "PERSON"}, {s["span_id"] for s in accepted}
    absorbed = [s for s in original if s["type"] == "PERSON" and s["span_id"] not in rejected | kept and any(o["start"] <= s["start"] and s["end"] <= o["end"] for o in accepted)]
    for s in [*_longest_by_key([s for s in accepted if s["type"] == "PERSON" or s["span_id"] in people]), *absorbed]:
        for token in significant_tokens(s["value"]):
            if hits := name_occurrences(rest, token):
                yield "C3", "", hits[0]


def _uncovered(output, accepted, labels, source):
    """C4: entities without a label, or whose label is not there."""
    for s in _longest_by_key(accepted):
        name = labels.get(s["entity_key"])
        if name is None or name not in output:
            yield "C4" if name else "C4-NONE", _described(s, source), None


def findings(output: str, accepted, labels: dict[str, str], original=None, rejected=(), source: str = "") -> list[tuple]:
    """(control, severity, detail, start, end) for everything in an output that speaks against handing it out. Details
    name kinds and lines, never values."""
    empty = [] if output.strip() else [("C5", "", None)]
    original, rejected = accepted if original is None else original, set(rejected)
    found = [*empty, *_literal(output, accepted), *_reformatted(output, accepted, source), *_name_parts(output, accepted, original, rejected), *_uncovered(output, accepted, labels, source)]
    rows = [(FINDINGS[k][0], "BLOCKING", FINDINGS[k][1].format(what=what), *(at or (None, None))) for k, what, at in found]
    return rows or [(FINDINGS["OK"][0], "INFO", FINDINGS["OK"][1].format(what=len(accepted)), None, None)]


# --- review

# Fixed value. White space as ECMAScript has it.
_REVIEW_SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_REVIEW_SPACE = re.compile(f"[{_REVIEW_SPACES}]+")


def review_form(value: str) -> str:
    return _REVIEW_SPACE.sub(" ", value).strip(" ")


def _mapped(source: str, folded: bool) -> tuple[str, dict[int, int], dict[int, int]]:
    """source with white space collapsed (and folded), and which positions of the result begin and end at which of
    the source."""
    out, begins, ends, size, gap = [], {}, {0: 0}, 0, None
    for i, c in enumerate(source):
        if c in _REVIEW_SPACES:
            gap = i if gap is None else gap
            continue
        if gap is not None and size:
            begins[size] = gap
            out.append(" ")
            size += 1
            ends[size] = i
        gap = None
        piece = regex.sub(r"\p{M}+", "", unicodedata.normalize("NFD", c.lower())) if folded else c
        if piece:
            begins[size] = i
            out.append(piece)
            size += len(piece)
            ends[size] = i + 1
        elif size:
            ends[size] = i + 1  # marks that belong to the letter before them
    return "".join(out), begins, ends


def exact_matches(source: str, selected: str) -> list[tuple[int, int]]:
    """Ranges of source that equal selected once white space is collapsed."""
    value, begins, ends = _mapped(source, False)
    out, at = [], value.find(selected)
    while selected and at >= 0:
        if at in begins and at + len(selected) in ends:
            out.append((begins[at], ends[at + len(selected)]))
        at = value.find(selected, at + 1)
    return out


def manual_matches(source: str, selected: str) -> list[tuple[int, int]]:
    """Whole words of source that equal selected whatever their case and marks."""
    value, begins, ends = _mapped(source, True)
    target = _mapped(selected, True)[0]
    joins = lambda c: _word_char(c) or unicodedata.category(c)[0] == "M"
    out, at = [], value.find(target) if target else -1
    while at >= 0:
        if at in begins and at + len(target) in ends:
            a, b = begins[at], ends[at + len(target)]
            if (a == 0 or not joins(source[a - 1])) and (b == len(source) or not joins(source[b])):
                out.append((a, b))
        at = value.find(target, at + 1)
    return out


def _split_by_value(spans: list[dict]) -> list[dict]:
    """Spans of one entity whose values differ become entities of their own; the first keeps the key."""
    taken, groups, out = {s["entity_key"] for s in spans}, {}, []
    for s in spans:
        group = (s["entity_key"], review_form(s["value"]).lower())
        if group not in groups:
            key = s["entity_key"]
            if key in groups.values():
                key = f"review:{s['span_id']}"
                while key in taken:
                    key += ":"
                taken.add(key)
            groups[group] = key
        out.append({**s, "entity_key": groups[group]})
    return out


def expanded(text: str, spans: list[dict]) -> list[dict]:
    """spans and every further place where one's value stands exactly, but for places inside numbers or, for
    organizations, inside words."""
    out, taken, ids = list(spans), {(s["start"], s["end"]) for s in spans}, {s["span_id"] for s in spans}
    for s in spans:
        value = review_form(s["value"])
        for a, b in exact_matches(text, value) if value else []:
            left, right = text[a - 1 : a], text[b : b + 1]
            word = lambda c: bool(c) and (_word_char(c) or c == "_")
            if (a, b) in taken or left.isdecimal() or right.isdecimal() or (s["type"] == "ORGANIZATION" and (word(left) or word(right))):
                continue
            name = f"exact:{s['span_id']}:{a}:{b}"
            while name in ids:
                name += ":"
            ids.add(name)
            taken.add((a, b))
            out.append({**s, "span_id": name, "start": a, "end": b, "value": text[a:b]})
    return _split_by_value(out)


class InvalidReview(ValueError):
    """A review log that can't be applied; nothing of it is."""


def _crosses(a: tuple[int, int], b: tuple[int, int]) -> bool:
    inside = (a[0] <= b[0] and a[1] >= b[1]) or (b[0] <= a[0] and b[1] >= a[1])
    return a[0] < b[1] and b[0] < a[1] and not inside


def replayed(text: str, spans: list[dict], log: str) -> tuple[list[dict], list[str]]:
    """(effective spans, rejected span ids) after a review log: `review-v1` and one edit a line (reject, type, text,
    add; fields tab-separated and percent-encoded), or a list of rejected ids."""
    current = {s["span_id"]: s for s in expanded(text, spans)}
    first = dict(current)
    members: dict[str, list[str]] = {}
    for s in current.values():
        members.setdefault(s["entity_key"], []).append(s["span_id"])
    rejected_keys: set[str] = set()
    order: dict[str, int] = {}

    def effective(accepted):
        out, end = [], -1
        for s in sorted(accepted, key=lambda s: (s["start"], -s["end"], -order.get(s["span_id"], 0))):
            if s["start"] >= end:
                out.append(s)
                end = s["end"]
        return out

    if not log.startswith("review-v1\n"):
        gone = [x for x in re.split(r"[,\s]+", log) if x]
        for x in gone:
            if current.pop(x, None) is None:
                raise InvalidReview("unknown id")
        return effective(current.values()), gone
    lines = log[len("review-v1\n") :].split("\n")
    if len(lines) > 10_000:
        raise InvalidReview("too many edits")

    def plain(field: str) -> str:
        if "+" in field or "\r" in field or re.search(r"%(?![0-9A-Fa-f]{2})", field):
            raise InvalidReview("not percent-encoded")
        return unquote(field, errors="replace")

    def free(own: str | None, at: tuple[int, int]) -> bool:
        return not any(_crosses(at, (s["start"], s["end"])) for i, s in current.items() if i != own)

    def add(name: str, value: str) -> None:
        if not re.fullmatch(r"manual:[1-9][0-9]*", name) or not value or review_form(value) != value or name in current or name in members:
            raise InvalidReview("not an addition")
        ranges = manual_matches(text, value)
        if not ranges or any(not free(None, r) for r in ranges) or any(_crosses(r, o) for i, r in enumerate(ranges) for o in ranges[:i]):
            raise InvalidReview("nothing to add")
        for i, (a, b) in enumerate(ranges):
            own = name if i == 0 else f"{name}:{a}:{b}"
            if own in current:
                raise InvalidReview("id in use")
            current[own] = first[own] = {"span_id": own, "type": "TEXT", "start": a, "end": b, "value": text[a:b], "entity_key": name, "provenance": "MANUAL", "confidence": 1.0}
            members.setdefault(name, []).append(own)

    def retext(name: str, value: str) -> None:
        if not value or review_form(value) != value:
            raise InvalidReview("not a selection")
        old, moved = review_form(current[name]["value"]), {}
        for own in members[current[name]["entity_key"]]:
            if review_form(current[own]["value"]) != old:
                continue
            a, b = first[own]["start"], first[own]["end"]
            if inside := exact_matches(text[a:b], value):
                at = (a + inside[0][0], a + inside[0][1])
            else:
                around = [r for r in exact_matches(text, value) if r[0] <= a and r[1] >= b]
                if len(around) != 1:
                    continue
                at = around[0]
            if free(own, at):
                moved[own] = at
            elif own == name:
                raise InvalidReview("selection cuts another span")
        if name not in moved:
            raise InvalidReview("selection is apart from its span")
        for own, (a, b) in moved.items():
            current[own] = {**current[own], "start": a, "end": b, "value": text[a:b]}
            order[own] = len(order) + max(order.values(), default=0) + 1

    for line in lines if log != "review-v1\n" else []:
        fields = line.split("\t")
        if len(fields) != 3:
            raise InvalidReview("not three fields")
        kind, name, value = fields[0], plain(fields[1]), plain(fields[2])
        if kind == "add":
            add(name, value)
            continue
        if name not in current:
            raise InvalidReview("unknown id")
        key = current[name]["entity_key"]
        if kind == "reject" and value in ("true", "false"):
            (rejected_keys.add if value == "true" else rejected_keys.discard)(key)
        elif kind == "type" and value in LABEL.values():
            new = next(t for t, x in LABEL.items() if x == value)
            for own in members[key]:
                current[own] = {**current[own], "type": new}
        elif kind == "text":
            retext(name, value)
        else:
            raise InvalidReview("unknown edit")
    gone = [i for i, s in current.items() if s["entity_key"] in rejected_keys]
    return effective([s for s in current.values() if s["entity_key"] not in rejected_keys]), gone
