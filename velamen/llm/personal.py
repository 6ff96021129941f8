"""Personal data in texts: four patterns, and a linear-chain conditional random field for what they miss.

The patterns find addresses, numbers and cards in their plain forms. The field reads word shapes (classes of
characters, with the lengths of digit runs), coarser forms (which classes, and about how long), the words of its small
labelled table, and both of the two neighbours. It finds plain forms that the patterns lose because they run into each
other (`+1 (269) 555-3296 4524132264652876`), written-out and broken-up ones (`anna dot roth at mail dot example dot
org`, `(372) 555-7739`, `10[.]0[.]3[.]8`), and secrets, a kind of their own: keys, tokens and passwords. What it finds
must hold the digits that make its kind (a card passes Luhn), and never overlaps a pattern's.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, batched, chunks, mix, text_bytes, tuned, words

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field; the last is not among those that the patterns have.
FOUND = (*KINDS, "secret")
LABELS = ["O", *(f"{p}-{k}" for k in FOUND for p in "BI")]
#: Sentences of the labelled table, steps of its training, and the weight of its penalty.
SENTENCES, STEPS, PENALTY = 1200, 70, 0.002
#: Words that are scored at a time.
SLICE_WORDS = 1 << 16

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _parts_fit(text: str) -> bool:
    parts = _DIGIT.findall(text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of each pattern's leftmost matches that do not overlap, without those that fail
    their kind's test."""
    out = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL_CHARS:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                last = m.end()
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _parts_fit(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# --- the field

#: Classes of characters in word shapes.
_CLASS = np.full(256, 4, np.uint8)  # other marks
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (".", 5), ("@", 6), ("-", 7), ("(", 8), (")", 9), ("+", 10), ("/", 11), ("[", 12), ("]", 13), (":", 14), (",", 15), ("_", 16), ("=", 17)):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = 1  # letters of other alphabets
#: The same as bits of word forms; letters that no hexadecimal number has are one more.
_BIT = np.left_shift(np.uint32(1), _CLASS.astype(np.uint32))
_BIT[np.frombuffer(b"ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", np.uint8)] |= np.uint32(1 << 20)
_BIT[128:] |= np.uint32(1 << 20)
_FINAL = np.zeros(256, bool)
_FINAL[np.frombuffer(b".,;:!?*%$&#", np.uint8)] = True
#: Lengths at which forms part.
_LENGTHS = np.array([2, 3, 4, 5, 7, 9, 12, 14, 16, 17, 18, 20, 21, 23, 26, 30, 36, 40, 41, 45, 50])


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's shape (its runs of character classes, with the length of digit runs up to 20) and form (the
    classes it has, and about how long it is), without the marks it ends with."""
    for _ in range(3):  # marks that end a sentence are not the word's
        more = (ends - starts > 1) & _FINAL[raw[ends - 1]]
        ends = ends - more
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    bytes_ = raw[np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)]
    kind = _CLASS[bytes_]
    new = np.append(True, kind[1:] != kind[:-1])
    new[first] = True
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(kind)))
    code = kind[run].astype(np.uint64) * np.uint64(32) + np.where(kind[run] == 3, np.minimum(size, 20), 0).astype(np.uint64)
    at = np.searchsorted(run, first)
    nth = np.arange(len(run)) - np.repeat(at, np.diff(np.append(at, len(run))))
    powers = np.cumprod(np.append(np.uint64(1), np.full(max(0, int(nth.max())), 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)
    shapes = mix(np.add.reduceat((code + np.uint64(1)) * powers[nth], at) ^ np.uint64(0x51A9E))
    forms = np.bitwise_or.reduceat(_BIT[bytes_], first).astype(np.uint64) * np.uint64(64) + np.searchsorted(_LENGTHS, lengths, "right").astype(np.uint64)
    return shapes, mix(forms)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What the field reads of each word, where words begin and end, and the first word of each text."""
    hashes, starts, ends, first = words(raw, at)
    shapes, forms = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
    a = 0
    while a < len(starts):  # a slice of words at a time, by words and by bytes
        b = min(a + SLICE_WORDS, max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right"))))
        shapes[a:b], forms[a:b] = _shapes(raw, starts[a:b], ends[a:b])
        a = b
    return {"word": hashes, "shape": shapes, "form": forms}, starts, ends, first


def labelled_sentences(n: int = SENTENCES, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: words and labels, made from a few dozen forms. Numbers and words that are nobody's are
    labelled O."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstdmhcgpbvéüß") for _ in range(r.randint(1, 12)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))

    common = "the of and to in is at on for a was it der die und das in de la que el en le les des et un i no we met".split()

    def prose():
        w = r.choice(common) if r.random() < 0.25 else word()
        w = w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.1 else w
        return w + (r.choice([".", ",", ";", ":", "!", "?", "!!", "***", "%%%", "$$$", "&&&", "###"]) if r.random() < 0.15 else "")

    def tag(kind, tokens):
        return tokens, [f"{'BI'[i > 0]}-{kind}" for i in range(len(tokens))]

    def plain(*tokens):
        return list(tokens), ["O"] * len(tokens)

    at, dot = (lambda: r.choice(["at", "AT", "[at]", "(at)", "{at}"])), (lambda: r.choice(["dot", "DOT", "[dot]", "(dot)"]))
    local = lambda: "".join(r.choice("aeioulnrstdmhcgpbv") for _ in range(r.randint(2, 9)))

    def email():
        host = [local(), dot(), r.choice(["com", "org", "net", "de", "fr", "es"])]
        host = [local(), dot(), *host] if r.random() < 0.4 else host
        name = [local()] if r.random() < 0.5 else [local(), dot(), local()]
        return tag("email", [*name, at(), *host])

    def joined_email():
        if r.random() < 0.4:
            return tag("email", [f"{local()}.{num(2)}@{local()}{num(1)}.example.{r.choice(['com', 'org', 'net'])}"])
        a, d = r.choice(["(at)", "[at]"]), r.choice(["(dot)", "[dot]", "."])
        return tag("email", [f"{local()}{r.choice(['.', '_', ''])}{local()}{a}{local()}{d}{r.choice(['com', 'org', 'net'])}"])

    def ip():
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        if r.random() < 0.7:
            return tag("ip", [r.choice([".", "[.]", "(.)", "[dot]"]).join(parts)])
        return tag("ip", [x for i, p in enumerate(parts) for x in (["dot"] if i else []) + [p]])

    def card():
        form = r.random()
        if form < 0.4:
            return tag("card", [num(r.choice([13, 15, 16, 16, 16]))])
        if form < 0.7:
            return tag("card", [r.choice("./_-").join(num(4) for _ in range(4))])
        return tag("card", [x for i in range(4) for x in ([r.choice("/.-")] if i and form < 0.85 else []) + [num(4)]])

    def phone():
        form = r.randint(0, 8)
        if form == 0:
            return tag("phone", [f"({num(3)})", f"{num(3)}-{num(4)}"])
        if form == 1:
            return tag("phone", [r.choice("-.").join([num(3), num(3), num(4)])])
        if form == 2:
            return tag("phone", [f"00{num(2)}", num(2), num(3), num(4)])
        if form == 3:
            return tag("phone", [f"0{num(3)}/{num(7)}"])
        if form == 4:
            return tag("phone", [f"({num(3)}){num(3)}-{num(4)}"])
        if form == 5:
            return tag("phone", [f"+{num(2)}{num(9)}"])
        return tag("phone", [f"+{num(r.randint(1, 2))}", f"({num(3)})", f"{num(3)}-{num(4)}"])

    def secret():
        form = r.randint(0, 5)
        if form < 2:
            return tag("secret", [r.choice(["AKIA", "ASIA"]) + upper(16)])
        if form < 4:
            return tag("secret", [f"{r.choice(['password', 'passwd', 'pwd', 'secret', 'token', 'api_key'])}{r.choice('==:')}{hexed(r.randint(16, 24)) if r.random() < 0.7 else mixed(r.randint(10, 24))}"])
        quote = r.choice(['"', '"', "'", ""])
        t, y = tag("secret", [quote + (hexed(r.choice([32, 40, 40, 64])) if r.random() < 0.7 else mixed(r.randint(24, 48))) + quote])
        return [r.choice(["token", "TOKEN", "secret", "api_key", "key"]), r.choice("==:"), *t], ["O", "O", *y]

    cue = {phone: ["tel", "Tel:", "call", "phone", "phone:", "fax"], card: ["card", "visa", "card:"], email: ["mail", "write", "contact"], joined_email: ["mail:", "contact"], ip: ["host", "server", "from"], secret: ["key", "login"]}
    decoys = [
        lambda: plain(num(r.randint(1, 12))), lambda: plain(f"{r.randint(1, 9)}.{num(1)}.{num(2)}"), lambda: plain(f"{num(4)}-{num(2)}-{num(2)}"), lambda: plain(f"{num(2)}:{num(2)}"), lambda: plain(num(4), num(2), num(2)),
        lambda: plain("at", word(), "dot"), lambda: plain(r.choice(common), r.choice(["at", "AT"]), r.choice(common), r.choice(["dot", "DOT"]), r.choice(common)), lambda: plain(word(), "at", word()), lambda: plain("the", "dot", word()), lambda: plain(f"{num(3)}%%%"), lambda: plain("|", num(2), "|"), lambda: plain(f"({num(4)})"), lambda: plain(f"({num(1)})", word()),
        lambda: plain("version", f"{num(1)}."), lambda: plain(f"{num(3)}-{num(4)}"), lambda: plain(f"{num(1)}/{num(1)}"), lambda: plain(f"{num(5)}-{num(4)}"), lambda: plain(num(3), num(3)), lambda: plain("***"), lambda: plain(f"{word()}-{word()}"), lambda: plain(word(), "=", num(2)),
        lambda: plain("token", word()), lambda: plain("password", word()), lambda: plain("the", "key", "=", word()), lambda: plain(f"{word()}={word()}"), lambda: plain(f"{word()}{word()}{word()}"), lambda: plain(f"{word()}{num(2)}"), lambda: plain(word().upper() + num(r.randint(1, 3))), lambda: plain(f'"{word()}"'),
        lambda: plain(f"{num(1)}.0"), lambda: plain("BY-NC", f"{num(1)}.{num(1)}."), lambda: plain(f"http://{local()}.example.com/{local()}/{num(5)}"),
    ]
    out = []
    for i in range(n):
        tokens, labels = [], []
        for _ in range(r.randint(1, 3)):
            k = r.randint(0, 6)
            tokens += [prose() for _ in range(k)]
            labels += ["O"] * k
            if i % 3 == 2 or i % 3 == 1 and r.random() < 0.5:
                t, y = r.choice(decoys)()
            else:
                f = r.choice([email, joined_email, ip, card, card, phone, phone, secret, secret])
                if r.random() < 0.4:
                    tokens.append(r.choice(cue[f]))
                    labels.append("O")
                t, y = f()
                if r.random() < 0.2:
                    t = [*t[:-1], t[-1] + r.choice([".", ",", ";", "!!", "###", "***", "%%%"])]
            tokens += t
            labels += y
        k = r.randint(0, 4)
        out.append((tokens + [prose() for _ in range(k)], labels + ["O"] * k))
    return out


def _allowed() -> np.ndarray:
    """I-k only follows B-k or I-k."""
    ok = np.zeros((len(LABELS), len(LABELS)), bool)
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            ok[i, j] = b[0] != "I" or (a != "O" and a[2:] == b[2:])
    return ok


class Field:
    """Weights of a linear-chain field: a row of label scores for each known word, shape and form, here, before and behind."""

    def __init__(self, table: list[tuple[list[str], list[str]]]):
        self.step = np.where(_allowed(), 0.0, -1e4)
        self.begin = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)
        texts = [" ".join(t).encode() for t, _ in table]
        found, _, _, first = features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        known, counts = np.unique(found["word"], return_counts=True)
        self.keys = {"word": known[counts >= 3], "shape": np.unique(found["shape"]), "form": np.unique(found["form"])}
        self.weights = {(f, d): np.zeros((len(keys) + 1, len(LABELS))) for f, keys in self.keys.items() for d in (-1, 0, 1)}
        self._train(self.ids(found), first, [[LABELS.index(x) for x in y] for _, y in table])

    def ids(self, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The row of each feature; what the table has not shown has the last, which weighs nothing."""
        out = {}
        for f, wanted in found.items():
            i = np.minimum(np.searchsorted(self.keys[f], wanted), len(self.keys[f]) - 1)
            out[f] = np.where(self.keys[f][i] == wanted, i, len(self.keys[f]))
        return out

    def emissions(self, ids: dict[str, np.ndarray], heads: np.ndarray):
        """A function (a, b) that gives the label scores of words a to b; heads: first words of texts. Words of the same
        features are one row of three small tables, of what they say of themselves, of the next and of the one before."""
        rows = np.zeros(len(ids["word"]), np.int64)
        for f, x in ids.items():
            rows = rows * (len(self.keys[f]) + 1) + x
        kinds, which = np.unique(rows, return_inverse=True)
        example = np.zeros(len(kinds), np.int64)
        example[which] = np.arange(len(which))
        none = np.zeros((1, len(LABELS)))
        here, before, behind = (np.concatenate([sum(self.weights[f, d][x[example]] for f, x in ids.items()), none]) for d in (0, -1, 1))
        which = np.concatenate([[len(kinds)], which, [len(kinds)]])  # nothing stands outside a text

        def scores(a: int, b: int) -> np.ndarray:
            left, right = which[a:b].copy(), which[a + 2 : b + 2].copy()
            left[heads[(heads >= a) & (heads < b)] - a] = len(kinds)
            right[heads[(heads > a) & (heads <= b)] - a - 1] = len(kinds)
            return here[which[a + 1 : b + 1]] + before[left] + behind[right]

        return scores

    def _near(self, ids: dict[str, np.ndarray], heads: np.ndarray) -> dict[tuple[str, int], np.ndarray]:
        """Rows of each word's features, of those of the word before and of the one behind in its text."""
        out = {}
        for f, x in ids.items():
            none = len(self.keys[f])
            before, behind = np.append(none, x[:-1]), np.append(x[1:], none)
            before[heads] = none
            behind[heads[heads > 0] - 1] = none
            out |= {(f, 0): x, (f, -1): before, (f, 1): behind}
        return out

    def _train(self, ids, first, labels):
        """Penalised log-likelihood by full-batch Adam; the gradient comes from scaled forward and backward sums."""
        n, rows, size = np.diff(first), len(labels), len(LABELS)
        real = np.arange(int(n.max())) < n[:, None]
        near = self._near(ids, first[:-1])
        order = {k: np.argsort(y, kind="stable") for k, y in near.items()}
        cuts = {k: np.flatnonzero(np.append(True, np.diff(y[order[k]]) > 0)) for k, y in near.items()}
        flat = np.concatenate([np.array(y) for y in labels])
        onehot = np.eye(size)[flat]
        gold = np.zeros((*real.shape, size))
        gold[real] = onehot
        pairs = np.einsum("rta,rtb->ab", gold[:, :-1], gold[:, 1:])
        params = [*self.weights.values(), self.step, self.begin]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        fixed = ~_allowed()
        for t in range(1, STEPS + 1):
            emit = sum(self.weights[k][y] for k, y in near.items())
            likely = np.ones((*real.shape, size))
            likely[real] = np.exp(emit - emit.max(axis=1, keepdims=True))
            step, alpha = np.exp(self.step), np.zeros_like(likely)
            scale = np.ones((*real.shape, 1))
            for i in range(real.shape[1]):
                now = (alpha[:, i - 1] @ step if i else np.exp(self.begin)) * likely[:, i]
                scale[:, i] = np.where(real[:, i, None], now.sum(axis=1, keepdims=True), 1)
                alpha[:, i] = np.where(real[:, i, None], now / scale[:, i], alpha[:, i - 1])
            beta, expect = np.ones_like(likely), np.zeros((size, size))
            for i in range(real.shape[1] - 2, -1, -1):
                ahead = likely[:, i + 1] * beta[:, i + 1] / scale[:, i + 1] * real[:, i + 1, None]
                beta[:, i] = np.where(real[:, i + 1, None], ahead @ step.T, 1)
                expect += step * (alpha[:, i].T @ ahead)
            both = (alpha * beta)[real]
            miss = (both - onehot) / rows
            grads = []
            for k, w in self.weights.items():
                g = np.zeros_like(w)
                g[near[k][order[k]][cuts[k]]] = np.add.reduceat(miss[order[k]], cuts[k])
                g[-1] = 0
                grads.append(g + PENALTY * w)
            grads.append(np.where(fixed, 0, (expect - pairs) / rows + PENALTY * self.step))
            grads.append(np.where(self.begin < -1e3, 0, miss[first[:-1]].sum(axis=0) + PENALTY * self.begin))
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= 0.2 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)

    def _settled(self, emit: np.ndarray, heads: np.ndarray, onward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that some best path leaves out whatever the others are: cutting an entity off in front of such a word
        loses nothing, wherever behind it the entity may end.

        emit: scores of words in a row; heads: which of them begin a text; onward: of each kind what an entity that goes
        on behind the last word loses at least against O (0, or below if it can win). With that of the first word."""
        ok = _allowed()
        gain = np.where(ok, self.step - self.step[:, :1], -np.inf)[:, 1:].max()
        edges = max(gain, np.where(self.begin > -1e3, self.begin - self.begin[0], -np.inf)[1:].max()) + max(0.0, (self.step[1:] - self.step[0])[:, ok[0]].max())
        settled, before = np.ones(len(emit), bool), np.zeros(len(FOUND))
        apart = np.zeros(len(emit))
        apart[heads] = 1e6  # no entity goes from one text to the next
        for k in range(len(FOUND)):
            b, i = 1 + 2 * k, 2 + 2 * k
            loss = emit[:, 0] - emit[:, i] + self.step[0, 0] - max(self.step[b, i], self.step[i, i])
            total = np.cumsum(loss + apart)
            ahead = np.minimum.accumulate(np.append(total, total[-1] + onward[k])[::-1])[::-1]
            worst = np.minimum(0, ahead[1:] - total)
            settled &= emit[:, 0] - np.maximum(emit[:, b], emit[:, i]) + worst >= edges
            before[k] = 0 if apart[0] else min(0, loss[0] + worst[0])
        return settled, before

    def decode(self, ids: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
        """The label of each word on the best path of its whole text.

        Most words are settled by themselves. Only the runs of words between them are decoded by Viterbi, all runs of many
        texts at a time, from O to O or a text's ends.
        """
        n = int(first[-1])
        heads = np.unique(first[:-1])
        scores = self.emissions(ids, heads)
        open_, emits, onward = [], [], np.zeros(len(FOUND))
        for a in reversed(range(0, n, SLICE_WORDS)):
            emit = scores(a, min(n, a + SLICE_WORDS))
            settled, onward = self._settled(emit, heads[(heads >= a) & (heads < a + len(emit))] - a, onward)
            found = np.flatnonzero(~settled)
            open_.insert(0, found + a)
            emits.insert(0, emit[found])
        out = np.zeros(n, np.int64)
        word, emit = np.concatenate([np.zeros(0, np.int64), *open_]), np.concatenate([np.zeros((0, len(LABELS))), *emits])
        if not len(word):
            return out
        is_head = np.zeros(n + 1, bool)
        is_head[heads] = is_head[n] = True
        start = np.flatnonzero(np.append(True, np.diff(word) > 1) | is_head[word])
        length = np.diff(np.append(start, len(word)))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        fresh, final = is_head[word[start]], is_head[word[start + length - 1] + 1]
        best = np.where(fresh[:, None], self.begin, self.step[0]) + emit[start]
        last, back = best.copy(), []
        for i in range(1, int(length[0])):
            m = int(np.searchsorted(-length, -i, "left"))  # runs of more than i words
            ways = best[:m, None, :] + self.step.T
            back.append(ways.argmax(axis=2).astype(np.int8))
            best = ways.max(axis=2) + emit[start[:m] + i]
            last[:m] = best
        label = (last + np.where(final[:, None], 0.0, self.step[:, 0])).argmax(axis=1)
        out[word[start + length - 1]] = label
        for i in range(int(length[0]) - 1, 0, -1):
            m = len(back[i - 1])
            label[:m] = back[i - 1][np.arange(m), label[:m]]
            out[word[start[:m] + i - 1]] = label[:m]
        return out


@cache
def default_field() -> Field:
    return Field(labelled_sentences())


_FRONT, _END = " \"'<{,;:.!*%$&#", " \"'>},;:.!?*%$&#"


def _holds(kind: str, text: str) -> bool:
    """Whether the value can be one of its kind: the digits of a number, the two marks of an address, a key's length."""
    d = _digits(text)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "ip":
        return _parts_fit(text)
    if kind == "email":
        low = text.lower()
        return ("@" in low or "at" in re.split("[^a-z]+", low)) and ("." in low or "dot" in re.split("[^a-z]+", low))
    return len(text) >= 8 and len(d) >= 1


def find_spans(raw: np.ndarray, at: np.ndarray, field: Field) -> list[tuple[list, list, list]]:
    """(base spans, spans of the four kinds, secrets) of each text of a chunk, as (start, index of the kind, end) in code
    points."""
    texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    found, starts, ends, first = features(raw, at)
    extra: dict[int, list] = {}
    if len(starts):
        label = field.decode(field.ids(found), first)
        heads = np.flatnonzero(label % 2 == 1)
        doc_of = np.searchsorted(first, heads, "right") - 1
        # code points before a byte, counted from the byte asked for last
        seen, points = 0, 0
        for h, d in zip(heads.tolist(), doc_of.tolist(), strict=True):
            tail = h
            while tail + 1 < first[d + 1] and label[tail + 1] == label[h] + 1:
                tail += 1
            if seen < at[d]:
                seen, points = int(at[d]), 0
            points += int(((raw[seen : starts[h]] & 0xC0) != 0x80).sum())
            seen = int(starts[h])
            a, b = points, points + int(((raw[seen : ends[tail]] & 0xC0) != 0x80).sum())
            text = texts[d]
            while a < b and text[a] in _FRONT:
                a += 1
            while b > a and text[b - 1] in _END:
                b -= 1
            kind = (int(label[h]) - 1) // 2
            if b > a and _holds(FOUND[kind], text[a:b]):
                extra.setdefault(d, []).append((a, kind, b))
    out = []
    for d, text in enumerate(texts):
        base = base_spans(text)
        more = [x for x in extra.get(d, []) if not any(x[0] < b and a < x[2] for a, _, b in base)]
        out.append((base, sorted(base + [x for x in more if x[1] < len(KINDS)]), [x for x in more if x[1] == len(KINDS)]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{FOUND[k]}:{a}:{b}" for a, k, b in spans)


def personal_spans(docs: DataFrame, labelled: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added,
    secrets.

    The counts and the hash are those of the patterns' spans; spans are all spans of the four kinds by start, then kind;
    n_added counts the field's own among them; secrets are its spans of that kind. Null and empty texts have none; an
    empty table has no rows; a null doc_id is kept. labelled is the field's table of (words, labels), the default if
    None. Extra columns are ignored, repeated rows searched each, texts of any length read whole.
    """
    tuned(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(default_field() if labelled is None else Field(labelled))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("secrets", pa.string())])

    def run(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for a, b in chunks(at):
                found = find_spans(raw[at[a] : at[b]], at[a : b + 1] - at[a], field.value)
                counts = [[sum(s[1] == k for s in base) for base, _, _ in found] for k in range(len(KINDS))]
                hashes = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in found]
                columns = [*counts, hashes, [_joined(every) for _, every, _ in found], [len(every) - len(base) for base, every, _ in found], [_joined(secret) for _, _, secret in found]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(batched(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, secrets string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with `<KIND>` in place of each span; of spans that overlap the first and longest stays."""
    out, last = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a < last:
            if b > last:  # the rest of an overlapping span goes too
                last = b
            continue
        out += [text[last:a], f"<{FOUND[k].upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def masked(docs: DataFrame, labelled: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """docs (text, any more) with every span of its text, secrets among them, replaced by its kind and n_chars, where
    there is such a column, counted anew. Null and empty texts stay as they are, whatever else is null; repeated rows
    stay; an empty table stays empty."""
    tuned(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(default_field() if labelled is None else Field(labelled))

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            raw, at = text_bytes(text)
            out = []
            for a, b in chunks(at):
                found = find_spans(raw[at[a] : at[b]], at[a : b + 1] - at[a], field.value)
                out += [None if x is None else mask(x, every + secret) for x, (_, every, secret) in zip(text.slice(a, b - a).to_pylist(), found, strict=True)]
            columns = {f.name: c for f, c in zip(batch.schema, batch.columns, strict=True)}
            columns["text"] = pa.array(out, text.type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if x is None else len(x) for x, n in zip(out, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(batched(run), docs.schema)
