"""Compound files (MS-CFB), and the text of the old Office files that they hold: workbooks (MS-XLS) and documents
(MS-DOC)."""

from __future__ import annotations

import re
import struct

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # sector numbers from here on are marks


class CompoundFile:
    """Streams in the root of a compound file, by lower-case name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        self.size, self.small = (1 << x for x in struct.unpack_from("<HH", data, 30))
        if not 64 <= self.size <= 4096 * 16 or not 1 <= self.small <= self.size:
            raise ValueError("no compound file")
        first_directory, _, self.cutoff, first_small, _, more, left = struct.unpack_from("<7I", data, 48)
        table = [n for n in struct.unpack_from("<109I", data, 76) if n < _END]
        while more < _END and left:
            *own, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            table += [n for n in own if n < _END]
            left -= 1
        self.next = [x for n in table for x in struct.unpack(f"<{self.size // 4}I", self._sector(n))]
        rows = self._chain(first_directory)
        self.rows = [rows[i : i + 128] for i in range(0, len(rows) - 127, 128)]
        chained = self._chain(first_small) if first_small < _END else b""
        self.next_small = list(struct.unpack(f"<{len(chained) // 4}I", chained))
        self.mini = self._chain(struct.unpack_from("<I", self.rows[0], 116)[0])
        self.names = {}
        todo, seen = [struct.unpack_from("<I", self.rows[0], 76)[0]], set()
        while todo:
            n = todo.pop()
            if n < len(self.rows) and n not in seen:
                seen.add(n)
                row = self.rows[n]
                length = max(0, struct.unpack_from("<H", row, 64)[0] - 2)
                self.names[row[:length].decode("utf-16-le", "replace").lower()] = n
                todo += struct.unpack_from("<2I", row, 68)

    def _sector(self, n: int) -> bytes:
        out = self.data[(n + 1) * self.size : (n + 2) * self.size]
        return out + bytes(self.size - len(out))

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < len(self.next) and at not in seen:
            seen.add(at)
            out.append(self._sector(at))
            at = self.next[at]
        return b"".join(out)

    def read(self, name: str) -> bytes:
        row = self.rows[self.names[name.lower()]]
        at, size = struct.unpack_from("<II", row, 116)
        if size >= self.cutoff:
            return self._chain(at)[:size]
        out, seen = [], set()
        while at < len(self.next_small) and at not in seen:
            seen.add(at)
            out.append(self.mini[at * self.small : (at + 1) * self.small])
            at = self.next_small[at]
        return b"".join(out)[:size]


def entries(content: bytes) -> set[str]:
    """Lower-case names in the root of a compound file; nothing if it is none."""
    try:
        return set(CompoundFile(content).names)
    except (ValueError, struct.error, IndexError):
        return set()


# --- documents


def document_text(content: bytes) -> str:
    """Main text of a document: paragraphs as lines, a table's cells with tabs between them, results of fields."""
    file = CompoundFile(content)
    head = file.read("WordDocument")
    if struct.unpack_from("<H", head, 0)[0] != 0xA5EC:
        raise ValueError("no document")
    table = file.read("1Table" if struct.unpack_from("<H", head, 10)[0] & 0x0200 else "0Table")
    length = struct.unpack_from("<I", head, 0x4C)[0]
    at, size = struct.unpack_from("<II", head, 0x1A2)
    pieces, end = table[at : at + size], 0
    while pieces[end : end + 1] == b"\x01":  # formatting that stands before the pieces
        end += 3 + struct.unpack_from("<H", pieces, end + 1)[0]
    if pieces[end : end + 1] != b"\x02":
        raise ValueError("no pieces")
    plan = pieces[end + 5 : end + 5 + struct.unpack_from("<I", pieces, end + 1)[0]]
    n = (len(plan) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plan)
    out = []
    for i in range(n):
        place = struct.unpack_from("<I", plan, 4 * (n + 1) + 8 * i + 2)[0]
        chars = min(ends[i + 1], length) - ends[i]
        if chars <= 0:
            continue
        if place & 0x40000000:  # one byte a character
            start = (place & 0x3FFFFFFF) // 2
            out.append(head[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(head[place : place + 2 * chars].decode("utf-16-le", "replace"))
    text = "".join(out)
    text = re.sub("\x13[^\x13\x14\x15]*\x14([^\x13\x14\x15]*)\x15|\x13[^\x13\x14\x15]*\x15", r"\1", text)
    text = re.sub("\x07\x07", "\n", text).replace("\x07", "\t")
    text = text.replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").replace("\x1e", "-").replace("\xa0", " ")
    return re.sub("[\x00-\x08\x0e-\x1f]", "", text)


# --- workbooks


def _records(data: bytes, at: int = 0):
    """(type, body, offset) of the records from an offset on; what continues a record is its next body."""
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size], at
        at += 4 + size


class _Strings:
    """Strings that may run over from one record into the next, where their characters' width is said again."""

    def __init__(self, bodies: list[bytes]):
        self.bodies, self.n, self.at = bodies, 0, 0

    def take(self, size: int) -> bytes:
        out = b""
        while len(out) < size and self.n < len(self.bodies):
            part = self.bodies[self.n][self.at : self.at + size - len(out)]
            out, self.at = out + part, self.at + len(part)
            if self.at >= len(self.bodies[self.n]) and len(out) < size:
                self.n, self.at = self.n + 1, 0
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while count:
            if self.at >= len(self.bodies[self.n]):
                self.n, self.at = self.n + 1, 0
                wide = self.take(1)[0] & 1
            width = 2 if wide else 1
            fits = min(count, (len(self.bodies[self.n]) - self.at) // width)
            if not fits:
                break
            out.append(self.take(fits * width).decode("utf-16-le" if wide else "latin-1", "replace"))
            count -= fits
        self.take(4 * runs + extra)
        return "".join(out)


def _rk(value: int) -> float:
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def workbook_sheets(content: bytes) -> list[tuple[str, dict[tuple[int, int], tuple[str, object, int]], dict[int, str], list[int]]]:
    """Of each sheet its name, its cells by (row, column) as (kind, value, format's index), formats, formats of styles."""
    file = CompoundFile(content)
    data = file.read("Workbook")
    bodies: list = list(_records(data))
    formats, styles, sheets, shared = {}, [], [], []
    for i, (kind, body, _) in enumerate(bodies):
        if kind == 0x0A:
            break
        if kind == 0x85:
            at, _, _, size, wide = struct.unpack_from("<IBBBB", body)
            raw = body[8 : 8 + size * (2 if wide & 1 else 1)]
            sheets.append((raw.decode("utf-16-le" if wide & 1 else "latin-1", "replace"), at))
        elif kind == 0x041E:
            formats[struct.unpack_from("<H", body)[0]] = _Strings([body[2:]]).string()
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0xFC:
            parts = [body[8:]]
            for k, more, _ in bodies[i + 1 :]:
                if k != 0x3C:
                    break
                parts.append(more)
            reader = _Strings(parts)
            shared = [reader.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]
    out = []
    for name, start in sheets:
        cells, depth, waiting = {}, 0, None
        for kind, body, _ in _records(data, start):
            depth += (kind == 0x0809) - (kind == 0x0A)
            if depth <= 0:
                break
            if depth > 1:
                continue
            place = struct.unpack_from("<HHH", body) if kind in (0xFD, 0x203, 0x27E, 0x06, 0x205, 0x204, 0xBD) else None
            if kind == 0xFD:
                cells[place[:2]] = ("s", shared[struct.unpack_from("<I", body, 6)[0]], place[2])
            elif kind == 0x203:
                cells[place[:2]] = ("n", struct.unpack_from("<d", body, 6)[0], place[2])
            elif kind == 0x27E:
                cells[place[:2]] = ("n", _rk(struct.unpack_from("<I", body, 6)[0]), place[2])
            elif kind == 0xBD:
                for k in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                    cells[place[0], place[1] + k] = ("n", _rk(value), style)
            elif kind == 0x205:
                value, error = body[6], body[7]
                cells[place[:2]] = ("s", "" if error else "TRUE" if value else "FALSE", place[2])
            elif kind == 0x204:
                cells[place[:2]] = ("s", _Strings([body[6:]]).string(), place[2])
            elif kind == 0x06:
                result = body[6:14]
                if result[6:8] != b"\xff\xff":
                    cells[place[:2]] = ("n", struct.unpack("<d", result)[0], place[2])
                elif result[0] == 0:
                    waiting = place
                elif result[0] == 1:
                    cells[place[:2]] = ("s", "TRUE" if result[2] else "FALSE", place[2])
            elif kind == 0x207 and waiting:
                cells[waiting[:2]] = ("s", _Strings([body]).string(), waiting[2])
                waiting = None
        out.append((name, cells, formats, styles))
    return out
