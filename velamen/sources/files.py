"""Files as documents: which format a file is, and its text.

Formats are asked in their order and the first that fits is taken. Signatures are columns; containers, Office files
and character sets need a look at the bytes, which is done in Arrow batches. Errors name formats, never contents.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from io import BytesIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_extension
from . import ocr, ole2, pdf
from ..functions.udfs import arrow_udf

MOST_BYTES, HEADER_BYTES = 50 * 1024 * 1024, 8192
# Fixed values. Formats in the order in which they are asked: name, extensions, media types.
FORMATS = [
    ("PDF", [".pdf"], ["application/pdf"]),
    ("JPEG", [".jpg", ".jpeg"], ["image/jpeg"]),
    ("PNG", [".png"], ["image/png"]),
    ("Word", [".docx"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"]),
    ("Word", [".doc"], ["application/msword"]),
    ("Excel", [".xlsx"], ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]),
    ("Excel", [".xls"], ["application/vnd.ms-excel"]),
    ("Markdown", [".md", ".markdown"], ["text/markdown"]),
    ("TXT", [".txt"], ["text/plain"]),
]
UNSUPPORTED = "Formato no admitido. Formatos admitidos: " + ", ".join(dict.fromkeys(n for n, _, _ in FORMATS)) + "."
_W, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_LINES = re.compile("\r\n|[\n\x0b\x0c\r\x85  ]")


def zip_entries(content: bytes) -> set[str]:
    """Names in a ZIP file's directory; its entries are not unpacked."""
    try:
        with zipfile.ZipFile(BytesIO(content)) as z:
            return set(z.namelist())
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return set()


@arrow_udf("array<string>")
def _containers(content):
    """Which container formats the bytes are."""
    content = bytes(content or b"")
    out = []
    if content[:4] == b"PK\x03\x04":
        names = zip_entries(content)
        out += [x for x, entry in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml")) if entry in names]
    elif content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        names = ole2.entries(content)
        out += [x for x, entry in (("doc", "worddocument"), ("xls", "workbook")) if entry in names]
    return out


def looks_binary(content: Column) -> Column:
    """A zero byte in the first 8 KiB, but for a UTF-16 byte order mark."""
    head = F.hex(F.substring(content, 1, HEADER_BYTES))
    return ~head.rlike("\\A(FFFE|FEFF)") & head.rlike("\\A(?:..)*?00(?:..)*\\z")


def format_of(path: Column, content: Column) -> Column:
    """Name of the first format that a file fits: PDF, JPEG, PNG, docx, doc, xlsx, xls, Markdown, TXT; else null."""
    head, extension = F.hex(F.substring(content, 1, 8)), file_extension(F.regexp_extract(path, "([^/\\\\]*)\\z", 1))
    boxed = F.when(head.startswith("504B0304") | (head == "D0CF11E0A1B11AE1"), _containers(content)).otherwise(F.array().cast("array<string>"))
    chain = F.when(head.startswith("255044462D"), "PDF").when(head.startswith("FFD8FF"), "JPEG").when(head == "89504E470D0A1A0A", "PNG")
    for kind in ("docx", "doc", "xlsx", "xls"):
        chain = chain.when(F.array_contains(boxed, kind), kind)
    text = ~looks_binary(content)
    return chain.when(text & extension.isin(".md", ".markdown"), "Markdown").when(text & (extension == ".txt"), "TXT")


def decode_text(content: bytes) -> str:
    """By byte order mark, else as UTF-8, else as windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def lines_of(text: str) -> list[str]:
    return _LINES.split(text)


def docx_text(content: bytes) -> str:
    """Paragraphs as lines; a table's rows as lines of cells with tabs between them."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def paragraph(p) -> str:
        out = []
        for x in p.iter():
            if x.tag == f"{_W}t":
                out.append(x.text or "")
            elif x.tag == f"{_W}tab":
                out.append("\t")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return "".join(out)

    lines = []
    for x in body if body is not None else ():
        if x.tag == f"{_W}p":
            lines.append(paragraph(x))
        elif x.tag == f"{_W}tbl":
            lines += ["\t".join("\n".join(paragraph(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")) for row in x.iter(f"{_W}tr")]
    return "".join(line + "\n" for line in lines)


def _number(value: str, code: str) -> str:
    """A number in Spanish notation, as the cell's format asks for decimals and groups."""
    number = float(value)
    pattern = re.sub(r"\[[^\]]*\]|\"[^\"]*\"|\\.|_.|\*.", "", code.split(";")[0])
    suffix = "".join(re.findall(r"\"([^\"]*)\"", code.split(";")[0]))
    if pattern in ("General", "@", ""):
        text = f"{number:.10g}" if number != int(number) or abs(number) >= 1e11 else str(int(number))
        return text.replace(".", ",") + suffix
    percent = "%" in pattern
    decimals = len(m[1]) if (m := re.search(r"\.([0#]+)", pattern)) else 0
    text = f"{number * (100 if percent else 1):,.{decimals}f}" if "," in pattern else f"{number * (100 if percent else 1):.{decimals}f}"
    return text.translate(str.maketrans(",.", ".,")) + ("%" if percent else "") + suffix


# Fixed values. Number formats that files name by number only.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "d/m/yy", 49: "@"}


def _shown(value: str, code: str) -> str:
    """A number as its cell shows it."""
    dated = code != "General" and re.search(r"[dmyh]", re.sub(r"\[[^\]]*\]|\"[^\"]*\"", "", code.lower()))
    return _date(value, code) if dated else _number(value, code)


def _sheets_lines(sheets) -> list[str]:
    """Of each sheet (name, rows of cells' texts) with text its name as a heading, then each row behind an empty line,
    its cells joined by tabs."""
    out: list[str] = []
    for name, cells in sheets:
        rows = [[v for v in (_LINES.sub(" ", x) for x in row) if v.strip()] for row in cells]
        if rows := ["\t".join(r) for r in rows if r]:
            out += ([""] if out else []) + [f"## {name}"] + [x for r in rows for x in ("", r)]
    return out


def xls_lines(content: bytes) -> list[str]:
    """Lines of an old workbook."""
    sheets = []
    for name, cells, formats, styles in ole2.workbook_sheets(content):
        codes, rows = BUILT_IN | formats, {}
        for (row, _), (kind, value, style) in sorted(cells.items()):
            code = codes.get(styles[style] if style < len(styles) else 0, "General")
            rows.setdefault(row, []).append(str(value) if kind == "s" else _shown(repr(value), code))
        sheets.append((name, rows.values()))
    return _sheets_lines(sheets)


def _date(value: str, code: str) -> str:
    from datetime import datetime, timedelta

    at = datetime(1899, 12, 30) + timedelta(days=float(value))
    parts = {"yyyy": f"{at.year:04d}", "yy": f"{at.year % 100:02d}", "mm": f"{at.month:02d}", "m": str(at.month), "dd": f"{at.day:02d}", "d": str(at.day), "hh": f"{at.hour:02d}", "h": str(at.hour), "ss": f"{at.second:02d}"}
    code = re.sub(r"(?<=h:)mm|mm(?=:ss)", f"{at.minute:02d}", re.sub(r"\[[^\]]*\]|\\|;.*|\"", "", code.lower()))
    return re.sub(r"yyyy|yy|mm|m|dd|d|hh|h|ss", lambda m: parts[m[0]], code)


def xlsx_lines(content: bytes) -> list[str]:
    """Lines of a workbook."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = set(z.namelist())
        load = lambda name: ET.fromstring(z.read(name)) if name in names else None
        text = lambda x: "".join(t.text or "" for t in x.iter(f"{_S}t"))
        shared = [text(x) for x in s.iter(f"{_S}si")] if (s := load("xl/sharedStrings.xml")) is not None else []
        codes, formats = dict(BUILT_IN), [0]
        if (styles := load("xl/styles.xml")) is not None:
            codes |= {int(x.get("numFmtId")): x.get("formatCode") for x in styles.iter(f"{_S}numFmt")}
            if (cells := styles.find(f"{_S}cellXfs")) is not None:
                formats = [int(x.get("numFmtId") or 0) for x in cells]
        links = {x.get("Id"): x.get("Target") for x in load("xl/_rels/workbook.xml.rels")}

        def shown(cell) -> str:
            raw, kind, style = cell.findtext(f"{_S}v"), cell.get("t", "n"), int(cell.get("s", 0))
            if kind == "inlineStr":
                return text(cell)
            if raw is None:
                return ""
            if kind == "n":
                return _shown(raw, codes.get(formats[style] if style < len(formats) else 0, "General"))
            return shared[int(raw)] if kind == "s" else ("TRUE" if raw == "1" else "FALSE") if kind == "b" else raw

        sheets = []
        for sheet in load("xl/workbook.xml").iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")]
            body = load(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            sheets.append((sheet.get("name"), [[shown(c) for c in row.iter(f"{_S}c")] for row in body.iter(f"{_S}row")]))
        return _sheets_lines(sheets)


@arrow_udf("struct<text:string,error:string>")
def _extract(kind, content):
    content = bytes(content or b"")
    try:
        if kind in ("Markdown", "TXT"):
            return {"text": "\n".join(lines_of(decode_text(content))), "error": None}
        if kind == "docx":
            return {"text": "\n".join(lines_of(docx_text(content))), "error": None}
        if kind == "doc":
            return {"text": "\n".join(lines_of(ole2.document_text(content))), "error": None}
        if kind in ("xlsx", "xls"):
            return {"text": "\n".join(xlsx_lines(content) if kind == "xlsx" else xls_lines(content)), "error": None}
        if kind == "PDF":
            return _pdf_text(content)
    except pdf.PdfError as e:
        return {"text": None, "error": str(e)}
    except Exception:  # noqa: BLE001  whatever a broken file does, its message may quote the file
        name = {"docx": "el documento de Word", "doc": "el documento de Word", "PDF": "el PDF"}.get(kind, "el libro de Excel")
        return {"text": None, "error": f"No se pudo leer {name}."}
    text, error = ocr.recognize(content)
    return {"text": text, "error": error}


def _pdf_text(content: bytes) -> dict:
    """Pages' lines; a page that is a picture can't be drawn here, and is named."""
    pages = pdf.read_pages(content)
    for p in pages:
        if p["has_image"] and (p["meaningful"] < 40 or p["image_coverage"] >= 0.5):
            return {"text": None, "error": f"La pagina {p['page_no']} es una imagen sin texto."}
    return {"text": "\n".join(line for p in pages for line in p["lines"]), "error": None}


def extracted(files: DataFrame) -> DataFrame:
    """files (path, length, content) with format, source_sha256, text and error. Files that are too large or of no
    format, or whose format needs a program that is not here (PDF, pictures, old Office files), have an error only."""
    kind = format_of(F.col("path"), F.col("content"))
    out = files.withColumn("format", F.when(F.col("length") <= MOST_BYTES, kind)).withColumn("source_sha256", F.sha2("content", 256))
    found = F.when(F.col("format").isNotNull(), _extract("format", "content"))
    out = out.withColumn("found", found)
    error = F.when(F.col("length") > MOST_BYTES, "El archivo es demasiado grande.").when(F.col("format").isNull(), UNSUPPORTED).otherwise(F.col("found.error"))
    return out.withColumn("text", F.col("found.text")).withColumn("error", error).drop("found")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or pattern with their text; see extracted()."""
    return extracted(spark.read.format("binaryFile").load(path))
