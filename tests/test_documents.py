"""Whole documents: guards, pages, files, rules, plans and the stream."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from velamen.operators import guard, headers, report
from velamen.plans import deidentify as plan
from velamen.plans.deidentify import Rules
from velamen.sources import dictionaries, files, pictures, sinks
from velamen.streaming import files as stream


def test_sanity(spark):
    texts = ["Comparece ante mí la persona que más abajo firma y declara lo siguiente.", "abc", "�" * 10 + "texto natural y bastante largo para medir", "" * 200, "1234567890 " * 6, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", guard.sanity(F.col("t")).alias("s"), guard.rejection(F.col("t"), F.lit(True)).alias("n")).orderBy("i").collect()
    assert [r["s"]["usable"] for r in rows] == [True, False, False, False, False, False, False]
    assert "capa de texto" in rows[1]["s"]["reason"] and "ToUnicode" in rows[2]["s"]["reason"] and "letras" in rows[4]["s"]["reason"]
    assert [r["n"] is None for r in rows] == [True] * 5 + [False] * 2
    ocr = spark.createDataFrame([(True, 0.1, 10), (True, 0.6, 900), (True, 0.1, 900), (False, 0.0, 0)], "i boolean, c double, n int").select(guard.needs_ocr(F.col("i"), F.col("c"), F.col("n")).alias("x")).collect()
    assert [r["x"] for r in ocr] == [True, True, False, False]


def test_headers_go_with_their_page_numbers(spark):
    pages = [(1, n, ["NOTARÍA UNO", f"Página {n} de 3", f"texto propio {'abc'[n - 1]}", "más", "y más", "otra", "pie común"]) for n in (1, 2, 3)]
    pages += [(2, n, ["igual", "cuerpo"]) for n in (1, 2)] + [(3, n, ["x", f"linea {'abc'[n - 1]}"]) for n in (1, 2, 3)] + [(4, 1, [])]
    out = headers.strip_headers_footers(spark.createDataFrame(pages, "doc_id long, page_no int, lines array<string>"))
    got = {(r["doc_id"], r["page_no"]): (r["lines"], r["removed_lines"]) for r in out.collect()}
    assert got[1, 2] == (["texto propio b", "más"], 5)
    assert got[2, 1] == (["igual", "cuerpo"], 0) and got[3, 1][1] == 0 and got[4, 1] == ([], 0)


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCX = _zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Acta de</w:t></w:r><w:r><w:t xml:space='preserve'> prueba</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Titular</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Ana Ruiz</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = _zip(
    {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Clientes" sheetId="1" r:id="rId1"/><sheet name="Vacía" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Nombre</t></si><si><t>Juan\nPérez</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="4"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c t="s"><v>0</v></c><c t="inlineStr"><is><t>DNI</t></is></c></row><row r="2"/><row r="3"><c t="s"><v>1</v></c><c><v>1500</v></c><c s="1"><v>1234.5</v></c><c s="2"><v>45000</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
    }
)


def test_files(spark, tmp_path):
    contents = {
        "a.docx": DOCX, "b.xlsx": XLSX, "c.txt": "uno\r\ndos\n".encode(), "d.md": b"\xef\xbb\xbfhola", "e.txt": "señor".encode("cp1252"), "f.txt": b"\xff\xfe" + "ñ".encode("utf-16-le"), "g.txt": b"a\0b", "h.pdf": b"%PDF-1.7", "i.txt": b"\xff\xd8\xff\xe0",
        "j.bin": b"xyz", "k.zip": _zip({"a": "b"}), "l.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(600), "m.docx": b"PK\x03\x04 broken",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-6:].split("/")[-1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "Acta de prueba\nTitular\tAna Ruiz\n" and got["a.docx"]["format"] == "docx"
    assert got["b.xlsx"]["text"].split("\n") == ["## Clientes", "", "Nombre\tDNI", "", "Juan Pérez\t1500\t1.234,50\t15/3/23\tTRUE"]
    assert got["c.txt"]["text"] == "uno\ndos\n" and got["d.md"]["text"] == "hola" and got["e.txt"]["text"] == "señor" and got["f.txt"]["text"] == "ñ"
    assert got["h.pdf"]["error"] and got["i.txt"]["error"]
    assert [got[n]["format"] for n in ("h.pdf", "i.txt", "g.txt", "j.bin", "k.zip", "l.doc", "m.docx")] == ["PDF", "JPEG", None, None, None, None, None]
    assert got["j.bin"]["error"].startswith("Formato no admitido") and got["h.pdf"]["text"] is None and len(got["c.txt"]["source_sha256"]) == 64


def _compound(streams):
    """A compound file with streams of 4096 bytes or more in its root."""
    size, sectors, chain, rows = 512, [], [], []
    for name, data in streams.items():
        data += bytes(max(0, 4096 - len(data)))
        first = len(sectors)
        parts = [data[i : i + size].ljust(size, b"\0") for i in range(0, len(data), size)]
        sectors += parts
        chain += [*range(first + 1, first + len(parts)), 0xFFFFFFFE]
        rows.append((name, 2, first, len(data)))

    def row(name, kind, at, length, left=0xFFFFFFFF, right=0xFFFFFFFF, child=0xFFFFFFFF):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, left, right, child) + bytes(36) + struct.pack("<III", at, length, 0)

    directory = row("Root Entry", 5, 0xFFFFFFFE, 0, child=1) + b"".join(row(*r, right=i + 2 if i + 1 < len(rows) else 0xFFFFFFFF) for i, r in enumerate(rows))
    directory = directory.ljust(-(-len(directory) // size) * size, b"\0")
    first_directory = len(sectors)
    parts = [directory[i : i + size] for i in range(0, len(directory), size)]
    sectors += parts
    chain += [*range(first_directory + 1, first_directory + len(parts)), 0xFFFFFFFE]
    n = -(-(len(chain) + 1) // 128)
    table = len(sectors)
    chain += [0xFFFFFFFD] * n
    fat = struct.pack(f"<{len(chain)}I", *chain).ljust(n * size, b"\xff")
    head = files.ole2.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, n, first_directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *range(table, table + n), *[0xFFFFFFFF] * (109 - n))
    return head + b"".join(sectors) + fat


def _word(text, wide):
    body = text.encode("utf-16-le" if wide else "cp1252")
    head = bytearray(0x600)
    struct.pack_into("<H", head, 0, 0xA5EC)
    struct.pack_into("<H", head, 10, 0x0200)
    struct.pack_into("<I", head, 0x4C, len(text))
    place = 0x600 if wide else 0x40000000 | (0x600 * 2)
    plan = struct.pack("<2I", 0, len(text)) + struct.pack("<HIH", 0, place, 0)
    pieces = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(plan)) + plan
    struct.pack_into("<II", head, 0x1A2, 0, len(pieces))
    return _compound({"WordDocument": bytes(head) + body, "1Table": pieces})


def _record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def _workbook():
    text = lambda s, wide=0: struct.pack("<HB", len(s), wide) + s.encode("utf-16-le" if wide else "latin-1")
    long = "palabra partida"
    strings = struct.pack("<II", 3, 3) + text("Nombre") + text("Peña €", 1) + struct.pack("<HB", len(long), 0) + long[:7].encode()
    parts = [_record(0x0809, bytes(16)), _record(0x041E, struct.pack("<H", 164) + text('#,##0.00" eur"')), *[_record(0xE0, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 164, 14)], _record(0xFC, strings), _record(0x3C, b"\x01" + long[7:].encode("utf-16-le"))]
    sheet = [_record(0x0809, bytes(16)), _record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), _record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)), _record(0xFD, struct.pack("<HHHI", 1, 0, 0, 2)), _record(0x203, struct.pack("<HHHd", 2, 0, 1, 1234.5))]
    sheet += [_record(0x27E, struct.pack("<HHHI", 2, 1, 0, (1500 << 2) | 2)), _record(0xBD, struct.pack("<HH", 2, 2) + struct.pack("<HIHI", 2, (45000 << 2) | 2, 0, (250 << 2) | 3) + struct.pack("<H", 3)), _record(0x205, struct.pack("<HHHBB", 2, 4, 0, 1, 0))]
    sheet += [_record(0x06, struct.pack("<HHH", 3, 0, 0) + b"\0" * 6 + b"\xff\xff" + bytes(8)), _record(0x207, text("hecho")), _record(0x06, struct.pack("<HHHd", 3, 1, 0, 7.0) + bytes(8)), _record(0x0A, b"")]
    globals_size = sum(map(len, parts)) + 2 * (4 + 8 + 5) + 4
    empty = [_record(0x0809, bytes(16)), _record(0x0A, b"")]
    bounds = [_record(0x85, struct.pack("<IBBBB", globals_size, 0, 0, 5, 0) + b"Datos"), _record(0x85, struct.pack("<IBBBB", globals_size + sum(map(len, sheet)), 0, 0, 5, 0) + b"Vacia")]
    return _compound({"Workbook": b"".join([*parts, *bounds, _record(0x0A, b""), *sheet, *empty])})


def test_old_office_files(spark):
    text = "Acta\rTitular\x07Ana Ruiz\x07\x07Ver \x13 HYPERLINK x \x14enlace\x15 fin\r"
    rows = [("a.doc", _word(text, False)), ("b.doc", _word(text + "€\r", True)), ("c.xls", _workbook()), ("d.doc", _compound({"WordDocument": b"x"})), ("e.xls", _compound({"Other": b"x"}))]
    df = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content binary")
    got = {r["path"]: r for r in files.extracted(df).collect()}
    assert got["a.doc"]["text"] == "Acta\nTitular\tAna Ruiz\nVer enlace fin\n" and got["b.doc"]["text"].endswith("€\n") and got["a.doc"]["format"] == "doc"
    assert got["c.xls"]["text"].split("\n") == ["## Datos", "", "Nombre\tPeña €", "", "palabra partida", "", "1.234,50 eur\t1500\t15/3/23\t2,5\tTRUE", "", "hecho\t7"]
    assert "Word" in got["d.doc"]["error"] and got["d.doc"]["text"] is None and got["e.xls"]["format"] is None


def _jpeg(order, value, tag=0x0112):
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, 1) + struct.pack(f"{order}HHIHH", tag, 3, 1, value, 0) + bytes(4)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00\x02"


def test_orientation(spark):
    cases = [(_jpeg("<", 6), 6), (_jpeg(">", 8), 8), (_jpeg("<", 9), 1), (_jpeg("<", 6, 0x0100), 1), (b"", 1), (b"\xff\xd8", 1), (_jpeg("<", 3)[:20], 1), (b"GIF89a", 1), (None, 1)]
    assert [pictures.orientation(d) for d, _ in cases] == [v for _, v in cases]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, d binary")
    assert [r["o"] for r in df.select("i", pictures.jpeg_orientation("d").alias("o")).orderBy("i").collect()] == [v for _, v in cases]
    p = np.arange(6).reshape(2, 3)
    expect = {1: p, 2: p[:, ::-1], 3: p[::-1, ::-1], 4: p[::-1], 5: p.T, 6: np.rot90(p, -1), 7: p[::-1, ::-1].T, 8: np.rot90(p)}
    for turn, e in expect.items():
        assert (pictures.upright(p, turn) == e).all(), turn


def test_rules_and_dictionaries(spark, tmp_path):
    rules = dictionaries.parse_rules("# c\n\nperson: Brayden\nexclude-term: a: b\nterm:  X \n".encode())
    assert rules == Rules(person=["Brayden"], exclude_term=["a: b"], term=["X"])
    assert dictionaries.rules_table(spark, rules).count() == 3
    for bad in (b"person:x", b"what: x", b"term: ", b"\xff", b"line"):
        with pytest.raises(ValueError, match="rules"):
            dictionaries.parse_rules(bad)
    (tmp_path / "n.txt").write_text("# x\nMaría\nMARIA\n\nJosé\n", encoding="utf-8")
    assert {r["canonical"] for r in dictionaries.read_dictionary(spark, str(tmp_path / "n.txt")).collect()} == {"maria", "jose"}
    names = spark.createDataFrame([("Zoë", 3), ("Zoe", 4), ("X", 9), ("Anne-Marie", 5), ("-a", 9), ("Юрий", 9), ("Calle", 9), ("Rare", 1)], "name string, n long")
    built = dictionaries.build_dictionary(names, spark.createDataFrame([("calle",)], "canonical string"), least=5)
    assert {tuple(r) for r in built.collect()} == {("zoe", "Zoe", 7), ("annemarie", "Anne-Marie", 5)}


LEGAL = "COMPARECE Dña. María García Pérez, mayor de edad, con DNI 12345678Z y domicilio en Calle Mayor 15, 28013 Madrid.\nLa Sra. García Pérez, en adelante García, declara. Importe 1.500 euros."


def test_deidentify(spark):
    docs = spark.createDataFrame([(1, LEGAL, "x"), (2, "", "y"), (3, None, "z"), (4, "Texto sin nada que ocultar.", "w")], "doc_id long, text string, more string")
    rows = {r["doc_id"]: r for r in plan.deidentify(docs).collect()}
    out = rows[1]["output"]
    assert rows[1]["deliverable"], rows[1]["findings"]
    assert all(v not in out for v in ("García", "12345678Z", "Mayor 15", "28013")) and "1.500 euros" in out and "Madrid" in out
    assert out.count("[PERSONA_001]") == 3 and "[PERSONA_002]" not in out and rows[1]["more"] == "x"
    assert not rows[2]["deliverable"] and not rows[3]["deliverable"] and rows[4]["output"] == "Texto sin nada que ocultar." and rows[4]["deliverable"]


def test_rules_in_a_run(spark):
    docs = spark.createDataFrame([(1, "Titular\tBrayden López Ruiz. Banco Pastor y Proyecto Alfa. D. Juan Gil Sanz.")], "doc_id long, text string")
    r = plan.deidentify(docs, Rules(person=["Brayden"], term=["Proyecto Alfa"], exclude_person=["juan gil sanz"], exclude_organization=["BANCO PASTOR"])).first()
    assert [(s["type"], s["value"]) for s in r["accepted"]] == [("PERSON", "Brayden López Ruiz"), ("TERM", "Proyecto Alfa")]


def test_review_in_a_run(spark):
    docs = spark.createDataFrame([(1, LEGAL), (2, LEGAL)], "doc_id long, text string")
    analysis = plan.analyze(docs)
    address = next(s["span_id"] for s in analysis.where("doc_id = 1").first()["candidates"] if s["type"] == "ADDRESS")
    logs = spark.createDataFrame([(1, f"review-v1\nreject\t{address}\ttrue"), (2, "review-v1\nnonsense")], "doc_id long, log string")
    rows = {r["doc_id"]: r for r in plan.complete(plan.reviewed(analysis, logs)).collect()}
    assert "Calle Mayor 15" in rows[1]["output"] and rows[1]["deliverable"] and rows[1]["review_error"] is None
    assert "Calle Mayor 15" not in rows[2]["output"] and rows[2]["review_error"]


def test_pages_in_a_run(spark):
    pages = [(1, n, ["DESPACHO GIL", f"Página {n}", f"D. Juan Pérez López dice {'abc'[n - 1]} y lo firma con su DNI 12345678Z ante todos.", "fin", "de", "hoja"], False) for n in (1, 2, 3)]
    pages += [(2, 1, ["corto"], False), (3, 1, ["corto"], True)]
    done, rejected = plan.deidentify_pages(spark.createDataFrame(pages, "doc_id long, page_no int, lines array<string>, native_text boolean"))
    rows = {r["doc_id"]: r for r in done.collect()}
    assert set(rows) == {1, 3} and rows[1]["output"].count("[PERSONA_001]") == 3 and "DESPACHO" not in rows[1]["output"] and rows[1]["page_count"] == 3
    assert [(r["doc_id"], r["reason"][:10]) for r in rejected.collect()] == [(2, "Extraccion")]


def test_report_holds_no_values(spark):
    docs = spark.createDataFrame([(1, LEGAL)], "doc_id long, text string").withColumn("source_sha256", F.sha2("text", 256)).withColumn("page_count", F.lit(1))
    text = report.technical_report(plan.deidentify(docs), generated=F.lit("2000-01-01 00:00:00").cast("timestamp")).first()["report"]
    assert "**ENTREGABLE**" in text and "| PERSONA | 3 |" in text and "| generado | 2000-01-01T00:00:00Z |" in text and "García" not in text and "12345678Z" not in text


def test_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.txt").write_text("D. Juan Pérez López, con DNI 12345678Z", encoding="utf-8")
    (folder / "b.bin").write_bytes(b"\0")
    for _ in range(2):
        stream.redact_stream(stream.documents_stream(spark, str(folder)), str(out), str(tmp_path / "cp")).awaitTermination(120)
        (folder / "c.txt").write_text("nada", encoding="utf-8")
    assert sorted(r["output"] for r in spark.read.parquet(str(out)).collect()) == ["D. [PERSONA_001], con DNI [DNI_001]", "nada"]


def test_sessions_end(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:20:00"), ("a", "2024-01-01 11:30:00")], "session_id string, t string").withColumn("at", F.col("t").cast("timestamp"))
    assert sorted(r["n_events"] for r in stream.sessions_with_ttl(rows).collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    import json

    docs = spark.createDataFrame([(1, LEGAL), (2, "")], "doc_id long, text string").withColumn("source_sha256", F.sha2("text", 256)).withColumn("page_count", F.lit(1))
    done = plan.deidentify(docs).cache()
    sinks.write_results(done, str(tmp_path))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    assert [r["doc_id"] for r in read("outputs").collect()] == [1] and [r["doc_id"] for r in read("withheld").collect()] == [2] and read("reports").count() == 2
    assert sinks.exit_code(done) == 2 and sinks.exit_code(done.where("doc_id = 1")) == 0
    a = json.loads(sinks.analysis_json(done.where("doc_id = 1")).first()["json"])
    assert a["text"] == LEGAL and all("value" not in d for d in a["detections"]) and {"DNI", "PERSONA"} <= {d["type"] for d in a["detections"]}
    r = json.loads(sinks.result_json(done.where("doc_id = 1")).first()["json"])
    assert r["deliverable"] and "García" not in json.dumps(r, ensure_ascii=False).replace("persona", "").split('"labels"')[0]
    rows = done.select("doc_id", F.explode("accepted").alias("s")).select("doc_id", "s.*")
    assert ("DNI", "0.99") in [(x["type"], x["confidence"]) for x in sinks.listing(rows).collect()]
    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string").select(sinks.run_scoped_id(F.col("v"), b"k").alias("x"), sinks.run_scoped_id(F.col("v"), b"j").alias("y")).collect()
    assert ids[0] == ids[1] != ids[2] and ids[3]["x"] is None and ids[0]["x"] != ids[0]["y"] and len(ids[0]["x"]) == 8


def test_image_coverage(spark):
    page = (0.0, 0.0, 10.0, 10.0)
    assert pictures.coverage([(0, 0, 5, 10), (4, 0, 6, 10)], page) == pytest.approx(0.6)
    assert pictures.coverage([(-5, -5, 5, 5), (2, 2, 20, 3)], page) == pytest.approx(0.3)
    assert pictures.coverage([], page) == 0 and pictures.coverage([(0, 0, 1, 1)], (0, 0, 0, 0)) == 0
    shape = "struct<a:double,b:double,c:double,d:double>"
    df = spark.createDataFrame([([(0.0, 0.0, 5.0, 5.0)], page), ([], page)], f"r array<{shape}>, p {shape}")
    assert [round(r["x"], 2) for r in df.select(pictures.image_coverage("r", "p").alias("x")).collect()] == [0.25, 0.0]
