"""Sniffing, decoding, CSV, views, pages and words."""

import pytest
from pyspark.sql import functions as F

from maskframe.functions.registry import Options
from maskframe.operators import pages as P
from maskframe.operators.textview import range_to_source, text_view
from maskframe.sources.csvdoc import csv_view, detect_delimiter, parse, parse_csv, serialize_csv
from maskframe.sources.decode import decode_text, encode_text
from maskframe.sources.files import preview_type, read_files, redact_files
from maskframe.sources.sniff import output_filename, sniff


def test_sniff(spark):
    h = bytes.fromhex
    cases = [
        ("x.txt", h("255044462D312E37"), "", "pdf", "magic"), ("a", h("FFD8FFE00010"), "", "image", "magic"), ("a", h("89504E470D0A1A0A"), "", "image", "magic"),
        ("a", b"RIFF\x00\x00\x00\x00WEBPVP8 ", "", "image", "magic"), ("a", b"GIF89a", "", "image", "magic"), ("e.txt", b"", "", None, "empty"), ("u.bin", b"\x00\x01\x02abc", "", None, "binary-unknown"),
        ("r.docx", h("504B03041400"), "", None, "zip-unsupported"), ("t.txt", "hi there".encode("utf-16"), "", "text", "extension"), ("t", "hello wor".encode("utf-16-le"), "", "text", "mime"),
        ("d.csv", b"a,b\n1,2", "application/vnd.ms-excel", "csv", "extension"), ("p", b"  <!DOCTYPE html><p>", "", "html", "content"), ("j", b"\xef\xbb\xbf {\"a\": 1}", "", "json", "content"),
        ("c", b"a;b\n1;2\n", "", "csv", "content"), ("n", b"Hello, this is prose.\nIt goes on", "", "text", "mime"), ("n", b"prose", "text/csv", "csv", "mime"), (".env", b"A=1", "", "text", "mime"), ("n", b"x", "image/x", "image", "mime"),
    ]
    df = spark.createDataFrame([(i, n, bytearray(c), m) for i, (n, c, m, _, _) in enumerate(cases)], "i int, name string, content binary, mime string")
    for r in df.select("i", sniff(F.col("content"), F.col("name"), F.col("mime")).alias("s")).collect():
        _, _, _, fmt, how = cases[r.i]
        assert (r.s.format, r.s.confidence or r.s.reason) == (fmt, how), cases[r.i]


def test_names(spark):
    cases = {"report.pdf": "report-redacted.pdf", "report": "report-redacted", ".env": ".env-redacted", "lab.report.v2.pdf": "lab.report.v2-redacted.pdf"}
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", output_filename(F.col("n")).alias("o"), output_filename(F.lit("photo.webp"), "png").alias("p"), preview_type(F.lit("text/html; x")).alias("t")).collect()
    assert {r.n: r.o for r in got} == cases and got[0].p == "photo-redacted.png" and got[0].t.startswith("text/plain")


def test_decode_and_encode(spark):
    cases = [("é".encode(), "é", "utf-8", False, False), (b"\xef\xbb\xbfhi", "hi", "utf-8", True, False), ("שלום".encode("utf-16-le").join([b"\xff\xfe", b""]), "שלום", "utf-16le", True, False), (b"\xfe\xff" + "ab".encode("utf-16-be"), "ab", "utf-16be", True, False), ("שלום עולם".encode("cp1255"), "שלום עולם", "windows-1255", False, True), ("café “x”".encode("cp1252"), "café “x”", "windows-1252", False, True), (b"", "", "utf-8", False, False)]
    df = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, content binary")
    for r in df.select("i", decode_text(F.col("content")).alias("d")).collect():
        assert tuple(r.d) == cases[r.i][1:]
    forced = spark.createDataFrame([(bytearray(b"\xe9"),)], "content binary").select(decode_text(F.col("content"), "windows-1252").alias("d")).first().d
    assert forced.text == "é" and not forced.guessed
    assert bytes(spark.range(1).select(encode_text(F.lit("é"), F.lit(True)).alias("e")).first().e) == b"\xef\xbb\xbf\xc3\xa9"


def test_delimiters():
    for text, d in [("a,b,c\n1,2,3", ","), ("a;b\n1;2", ";"), ("a\tb\n1\t2", "\t"), ("Hello, world. This is, in fact, prose.", ","), ('"Smith, John";x\n"Doe, Jane";y', ";"), ("", ",")]:
        assert detect_delimiter(text) == d


@pytest.mark.parametrize("text", ['"Smith, John",042-1234', '"Notes ""quoted"" here",x', "a,,c", '"line1\nline2",x\n', "a,b\r\nc,d\r\n", '"a"b,c', "a,b,", "", "x", '"open, never closed', '"",x', "a\rb"])
def test_csv_round_trip(spark, text):
    p = parse(text, ",")
    assert "".join(text[c["start"] : c["end"]] for c in p["cells"]).replace('"', "") == text.replace(",", "").replace('"', "").replace("\r\n", "").replace("\n", "").replace("\r", "") or "," in "".join(c["value"] for c in p["cells"]) or "\n" in "".join(c["value"] for c in p["cells"])
    again = parse(spark.createDataFrame([(text,)], "t string").withColumn("p", parse_csv(F.col("t"), ",")).select(serialize_csv(F.col("p"), F.transform("p.cells", lambda c: c["value"])).alias("s")).first().s, ",")
    assert [c["value"] for c in again["cells"]] == [c["value"] for c in p["cells"]]


def test_csv_values():
    assert [c["value"] for c in parse('"Smith, John",042-1234')["cells"]] == ["Smith, John", "042-1234"]
    assert [c["value"] for c in parse('"a"b,c', ",")["cells"]] == ["ab", "c"]
    p = parse('"line1\nline2",x\n', ",")
    assert p["rows"] == 1 and p["tail"] == "\n"


def test_csv_view(spark):
    v = spark.createDataFrame([("Jane,Doe\nJohn,,Roe",)], "t string").withColumn("p", parse_csv(F.col("t"), ",")).select(csv_view(F.col("p")).alias("v")).first().v
    assert v.text == "Jane Doe\nJohn  Roe" and [(s.view_start, s.view_end, s.ref) for s in v.segments] == [(0, 4, 0), (5, 8, 1), (9, 13, 2), (15, 18, 4)]


def test_redact_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfname,mail\n\"Doe, Jane\",jane@acme.com\n\"x\",10.0.0.1\n")
    (tmp_path / "b.txt").write_bytes("“café” a@b.co".encode("cp1252"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    got = {r.name: r for r in redact_files(read_files(spark, str(tmp_path)), Options.only("email", "ipAddress"), "pseudonym").collect()}
    assert bytes(got["a.csv"].output) == b"\xef\xbb\xbfname,mail\n\"Doe, Jane\",[EMAIL_1]\nx,[IP_1]\n"
    assert bytes(got["b.txt"].output).decode() == "“café” [EMAIL_1]" and got["b.txt"].warnings[0].code == "encoding-guessed"
    assert got["c.pdf"].output is None and got["c.pdf"].format == "pdf" and got["a.csv"].output_name == "a-redacted.csv"


def test_csv_cells_are_cut_by_the_anchor_rule(spark):
    files = spark.createDataFrame([("p", "n.csv", None, bytearray(b"first,last\nJane,Roe\nJane,Roe called\n"))], "path string, name string, mime string, content binary")
    out = redact_files(files, Options.only(person="Jane Roe")).first().output
    assert bytes(out) == b"first,last\n[REDACTED],[REDACTED]\n[REDACTED],Roe called\n"


def test_views(spark):
    words = ["Contact", "Jane", "", "Doe", "at", "jane@acme.com"]
    parts = [(w, " " if i else "", i, i + 1, i) for i, w in enumerate(words)]
    df = spark.createDataFrame([(parts,)], "p array<struct<text:string,before:string,src_start:int,src_end:int,ref:int>>").withColumn("v", text_view(F.col("p")))
    v = df.first().v
    assert v.text == " ".join(words) and [s.ref for s in v.segments] == [0, 1, 3, 4, 5]
    ranges = [(a, b) for a in range(len(v.text)) for b in range(a, len(v.text) + 1, 3)]
    got = df.crossJoin(F.broadcast(spark.createDataFrame(ranges, "a int, b int"))).select("a", "b", range_to_source(F.col("v.segments"), F.col("a"), F.col("b")).alias("s"))
    for r in got.collect():
        expected = "".join(v.text[max(r.a, s.view_start) : min(r.b, s.view_end)] for s in v.segments if s.view_start < r.b and s.view_end > r.a and r.b > r.a)
        assert "".join(words[s.ref][s.frag_start : s.frag_end] for s in r.s) == expected


def runs(spark, rows):
    """(page, ord, str, matrix, width, has_eol)"""
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, page int, ord int, str string, m array<double>, w double, has_eol boolean")
    return df.withColumn("frame", P.frame_from_matrix(F.col("m"), F.col("w"), F.lit(1.0)))


def test_page_text_and_boxes(spark):
    at = lambda x, y: [10.0, 0.0, 0.0, -10.0, float(x), float(y)]
    df = runs(spark, [(1, 1, "John", at(0, 50), 20.0, False), (1, 2, "Smith", at(23, 50), 25.0, True), (1, 3, "next", at(0, 70), 20.0, False), (1, 4, "", at(0, 0), 0.0, True), (1, 5, "12", at(20, 70), 10.0, False), (1, 6, "34", at(33, 70), 10.0, False), (1, 7, "ed", at(43, 70), 10.0, False)])
    page = P.page_text(df)
    r = page.first()
    assert r.text == "John Smith\nnext\n1234ed"
    assert [(x.start, x.end) for x in r.runs][:2] == [(0, 4), (5, 10)]
    measured = F.array(*[F.array(*[F.lit(float(i * 4)) for i in range(len(x.str) + 1)]) for x in r.runs])
    q = page.select(P.quads_for_span(F.col("runs"), F.lit(5), F.lit(7), measured).alias("q")).first().q
    x0, y0, x1, _, _, y2, _, _ = q.quads[0]
    assert not q.used_whole_run and abs(x0 - (23 - 1.2)) < 1e-9 and abs(x1 - (23 + 10 + 1.2)) < 1e-9 and abs(y0 - (50 - 8.8)) < 1e-9 and abs(y2 - (50 + 2.6)) < 1e-9
    d = page.select(P.text_density(F.col("runs"), F.lit(612.0), F.lit(792.0), F.lit(1.0)).alias("d")).first().d
    assert d.char_count == 19 and d.looks_scanned


def test_rotated_frame(spark):
    f = runs(spark, [(1, 1, "x", [0.0, 10.0, 10.0, 0.0, 20.0, 100.0], 5.0, False)]).first().frame
    assert (f.ax, f.ay, f.ux, f.uy, f.em) == (0.0, 1.0, 1.0, 0.0, 10.0)


def test_words(spark):
    w = "array<array<struct<text:string,confidence:double,bbox:struct<x0:int,y0:int,x1:int,y1:int>>>>"
    page = [[("Jane", 40.0, (0, 0, 40, 20)), ("", 9.0, (0, 0, 0, 0)), ("Doe", 80.0, (48, 0, 80, 20))], [], [("x", None, (0, 30, 8, 50))]]
    df = spark.createDataFrame([(1, page), (2, [])], f"i int, l {w}").withColumn("o", P.flatten_words(F.col("l")))
    a, b = (r.o for r in df.orderBy("i").collect())
    assert a.text == "Jane Doe\nx\n" and a.mean_confidence == 40.0 and [(x.start, x.end) for x in a.words] == [(0, 4), (5, 8), (9, 10)]
    assert b.text == "" and b.mean_confidence == 100.0
    r = df.where("i = 1").select(P.boxes_for_span(F.col("o.words"), F.lit(6), F.lit(9)).alias("b"), P.low_confidence_spans(F.col("o.words")).alias("l")).first()
    assert [x.x0 for x in r.b] == [48] and [(x.start, x.end) for x in r.l] == [(0, 4), (9, 10)]


def test_limits(spark):
    r = spark.range(1).select(P.clamp_scale(F.lit(8192.0), F.lit(100.0)).alias("a"), P.clamp_scale(F.lit(0.0), F.lit(1.0)).alias("b"), P.output_large(F.lit(10), F.lit(6 << 20)).alias("c"), P.pick_encoding(F.lit(False), F.lit(501)).alias("d"), P.page_warnings(F.lit(True), F.lit(50.0), F.lit(3)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (0.5, 1.0, True, "jpeg", ["scanned-page", "low-ocr-confidence"])


def test_stream(spark, tmp_path):
    from maskframe.streaming.stream import redact_stream, write_redacted

    spark.createDataFrame([(1, "a@x.co")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    write_redacted(redact_stream(stream, Options.only("email")).select("doc_id", "redacted"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().redacted == "[REDACTED]"


def test_windowed_counts_of_a_stream(spark, tmp_path):
    import datetime

    from maskframe.streaming.stream import windowed_counts

    at = lambda h: datetime.datetime(2024, 1, 1, h)
    spark.createDataFrame([(1, at(1), "a@x.co b@x.co"), (2, at(1), "c@x.co"), (3, at(5), "none")], "doc_id long, ts timestamp, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "1 hour", options=Options.only("email")).writeStream.format("memory").queryName("pii_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.category, r.n_spans) for r in spark.table("pii_counts").collect()] == [("email", 3)]
