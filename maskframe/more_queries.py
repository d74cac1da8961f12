"""Registered queries of marked spans, exact numbers, files, summaries of pages and geometry, with SQL for each.

Values, offsets and expected forms are spelled out again in SQL, so that it doesn't follow the engine's own objects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe import oracle as O
from maskframe.functions.registry import Options
from maskframe.operators import pages as P
from maskframe.operators import redaction as R
from maskframe.operators.manual import attach_manual_spans, resolve_manual
from maskframe.operators.textview import range_to_source, text_view
from maskframe.plans import engine as E
from maskframe.sources.csvdoc import parse_csv
from maskframe.sources.decode import decode_text
from maskframe.sources.files import redact_files
from maskframe.sources.sniff import sniff


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return E.spread(df) if "text" in columns else df


def _by(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _long(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("long").alias(name or c.rsplit(".", 1)[-1])


# --- marked spans ------------------------------------------------------------------------------------------------


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four marks a document: in its place, moved from its place, lost, and every whole word ``the``."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    mark = lambda ord_, start, end, text, scope: docs.select("doc_id", F.lit(ord_).cast("long").alias("ord"), F.lit(f"m{ord_}").alias("id"), F.lit(0).alias("page"), F.lit(start).alias("start"), F.lit(end).alias("end"), text.alias("text"), F.lit(scope).alias("scope"))
    marks = mark(1, 20, 29, F.substring("text", 21, 9), "occurrence").union(mark(2, 100000000, 100000007, F.substring("text", 11, 7), "occurrence"))
    marks = marks.union(mark(3, 0, 8, F.lit("☃ nowhere"), "occurrence")).union(mark(4, 0, 3, F.lit("the"), "all"))
    held = attach_manual_spans(docs, marks.where("text is not null"))
    got = held.select("doc_id", resolve_manual(F.col("text"), F.col("manual")).alias("r"))
    return got.select(
        "doc_id", F.size("r.matches").cast("long").alias("n_matches"), F.aggregate("r.matches", F.lit(0).cast("long"), lambda acc, m: acc + m["start"]).alias("starts"),
        F.aggregate("r.matches", F.lit(0).cast("long"), lambda acc, m: acc + m["end"]).alias("ends"), F.array_join("r.unresolved", ",").alias("unresolved"),
    )


_MANUAL_SQL = r"""
WITH d AS (SELECT doc_id, text, substr(text, 21, 9) AS a, substr(text, 11, 7) AS b FROM documents),
p AS (SELECT doc_id, i, unnest(l) AS x, unnest(generate_series(1, len(l))) AS j FROM (SELECT doc_id, 0 AS i, regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_]+') AS l FROM d)),
w AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY j) - length(x) AS s FROM p),
t AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM w WHERE lower(x) = 'the' GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(t.n, 0) AS n, coalesce(t.s, 0) AS s, text, length(a) AS la, length(b) AS lb, instr(text, b) - 1 AS pb,
  CASE WHEN regexp_matches(a, '\S') THEN 1 ELSE 0 END AS ha, CASE WHEN regexp_matches(b, '\S') THEN 1 ELSE 0 END AS hb FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, CAST(n + coalesce(ha + hb, 0) AS BIGINT) AS n_matches, CAST(s + coalesce(ha * CASE WHEN la = 9 THEN 20 ELSE instr(text, substr(text, 21, 9)) - 1 END + hb * pb, 0) AS BIGINT) AS starts,
  CAST(s + 3 * n + coalesce(ha * (CASE WHEN la = 9 THEN 20 ELSE instr(text, substr(text, 21, 9)) - 1 END + la) + hb * (pb + lb), 0) AS BIGINT) AS ends,
  CASE WHEN text IS NULL THEN NULL WHEN n = 0 THEN 'm3,m4' ELSE 'm3' END AS unresolved FROM r"""


# --- a number however it is written ------------------------------------------------------------------------------

_WRITTEN = ("0543990303", "054-399-0303", "054.399.0303", "+972 543990303", "054--399-0303", "05439903031", "054 399 0303", "0543990304")


def _flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    text = F.concat(F.lit("order "), k.cast("string"), F.lit(": call "), _by(k, *_WRITTEN), F.lit(" or mail"))
    done = E.redact(_table(spark, sf_dir, "orders", "o_orderkey").select(k.alias("o_orderkey"), text.alias("text")), Options.only(phone="054-399 0303"), id_col="o_orderkey")
    return done.select("o_orderkey", _long("summary.total", "total"), F.array_join(F.transform("items", lambda x: x["text"]), "|").alias("found"), "redacted")


# written in another way with two marks between digits, one digit more, and another last digit: not this number
_FLEXIBLE_SQL = """SELECT o_orderkey, CAST(hit AS BIGINT) AS total, CASE WHEN hit THEN w ELSE '' END AS found, 'order ' || o_orderkey || ': call ' || CASE WHEN hit THEN '[REDACTED]' ELSE w END || ' or mail' AS redacted FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, ['0543990303', '054-399-0303', '054.399.0303', '+972 543990303', '054--399-0303', '05439903031', '054 399 0303', '0543990304'][o_orderkey % 8 + 1] AS w, o_orderkey % 8 IN (0, 1, 2, 3, 6) AS hit FROM orders)"""


# --- files -------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files and customers as CSV files, some with a byte order mark: rebuilt without addresses."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("a.b.txt").alias("name"), F.encode("text", "UTF-8").alias("content"))
    k = F.col("c_custkey").cast("long").cast("string")
    body = F.concat(F.lit("id;who;note\r\n"), k, F.lit(';"'), F.col("c_name"), F.lit(" <c"), k, F.lit('@x.example.org>";"a;""b"""\r\nc'), k, F.lit("@y.example.org;;end\r\n"))
    marked = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(bytes.fromhex("EFBBBF")), F.encode(body, "UTF-8"))).otherwise(F.encode(body, "UTF-8"))
    people = _table(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.concat(F.lit("c"), k), F.concat(k, F.lit(".csv")), marked)
    done = redact_files(docs.union(people).select("path", "name", F.lit(None).cast("string").alias("mime"), "content"), Options.only("email"))
    return done.select("path", "format", _long("summary.total", "total"), F.sha2("output", 256).alias("output_sha256"), "output_name", F.size("warnings").cast("long").alias("n_warnings"))


_FILES_SQL = f'''SELECT 'd' || doc_id AS path, CASE WHEN text <> '' THEN 'text' END AS format, CASE WHEN text <> '' THEN CAST(len(regexp_extract_all(text, '{O.EMAIL}')) AS BIGINT) ELSE 0 END AS total,
    CASE WHEN text <> '' THEN sha256(regexp_replace(text, '{O.EMAIL}', '[REDACTED]', 'g')) END AS output_sha256, 'a.b-redacted.txt' AS output_name, CAST(0 AS BIGINT) AS n_warnings FROM documents
  UNION ALL SELECT 'c' || k, 'csv', 2, sha256(encode(CASE WHEN k % 2 = 0 THEN chr(65279) ELSE '' END || 'id;who;note' || chr(13) || chr(10) || k || ';' || c_name || ' <[REDACTED]>;"a;""b"""' || chr(13) || chr(10) || '[REDACTED];;end' || chr(13) || chr(10))), k || '-redacted.csv', 0
    FROM (SELECT CAST(c_custkey AS BIGINT) AS k, c_name FROM customer)'''


def _delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' rows under four delimiters, which also stand inside quotes."""
    k = F.col("c_custkey").cast("long")
    d = _by(k, ",", ";", "\t", "|")
    line = lambda *cells: F.concat_ws("", *[x for c in cells for x in (c, d)][:-1])
    text = F.concat_ws("\n", line(F.lit("id"), F.lit("name"), F.lit("more")), line(k.cast("string"), F.lit('"x;y,z|w,,;;||"'), F.col("c_name")), line(F.lit("1"), F.lit(""), F.lit("")))
    got = _table(spark, sf_dir, "customer", "c_custkey", "c_name").select(k.alias("c_custkey"), parse_csv(text).alias("p"))
    return got.select("c_custkey", "p.delimiter", _long("p.rows", "n_rows"), F.size("p.cells").cast("long").alias("n_cells"), F.array_join(F.transform("p.cells", lambda c: c["value"]), "/").alias("cells_text"))


_DELIMITERS_SQL = """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, [',', ';', chr(9), '|'][c_custkey % 4 + 1] AS delimiter, CAST(3 AS BIGINT) AS n_rows, CAST(9 AS BIGINT) AS n_cells,
  'id/name/more/' || c_custkey || '/x;y,z|w,,;;||/' || c_name || '/1//' AS cells_text FROM customer"""

# first bytes in hex, name, MIME type; then what each is, as the SQL states it
_HEADS = (
    ("255044462D312E37", "a.txt", ""), ("FFD8FFE000104A46", "b", ""), ("89504E470D0A1A0A", "c", ""), ("524946461A0000005745425056503820", "d", ""), ("474946383961", "e.png", ""),
    ("504B030414000600", "f.docx", ""), ("504B030414000600", "g", ""), ("0102000304", "h.txt", ""), ("FFFE6100620063006400", "i.md", ""), ("6100620063006400", "j", ""),
    ("7B2261223A317D", "k", ""), ("612C620A312C", "l", ""), ("68656C6C6F", "m", "text/csv"), ("68656C6C6F", "n", "application/json"), ("68656C6C6F", "o", "image/bmp"), ("68656C6C6F", "p", ""), ("", "q.txt", ""),
    ("EFBBBF203C21444F43545950452068746D6C3E", "r", ""),
)


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files that begin in turn with each signature and shape, and go on with the order's number."""
    k = F.col("o_orderkey").cast("long")
    head, name, mime = (_by(k, *(h[i] for h in _HEADS)) for i in range(3))
    body = F.when(head == "", F.lit(b"")).otherwise(F.concat(F.unhex(head), F.lit(b" "), F.encode(k.cast("string"), "UTF-8")))
    got = _table(spark, sf_dir, "orders", "o_orderkey").select(k.alias("o_orderkey"), sniff(body, name, mime).alias("s"))
    return got.select("o_orderkey", "s.kind", "s.format", "s.mime", "s.confidence", "s.reason")


_HEADS_SQL = """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, w.kind, w.format, w.mime, w.confidence, w.reason FROM orders JOIN (VALUES
  (0, 'supported', 'pdf', 'application/pdf', 'magic', NULL), (1, 'supported', 'image', 'image/jpeg', 'magic', NULL), (2, 'supported', 'image', 'image/png', 'magic', NULL),
  (3, 'supported', 'image', 'image/webp', 'magic', NULL), (4, 'supported', 'image', 'image/gif', 'magic', NULL), (5, 'rejected', NULL, NULL, NULL, 'zip-unsupported'), (6, 'rejected', NULL, NULL, NULL, 'zip-unsupported'),
  (7, 'rejected', NULL, NULL, NULL, 'binary-unknown'), (8, 'supported', 'markdown', 'text/markdown', 'extension', NULL), (9, 'supported', 'text', 'text/plain', 'mime', NULL),
  (10, 'supported', 'json', 'application/json', 'content', NULL), (11, 'supported', 'csv', 'text/csv', 'content', NULL), (12, 'supported', 'csv', 'text/csv', 'mime', NULL), (13, 'supported', 'json', 'application/json', 'mime', NULL),
  (14, 'supported', 'image', 'image/bmp', 'mime', NULL), (15, 'supported', 'text', 'text/plain', 'mime', NULL), (16, 'rejected', NULL, NULL, NULL, 'empty'), (17, 'supported', 'html', 'text/html', 'content', NULL)
  ) AS w(i, kind, format, mime, confidence, reason) ON o_orderkey % 18 = w.i"""


def _code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names behind Western or Hebrew letters of a code page, or in UTF-16 with its big end first."""
    k = F.col("c_custkey").cast("long")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    western = F.concat(F.unhex(F.lit("E9")), F.encode("c_name", "UTF-8"), F.unhex(F.lit("80DF")))
    hebrew = F.concat(F.unhex(F.regexp_replace(k.cast("string"), "([0-9])", "E$1")), F.encode("c_name", "UTF-8"))
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode(F.concat(letters, F.lit("א")), "UTF-16BE"))
    raw = F.when(k % 3 == 0, western).when(k % 3 == 1, hebrew).otherwise(wide)
    got = _table(spark, sf_dir, "customer", "c_custkey", "c_name").select(k.alias("c_custkey"), decode_text(raw).alias("d"))
    return got.select("c_custkey", "d.text", "d.encoding", "d.had_bom", "d.guessed")


# Hebrew letters follow each other from code point 1488 as they do from byte E0
_CODE_PAGES_SQL = """SELECT k AS c_custkey, CASE k % 3 WHEN 0 THEN chr(233) || c_name || chr(8364) || chr(223) WHEN 1 THEN translate(CAST(k AS VARCHAR), '0123456789', 'אבגדהוזחטי') || c_name ELSE translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') || chr(1488) END AS text,
  ['windows-1252', 'windows-1255', 'utf-16be'][k % 3 + 1] AS encoding, k % 3 = 2 AS had_bom, k % 3 < 2 AS guessed FROM (SELECT CAST(c_custkey AS BIGINT) AS k, c_name FROM customer)"""


# --- pages of a document -----------------------------------------------------------------------------------------


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talks as documents whose turns are pages: one summary each."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("from t"), F.col("turn").cast("string"), F.lit("@z.example.org"))))
    done = E.redact(turns, Options.only("email"), id_col="conv_id")
    merged = R.merge_summaries(done.select("conv_id", "turn", "summary"), "conv_id", "turn")
    return merged.select("conv_id", _long("summary.total", "total"), F.element_at("summary.counts", F.lit("email")).cast("long").alias("n_email"), F.size("summary.counts").cast("long").alias("n_categories"), F.array_join(F.transform("summary.items", lambda x: x["text"]), "|").alias("found"))


_MERGED_SQL = f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(concat_ws(' ', text, 'from t' || turn || '@z.example.org'), '{O.EMAIL}') AS l FROM conversations)
  SELECT conv_id, CAST(sum(len(l)) AS BIGINT) AS total, CAST(sum(len(l)) AS BIGINT) AS n_email, CAST(20 AS BIGINT) AS n_categories, string_agg(array_to_string(l, '|'), '|' ORDER BY turn, l) AS found FROM t GROUP BY conv_id"""


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warning for each turn as a page, by its role, grouped by document and code."""
    w = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.coalesce("role", F.lit("none")).alias("code"), F.col("turn").alias("page"), F.concat(F.lit("page "), F.col("turn").cast("string")).alias("detail"))
    return E.group_warnings(w).select("doc_id", "code", "detail", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


_WARNINGS_SQL = """SELECT conv_id AS doc_id, coalesce(role, 'none') AS code, 'page ' || min(turn) AS detail, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pages FROM conversations GROUP BY 1, 2"""


def _view_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells of an order a stretch of its flat view touches, and with which part."""
    o = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    cells = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")]
    parts = F.array(*(F.struct(c.alias("text"), F.lit(" " if i else "").alias("before"), F.lit(i).alias("src_start"), F.lit(i + 1).alias("src_end"), F.lit(i).alias("ref")) for i, c in enumerate(cells)))
    got = o.select(_long("o_orderkey"), text_view(parts).alias("v")).select("o_orderkey", "v.text", range_to_source(F.col("v.segments"), F.lit(1), F.length("v.text") - 2).alias("r"))
    return got.select("o_orderkey", F.length("text").cast("long").alias("n_chars"), F.array_join(F.transform("r", lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("ref", "frag_start", "frag_end")))), ",").alias("parts"))


_VIEW_RANGES_SQL = """SELECT k AS o_orderkey, CAST(a + b + c + 2 AS BIGINT) AS n_chars, CASE WHEN a > 1 THEN '0:1:' || a || ',' ELSE '' END || '1:0:' || b || ',2:0:' || (c - 2) AS parts
  FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, length(CAST(o_orderkey AS VARCHAR)) AS a, length(o_orderstatus) AS b, length(o_orderpriority) AS c FROM orders)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the recognised words that a stretch of a benchmark item touches."""
    b = _table(spark, sf_dir, "benchmark", "item_id", "text").where("text is not null")
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w, i: F.struct(w.alias("text"), F.lit(90.0).alias("confidence"), i.alias("bbox")))
    o = b.select("item_id", P.flatten_words(F.array(words)).alias("o"))
    return o.select("item_id", F.array_join(F.transform(P.boxes_for_span(F.col("o.words"), F.lit(7), F.lit(31)), lambda x: x.cast("string")), ",").alias("boxes"))


_BOXES_SQL = r"""WITH w AS (SELECT item_id, unnest(l) AS x, unnest(generate_series(0, len(l) - 1)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS l FROM benchmark WHERE text IS NOT NULL)),
  p AS (SELECT item_id, i, sum(length(x) + 1) OVER (PARTITION BY item_id ORDER BY i) - 1 AS e, length(x) AS n FROM w),
  h AS (SELECT item_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS boxes FROM p WHERE e - n < 31 AND e > 7 GROUP BY item_id)
  SELECT item_id, coalesce(boxes, '') AS boxes FROM benchmark LEFT JOIN h USING (item_id) WHERE text IS NOT NULL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "manual_spans": _manual, "flexible_digits": _flexible, "redact_files": _files, "csv_delimiters": _delimiters, "sniff_signatures": _heads, "decode_code_pages": _code_pages,
        "merged_summaries": _merged, "grouped_warnings": _warnings, "view_ranges": _view_ranges, "word_boxes": _boxes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "manual_spans": _MANUAL_SQL, "flexible_digits": _FLEXIBLE_SQL, "redact_files": _FILES_SQL, "csv_delimiters": _DELIMITERS_SQL, "sniff_signatures": _HEADS_SQL, "decode_code_pages": _CODE_PAGES_SQL,
        "merged_summaries": _MERGED_SQL, "grouped_warnings": _WARNINGS_SQL, "view_ranges": _VIEW_RANGES_SQL, "word_boxes": _BOXES_SQL,
    }
