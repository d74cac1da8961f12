"""Overlaps, exact values, marked spans, tokens, summaries, segments."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from maskframe.functions.kernel import SPAN
from maskframe.functions.registry import CATEGORIES, Options, all_categories, categories_in_group, category, category_label, registry_table
from maskframe.operators import redaction as R
from maskframe.operators.overlap import resolve_overlaps
from maskframe.plans.engine import all_category_counts, category_rollup, find_spans, group_warnings, once_per_text, redact, redact_spans
from maskframe.queries import queries

PRIORITY = {c.name: c.priority for c in CATEGORIES}
WORD = re.compile(r"[^\W]", re.UNICODE)


def model(spans, text):
    """The sweep in plain Python."""
    if len(spans) <= 1:
        return [tuple(s) for s in spans]
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], PRIORITY[spans[i][0]], spans[i][1] - spans[i][2], i))
    out, cursor = [], -1
    for i in order:
        c, s, e = spans[i]
        if e <= cursor:
            continue
        if s >= cursor:
            out.append([c, s, e])
        elif out[-1][0] == c or (WORD.match(text[cursor - 1]) and WORD.match(text[cursor : cursor + 1] or " ")):
            out[-1][2] = e
        elif all(not x.isalnum() for x in text[cursor:e]):
            continue
        else:
            out.append([c, cursor, e])
        cursor = e
    return [tuple(x) for x in out]


def test_overlaps_follow_the_model_and_cover(spark):
    rnd = random.Random(12345)
    names = [c for c in PRIORITY if c != "manual"]
    rows = []
    for i in range(400):
        text = "".join(rnd.choice("dé x,.-🙂 ") for _ in range(60)) if i % 2 else "d" * 200
        spans = [(rnd.choice(names), s, min(len(text), s + rnd.randint(1, 25))) for s in (rnd.randint(0, len(text) - 2) for _ in range(rnd.randint(0, 7)))]
        rows.append((i, text, [(c, s, e, text[s:e]) for c, s, e in spans]))
    df = spark.createDataFrame(rows, f"i int, text string, spans {SPAN}")
    for r in df.select("i", "text", "spans", resolve_overlaps(F.col("spans"), F.col("text")).alias("out")).collect():
        got = [(s.category, s.start, s.end) for s in r.out]
        assert got == model([(s.category, s.start, s.end) for s in r.spans], r.text)
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        covered = {p for _, s, e in got for p in range(s, e)}
        assert all(p in covered for s in r.spans for p in range(s.start, s.end) if r.text[p].isalnum())
        assert all(r.text[s.start : s.end] == s.text for s in r.out)


def one(spark, text, **how):
    return redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), **how).first()


def test_options(spark):
    cases = [
        ("Card 4111 1111 1111 1111 exp 12/26", Options.only("creditCard"), "Card [REDACTED] exp 12/26"),
        ("Alabama is green with algae", Options.only(person="Al Green"), "Alabama is green with algae"),
        ("Patient Al Green attended", Options.only(person="Al Green"), "Patient [REDACTED] attended"),
        ("Al\nGreen attended", Options.only(person="Al Green"), "[REDACTED] attended"),
        ("Green Al is a colour", Options.only(person="Al Green"), "Green Al is a colour"),
        ("order 1 2 3 4 5 6 shipped", Options.only(phone="123456"), "order 1 2 3 4 5 6 shipped"),
        ("call 054-399-0303 today", Options.only(phone="0543990303"), "call [REDACTED] today"),
        ("Al Green and Jane Roe attended", Options.only(person="Al Green, Jane Roe"), "[REDACTED] and [REDACTED] attended"),
        ("he is 34 now", Options.only(age="34"), "he is [REDACTED] now"),
        ("write a@b.co", Options.only(email=","), "write [REDACTED]"),
    ]
    for text, options, expected in cases:
        assert one(spark, text, options=options).redacted == expected


def test_pseudonyms_and_exclusions(spark):
    text = "jane@acme.com wrote; reply to jane@acme.com or john@acme.com"
    assert one(spark, text, options=Options.only("email"), mode="pseudonym").redacted == "[EMAIL_1] wrote; reply to [EMAIL_1] or [EMAIL_2]"
    keep = spark.createDataFrame([(1, "t:text:email:12:18")], "doc_id long, id string")
    r = one(spark, "a@x.co then b@x.co then c@x.co", options=Options.only("email"), mode="pseudonym", excluded=keep)
    assert r.redacted == "[EMAIL_1] then b@x.co then [EMAIL_3]" and r.summary.total == 2 and len(r.summary["items"]) == 3
    assert one(spark, "a@x.co", options=Options.only("email"), mode="label").redacted == "[EMAIL]"


def test_date_and_time_quirk(spark):
    r = one(spark, "on 2024-01-15 10:30")
    assert [(x.category, x.text) for x in r["items"]] == [("date", "2024-01-15"), ("phone", " 10")]


def test_manual_spans(spark):
    text = "Project Orion is led by Kim, contact Kim for details."
    rows = [(1, 1, "exact", 0, 8, 13, "Orion", "occurrence"), (1, 2, "moved", 0, 0, 3, "Kim", "occurrence"), (1, 3, "gone", 0, 0, 8, "Vanished", "occurrence"), (1, 4, "all", 0, 0, 3, "kim", "all"), (1, 5, "page3", 3, 0, 7, "Project", "occurrence"), (1, 6, "blank", 0, 0, 2, "  ", "occurrence")]
    marked = spark.createDataFrame(rows, "doc_id long, ord long, id string, page int, start int, end int, text string, scope string")
    r = one(spark, text, options=Options(frozenset()), manual=marked)
    assert r.redacted == "Project [REDACTED] is led by [REDACTED], contact [REDACTED] for details." and r.unresolved == ["gone"]
    wins = spark.createDataFrame([(1, 1, "m", 0, 6, 22, "to jane@acme.com", "occurrence")], marked.schema)
    assert one(spark, "write to jane@acme.com today", options=Options.only("email"), manual=wins).redacted == "write [REDACTED] today"


def test_marked_place_beyond_the_end_is_the_first_occurrence(spark):
    rows = [(1, 1, "beyond", 0, 20, 29, ".", "occurrence"), (1, 2, "last", 0, 20, 21, ".", "occurrence")]
    marked = spark.createDataFrame(rows, "doc_id long, ord long, id string, page int, start int, end int, text string, scope string")
    r = one(spark, "Re. With. The onthan.", options=Options(frozenset()), manual=marked)
    assert [(x.start, x.end) for x in r["items"]] == [(2, 3), (20, 21)] and r.unresolved == []


def test_segments_make_up_the_text(spark):
    text = "Contact jane@acme.com or john@acme.com today"
    df = redact(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), Options.only("email"))
    for r in df.select("text", R.segments(F.col("text"), F.col("items")).alias("s")).collect():
        assert "".join(x.text for x in r.s or []) == (r.text or "")
    bad = spark.createDataFrame([(text, [("b", "email", "", 25, 38, "", False), ("a", "email", "", 8, 21, "", False), ("c", "email", "", 10, 12, "", False), ("d", "email", "", 40, 999, "", False), ("e", "email", "", 3, 3, "", False)])], f"text string, i {R.ITEM}")
    got = bad.select(R.segments(F.col("text"), F.col("i")).alias("s")).first().s
    assert "".join(x.text for x in got) == text and [x.item for x in got if x.item] == ["a", "b"]


def test_document_tokens_merge_and_novelty(spark):
    spans = spark.createDataFrame([(1, 1, 0, "person", "Jane Roe"), (1, 2, 5, "person", "jane  roe"), (1, 2, 0, "person", "Bob"), (2, 1, 0, "person", "Bob")], "doc_id long, page int, start int, category string, text string")
    got = {(r.doc_id, r.page, r.start): r.token for r in R.document_tokens(spans).collect()}
    assert got == {(1, 1, 0): "[PERSON_1]", (1, 2, 0): "[PERSON_2]", (1, 2, 5): "[PERSON_1]", (2, 1, 0): "[PERSON_1]"}
    ocr = spark.createDataFrame([(1, 1, "person", "JANE ROE"), (1, 1, "person", "Al")], "doc_id long, page int, category string, text string")
    assert [r.text for r in R.novel_spans(ocr, spans).collect()] == ["Al"]
    pages = spark.createDataFrame([(1, 2, "c@x.co"), (1, 1, "a@x.co b@x.co")], "doc_id long, page int, text string")
    merged = R.merge_summaries(redact_spans(find_spans(pages, Options.only("email")))).first().summary
    assert merged.total == 3 and merged.counts["email"] == 3 and merged.counts["ssn"] == 0 and [x.text for x in merged["items"]] == ["a@x.co", "b@x.co", "c@x.co"]
    assert R.exclude_spans(spans.withColumn("id", F.col("text")), spark.createDataFrame([(1, "Bob")], "doc_id long, id string")).count() == 3


def test_reports(spark):
    docs = spark.createDataFrame([(1, "en", "a@x.co b@x.co"), (2, "fr", "10.0.0.1 a@x.co")], "doc_id long, lang string, text string")
    found = find_spans(docs, Options.only("email", "ipAddress"))
    counts = {r.category: r.n_spans for r in all_category_counts(found).collect()}
    assert counts["email"] == 3 and counts["ipAddress"] == 1 and counts["iban"] == 0 and set(counts) == set(all_categories())
    assert {(r.lang, r.category): r.n_spans for r in category_rollup(found, "lang").collect()}[None, None] == 4
    w = spark.createDataFrame([(1, 1, "scanned-page", 2, "x"), (1, 2, "scanned-page", 1, "y")], "doc_id long, ord long, code string, page int, detail string")
    r = group_warnings(w).first()
    assert r.detail == "x" and r.pages == [1, 2]
    assert spark.createDataFrame([("aXbXX",)], "t string").select(R.count_occurrences(F.col("t"), F.lit("X"))).first()[0] == 3


def test_registry(spark):
    assert len({c.priority for c in CATEGORIES}) == len(CATEGORIES) == 20
    assert {c.name for c in CATEGORIES if not c.enabled} == {"url", "postalCode"}
    grouped = [n for g in ("contact", "financial", "identifier", "location", "other") for n in categories_in_group(g)]
    assert sorted(grouped) == sorted(c for c in all_categories() if c != "manual")
    assert category_label("email", 2) == "Email addresses" and category("ssn").prefix == "SSN" and registry_table(spark).count() >= 20


def test_no_category_no_work(spark):
    r = one(spark, "a@x.co", options=Options(frozenset()))
    assert r.redacted == "a@x.co" and r.summary.total == 0


def test_texts_in_one_piece_are_dealt_out_and_each_different_one_is_redacted_once(spark, monkeypatch):
    mail = F.concat(F.lit("from a"), (F.col("id") % 40).cast("string"), F.lit("@x.co to b@x.co"))
    one_piece = spark.range(400).select(F.lit("s").alias("source"), F.col("id").alias("key"), F.when(F.col("id") != 7, mail).alias("text")).coalesce(1)
    monkeypatch.setattr("maskframe.queries.texts", lambda *a: one_piece)
    rows = queries()["redact_texts"](spark, "").withColumn("piece", F.spark_partition_id()).collect()
    assert {r.key: (r.total, r.redacted, r.found) for r in rows} == {i: (0, None, "") if i == 7 else (2, "from [EMAIL_1] to [EMAIL_2]", f"a{i % 40}@x.co|b@x.co") for i in range(400)}
    assert len(rows) == 400 and len({r.piece for r in rows}) > 1
    given = []
    got = once_per_text(one_piece, lambda t: (given.append(t.count()), t.withColumn("n", F.length("text")))[1])
    assert given == [40] and got.where("n = length(text)").count() == 399 and got.where("n is null").count() == 1


def test_boundaries_of_numbers_and_words(spark):
    text = "é2024-01-15 x2024-01-15 2024-01-15é _3 March; 13 March; March 3rd_ ſsn ssn 123-45-6789é 10.0.0.1x 10.0.0.2é"
    found = {(x.category, x.text) for x in one(spark, text, options=Options.only("date", "ssn", "ipAddress"))["items"]}
    assert found == {("date", "2024-01-15"), ("date", "13 March"), ("ssn", "123-45-6789"), ("ipAddress", "10.0.0.2")}


def test_folds_are_equal_on_both_sides_of_a_chunk(spark):
    for n in (127, 128, 129, 300):
        r = one(spark, " ".join(f"a{i % 50}@x.co" for i in range(n)), options=Options.only("email"), mode="pseudonym")
        assert r.redacted == " ".join(f"[EMAIL_{i % 50 + 1}]" for i in range(n)) and r.summary.total == n


def test_mode_queries_cover_all_documents_and_categories(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    expected = {r.doc_id: r.total for r in queries()["redact_documents"](spark, folder).collect()}
    found = redact(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.category").collect()
    others = {(r.doc_id, r.category) for r in found} - {(r.doc_id, r.category) for r in found if r.category in ("email", "ipAddress")}
    assert len({c for _, c in others}) >= 3
    for mode in ("label", "pseudonym"):
        got = {r.doc_id: r for r in queries()[f"redact_{mode}"](spark, folder).collect()}
        assert {d: r.total for d, r in got.items()} == expected
        sign = (lambda c: f"[{c.label}]") if mode == "label" else (lambda c: f"[{c.prefix}_")
        assert all(sign(category(c)) in got[d].redacted for d, c in others), mode
