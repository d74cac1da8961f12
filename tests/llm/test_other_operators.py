"""Tokens, vectors, pages and the pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskframe.llm import ann, bpe, html_extract, token_orc

ALPHABET = list("abcdeé ßÅΣσς'sàİıﬁ각\x1c\x1f\x00\n\t  😀中123٣Ⅷ½<|>!?.,-_' ") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "the", "ing", "  ", "aaaa", "ababab", "!!!!!", "hello world"]


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def random_texts(n):
    rnd = random.Random(4)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", "x" * 5000, "ab" * 3000]


def library(name):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path(name))


def test_bpe_is_the_library():
    lib, coder = library("word_bpe_49k.json"), bpe.WordCoder(bpe.read_vocabulary(path("word_bpe_49k.json")))
    texts = random_texts(3000)
    ids, counts = coder.encode(pa.array(texts))
    for t, a, b in zip(texts, coder.numbers.join(ids, counts), coder.strings.join(ids, counts), strict=True):
        e = lib.encode(t, add_special_tokens=False).ids
        assert a.decode() == " ".join(map(str, e)) and b.decode() == lib.decode(e, skip_special_tokens=False), t


def test_compatible_neighbours_are_those_that_merging_keeps_apart():
    coder = bpe.WordCoder(bpe.read_vocabulary(path("word_bpe_49k.json")))
    m, rnd = coder.bpe, random.Random(9)
    inner = [(s, i) for s, i in m.inner.items() if i in m.plain and s.isalpha()]
    final = [(s, i) for s, i in m.final.items() if i in m.plain and s.isalpha()]
    pairs = [(rnd.choice(inner), rnd.choice(final)) for _ in range(3000)]
    got = m.compatible(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs])).tolist()
    assert [m.merge(a[0] + b[0]) == [a[1], b[1]] for a, b in pairs] == got and True in got and False in got


def test_exact_merging_side_by_side():
    m = bpe.WordCoder(bpe.read_vocabulary(path("word_bpe_49k.json"))).bpe
    words = ["a", "aaaaaaa", "thethethe", "internationalization", "z" * 200, "abcabcabcabc"]
    assert m.merge_many(words) == [m.merge(w) for w in words]


def test_encode_decode(docs):
    lib = library("word_bpe_49k.json")
    got = bpe.encode_decode(docs, path("word_bpe_49k.json"), with_ids=True).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        e = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == e and r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()


def test_chunks_are_the_library():
    lib, coder = library("byte_bpe_50k.json"), None
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = token_orc.ChunkEncoder(f.read())
    texts = random_texts(3000)
    ids, counts = coder.encode(pa.array(texts))
    for t, g in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert g.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_orc_round_trip(spark, docs, no_docs, tmp_path):
    lib = library("byte_bpe_50k.json")
    folder = str(tmp_path / "tokens")
    got = token_orc.round_trip(docs, path("byte_bpe_50k.json"), folder).collect()
    assert len(got) == docs.count() and sorted(r.start for r in got)[0] == 0
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_id = sorted((r for r in got if r.doc_id is not None), key=lambda r: r.start)
    assert [r.doc_id for r in by_id] == sorted(r.doc_id for r in by_id)
    for r in got:
        ids = [*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    one = spark.read.orc(folder).where("doc_id = 8")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,8)]" in one._jdf.queryExecution().toString()
    assert token_orc.read_tokens(spark, folder).count() == docs.count()
    assert token_orc.round_trip(no_docs, path("byte_bpe_50k.json"), str(tmp_path / "none")).count() == 0


def exact(rows, k):
    out = []
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in sorted(i for i in ok if i % 100 == 0):
        near = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(near, 1)]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16).round(3).tolist()) for i in range(1500)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [None] + [1.0] * 15), (2400, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (2500, [1.0, 2.0]), (2501, [1.0, 2.5]), *[(3000 + i, [0.5] * 16) for i in range(30)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r for r in ann.nearest(df, ann.hundredth_queries(df), 10, shard_vectors=400).collect()}
    expected = exact(rows, 10)
    assert len(got) == len(expected)
    found = sum((q, i) in got for q, _, i, _ in expected)
    assert found >= 0.97 * len(expected)
    same = {(q, i): s for q, _, i, s in expected}
    assert all(abs(r.score - same[key]) < 1e-12 for key, r in got.items() if key in same)
    assert [r.vec_id for r in sorted((r for r in got.values() if r.query_id == 3000), key=lambda r: r.rank)] == list(range(3001, 3011))
    assert got[2500, 2501].score == 0.5
    repeated = df.union(df.where("vec_id in (0, 5)"))
    assert ann.nearest(repeated, ann.hundredth_queries(repeated), 10).where("query_id = 0").count() == 10
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_of_the_real_settings(spark):
    """32,800 vectors in several shards, with the settings of the query; neighbours don't depend on a cluster's."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((32_800, 32))
    v[:3000] = v[0]  # equal vectors: more than the least that a shard verifies
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(8)
    asked = df.where("vec_id % 800 = 0")
    got = sorted(map(tuple, ann.nearest(df, asked, 10).collect()))
    hits = total = 0
    for q in range(0, len(v), 800):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        near = [i for i in np.lexsort((np.arange(len(v)), d)).tolist() if i != q][:10]
        mine = [i for a, _, i, _ in got if a == q]
        assert len(mine) == 10
        hits, total = hits + len(set(near) & set(mine)), total + 10
    assert hits >= 0.95 * total
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, ann.nearest(df, asked, 10).collect())) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_exact_setting():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((900, 24))
    found = ann.CollisionIndex(np.arange(900), v, ann.Settings(verify=1.0)).search(v[:20], np.arange(20), 10)
    for q, (got, _) in enumerate(found):
        d = ((v - v[q]) ** 2).sum(1)
        assert got.tolist() == [i for i in np.argsort(d, kind="stable").tolist() if i != q][:10]


def test_copies_do_not_end_a_search():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((6000, 32))
    v[2000:5000] = 0.01
    ids, asked = np.arange(6000), np.concatenate([np.arange(0, 2000, 100), [2000]])
    found = ann.CollisionIndex(ids, v, ann.Settings()).search(v[asked], asked, 10)
    hits = 0
    for q, (got, d) in zip(asked.tolist(), found, strict=True):
        true = np.sqrt(((v - v[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, true)).tolist() if i != q][:10]
        assert np.allclose(d, true[got]) and q not in got
        hits += len(set(order) & set(got.tolist()))
    assert found[-1][0].tolist() == list(range(2001, 2011))
    assert hits >= 0.97 * 10 * len(asked)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="sidebar">side</div><div class="ad">buy</div>
<main><article class="post"><h1>Title &amp; more</h1><p>One <b>two</b>
 three<br>four</p><aside>related</aside><script>var t="</p>";</script><section id="comments"><article>bad</article></section><form>f</form><p>Last&nbsp;one<ul><li>a<li>b</ul></article></main><footer>x</footer>"""


def test_main_text(spark):
    shared = "Subscribe to our weekly letter and never miss any of our many stories again"
    bare = [f"<div>{shared}</div><p>Story {i} has its own words number {i * 7} and goes on for quite a while about topic {i}.</p>" for i in range(6)]
    rows = [(0, "https://a.example.com/x", PAGE), (1, "https://a.example.com/y", None), (2, None, "plain text"), (3, "https://a.example.com/z", ""), *[(10 + i, f"https://b.example.com/{i}", h) for i, h in enumerate(bare)], (10, "https://b.example.com/0", bare[0])]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[0].text == "Title & more\nOne two three four\nLast one\na\nb"
    assert by[1].text == by[3].text == "" and by[2].text == "plain text" and all(r.n_chars == len(r.text) for r in got)
    assert all(shared not in by[10 + i].text and f"Story {i} " in by[10 + i].text for i in range(6))


def test_names_of_elements_count_as_a_whole():
    text = lambda h: "\n".join(t for z, _, t in html_extract.page_blocks(h) if z < html_extract.REMOVED)
    for name in ('class="social-history"', 'id="popular-science"', 'id="respond-plan"', 'class="note notice-of-death"', 'id="discussion"'):
        assert text(f"<main><div {name}><p>kept</p></div></main>") == "kept", name
    for name in ('class="site-footer"', 'class="cookie-notice"', 'class="ad"', 'class="ad-slot"', 'id="leftSidebar"', 'class="related-posts"', 'class="comments-area"'):
        assert text(f"<main><div {name}><p>gone</p></div><p>kept</p></main>") == "kept", name
    assert text('<html class="menu"><body class="has-sidebar ad"><p>kept</p></body></html>') == "kept"


def test_doubtful_parts_go_where_they_are_repeated():
    rnd = random.Random(1)
    own = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    line = "follow all of our channels and tell your friends about them today"
    pages = [f'<article><p>{own(40)}</p><div class="social-history">{line if i else own(12)}</div></article>' for i in range(6)]
    got = html_extract.host_main_text(pages)
    assert not any(line in t for t in got) and got[0].count("\n") == 1


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<div>" * 40_000 + "x", "<div>" * 20_000 + "</span>" * 20_000, '<a "' * 20_000, '<a ">" ' * 20_000, "<!--" * 20_000, "<" * 100_000, "<p class='comments'>" * 20_000):
        began = time.perf_counter()
        html_extract.page_blocks(page)
        assert time.perf_counter() - began < 4, page[:20]
    assert html_extract.page_blocks('<p title="a > b">one</p><p title="x>two') == [(0, 0, "one"), (0, 0, "two")]


def test_repeated_spans_are_those_of_brute_force():
    rnd = random.Random(2)
    blocks = [[(0, 0, " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))) for _ in range(3)] for _ in range(8)]
    s = html_extract._Streams(blocks)
    spans = [tuple(s.streams[s.owner[i]][s.where[i] - s.begin[s.owner[i]] :][: html_extract.SPAN]) for i in range(len(s.where))]
    for names in (s.kinds().tolist(), s.span_names(np.arange(len(s.where))).tolist()):
        assert len(set(zip(spans, names))) == len(set(spans)) == len(set(names))


def test_copies_of_a_page_are_not_boilerplate():
    story = "<p>" + " ".join(f"word{i}" for i in range(60)) + "</p>"
    assert all(t == " ".join(f"word{i}" for i in range(60)) for t in html_extract.host_main_text([story] * 5))


def test_large_hosts_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PAGES", 20)
    df = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example.com/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("<p>the same long line that stands on every page of the host</p><p>own "), F.col("id").cast("string"), F.lit(" text of this page alone</p>")).alias("html"))
    got = html_extract.main_text(df).collect()
    assert len(got) == 100 and all(r.text == f"own {r.page_id} text of this page alone" for r in got)


def test_evidence_is_the_same_at_every_host_size(spark, monkeypatch):
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    sponsor, line, quote = "this story was brought to you by the friends of the river", "short line", own(12)
    pages = []
    for i in range(120):
        parts = [f"<p>{own(30)}</p>", f"<div>the house line that most of the pages of this host hold {'' if i % 3 else own(40)}</div>"]
        parts += [f"<div>{sponsor}</div>"] * (i % 10 == 0) + [f"<div>{line}</div>"] * (i % 40 == 0) + [f"<p>{quote}</p>"] * (i in (7, 77))
        pages.append("".join(f"<article>{x}</article>" for x in parts) if i % 4 == 1 else "".join(parts))
    pages += [pages[2]] * 5 + [None, "", "<article><p>one</p></article>"]
    df = spark.createDataFrame([(i, f"https://h.example.com/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    whole = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert len(whole) == len(pages) and not any(sponsor in t or line in t for t in whole.values()) and quote in whole[7]
    monkeypatch.setattr(html_extract, "PAGES", 10)
    dealt = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert dealt == whole


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    out = pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and 0 < out.count() < 200
    frame = docs.withColumnRenamed("cls", "lang").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in pipeline.STAGES[:-1]:
        frame.write.mode("overwrite").parquet(str(tmp_path / name))
        frame = stage(spark, spark.read.parquet(str(tmp_path / name)), folder)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r.text for r in frame.collect()}
    assert kept[3] is None and kept[4] == "" and 1 not in kept and kept[14] == "x" * 3000


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
