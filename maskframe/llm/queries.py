"""The registered queries of this subpackage: each operator over its whole table, with the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.decontaminate import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.secrets import ranked_words, secret_report

    return secret_report(_table(spark, sf_dir, "documents", "doc_id", "text"), ranked_words(_vocabulary("word_bpe_49k.json")))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.token_orc import round_trip

    return round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.sharding import pack_shards

    return pack_shards(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.substring_dedup import remove_duplicates

    return remove_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.ann import hundredth_queries, nearest

    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, hundredth_queries(vectors), k=10)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("word_bpe_49k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskframe.llm.ngram_join import similarity_components

    return similarity_components(_table(spark, sf_dir, "documents", "doc_id", "text"), k=4, num=85, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


# --- SQL ---------------------------------------------------------------------------------------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_OP7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM (SELECT doc_id, i FROM g JOIN f USING (g) WHERE doc_id > first_id)),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d) ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of those whose results SQL can express; the others are tested against brute force or the library."""
    return {"op1_benchmark_decontamination": _OP1_SQL, "op3_ngram_jaccard_join": _OP3_SQL, "op7_substring_dedup": _OP7_SQL}
