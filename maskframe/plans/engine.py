"""Whole plans: documents in, redacted documents, items and reports out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.functions.registry import Options, all_categories
from maskframe.operators.detect import detect_all
from maskframe.operators.manual import attach_manual_spans, resolve_manual
from maskframe.operators.overlap import resolve_overlaps
from maskframe.operators.redaction import items, render, summary


def spread(docs: DataFrame, per_core: int = 2) -> DataFrame:
    """``docs`` dealt out over all cores where a scan has too few pieces for them, as one file of one row group has.

    Detection costs far more than moving a small input once; a scan of many pieces is left as it is.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= per_core * cores else docs.repartition(per_core * cores)


def once_per_text(docs: DataFrame, work: Callable[[DataFrame], DataFrame], text_col: str = "text", per_core: int = 4) -> DataFrame:
    """``docs`` with the columns that ``work`` gives beside each text; nulls beside a null text.

    ``work`` gets every different text once, dealt out by a hash over all cores, and returns it with its columns. Worth a
    shuffle of the texts where many are equal, or where few pieces of a scan hold most of the work.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    dealt = docs.repartition(max(per_core * cores, docs.rdd.getNumPartitions()), text_col)
    return dealt.join(work(dealt.select(text_col).where(F.col(text_col).isNotNull()).distinct()), text_col, "left")


def find_spans(docs: DataFrame, options: Options | None = None, manual: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", page: int = 0) -> DataFrame:
    """``docs`` with ``spans``, the resolved findings, and ``unresolved``, the ids of marked spans that weren't found.

    Spans depend neither on exclusions nor on the replacement mode: a caller that changes those keeps this frame.
    """
    text = F.col(text_col)
    if manual is not None:
        docs = attach_manual_spans(docs, manual, id_col)
        docs = docs.withColumn("_manual", resolve_manual(text, F.col("manual"), page))
        found = docs.withColumn("_found", detect_all(text, options, F.col("_manual.matches"))).withColumn("unresolved", F.col("_manual.unresolved")).drop("manual", "_manual")
    else:
        found = docs.withColumn("_found", detect_all(text, options)).withColumn("unresolved", F.array().cast("array<string>"))
    return found.withColumn("spans", resolve_overlaps(F.col("_found"), text)).drop("_found")


def redact_spans(found: DataFrame, mode: str = "redacted", excluded: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The frame of :func:`find_spans` with ``items``, ``summary`` and ``redacted``.

    ``excluded`` has the id column and ``id``, items to keep as they are.
    """
    keep = None
    if excluded is not None:
        held = excluded.groupBy(id_col).agg(F.collect_set("id").alias("_excluded"))
        found = found.join(held, id_col, "left")
        keep = F.col("_excluded")
    listed = found.withColumn("items", items(F.col("spans"), mode, keep))
    return listed.withColumn("summary", summary(F.col("items"))).withColumn("redacted", render(F.col(text_col), F.col("items"))).drop("_excluded")


def redact(docs: DataFrame, options: Options | None = None, mode: str = "redacted", excluded: DataFrame | None = None, manual: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents with their redacted text, items and summary; a null text has no findings and stays null."""
    return redact_spans(find_spans(docs, options, manual, text_col, id_col), mode, excluded, text_col, id_col)


def span_table(found: DataFrame, *keep: str) -> DataFrame:
    """One row per span: the kept columns, category, start, end and text.

    The outer form of explode: the inner one makes the optimizer filter on the array first, which evaluates a detector
    twice.
    """
    rows = found.select(*keep, F.explode_outer("spans").alias("s")).where(F.col("s").isNotNull())
    return rows.select(*keep, "s.category", "s.start", "s.end", "s.text")


def category_counts(found: DataFrame, *by: str) -> DataFrame:
    """Spans by the given columns and category."""
    return span_table(found.select(*by, "spans"), *by).groupBy(*by, "category").agg(F.count("*").alias("n_spans"), F.countDistinct("text").alias("n_values"))


def category_rollup(found: DataFrame, *by: str) -> DataFrame:
    """An addition of ours: subtotals of spans over the given columns and category."""
    return span_table(found.select(*by, "spans"), *by).rollup(*by, "category").agg(F.count("*").alias("n_spans"))


def all_category_counts(found: DataFrame) -> DataFrame:
    """Every category with its spans in all documents, 0 where there are none."""
    spark = found.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(all_categories(), 1)], "position int, category string")
    counts = span_table(found.select("spans")).groupBy("category").agg(F.count("*").alias("n"))
    return names.join(counts, "category", "left").select("position", "category", F.coalesce("n", F.lit(0)).alias("n_spans"))


def group_warnings(warnings: DataFrame, document: str = "doc_id") -> DataFrame:
    """Warnings (document, ord, code, page, detail) by code: the first detail, and the pages in order."""
    return warnings.groupBy(document, "code").agg(F.min_by("detail", "ord").alias("detail"), F.array_sort(F.collect_list("page")).alias("pages"))
