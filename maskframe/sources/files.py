"""Files in, redacted files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.registry import Options
from maskframe.operators.pages import MAX_UPLOAD_BYTES
from maskframe.plans.engine import find_spans, redact_spans
from maskframe.sources.csvdoc import csv_view, parse_csv, redacted_values, serialize_csv
from maskframe.sources.decode import decode_text, encode_text
from maskframe.sources.sniff import output_filename, sniff

# Extensions that an upload may have, and previews that are shown as plain text.
UPLOAD_EXTENSIONS = ("txt", "csv", "tsv", "json", "md", "markdown", "html", "htm", "log", "text", "pdf", "jpg", "jpeg", "png", "webp")
TEXT_PREVIEW_TYPES = ("text/csv", "text/tab-separated-values", "text/markdown", "application/json", "text/html", "application/xml", "text/xml")


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """path, name, mime (null: files carry none), content and length of files, one row a file; the content of a file
    over ``max_bytes`` is null, and ``rejected`` says so: it is listed, not dropped."""
    raw = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= max_bytes
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("mime"), F.when(fits, F.col("content")).alias("content"), "length", F.when(~fits, F.lit("too-large")).alias("rejected"))


def accepts_upload(name: Column, length: Column) -> Column:
    from maskframe.sources.sniff import extension_of

    return (length <= MAX_UPLOAD_BYTES) & extension_of(name).isin(*UPLOAD_EXTENSIONS)


def preview_type(mime: Column) -> Column:
    """Text-like types are previewed as plain text, so that nothing in them runs."""
    base = F.lower(F.trim(F.element_at(F.split(mime, ";"), 1)))
    return F.when(base.isin(*TEXT_PREVIEW_TYPES), "text/plain;charset=utf-8").otherwise(mime)


def redact_files(files: DataFrame, options: Options | None = None, mode: str = "redacted", excluded: DataFrame | None = None, forced_encoding: str | None = None) -> DataFrame:
    """Files (path, name, mime, content) with format, text, items, summary, warnings, output and output_name.

    Text and CSV files are rebuilt; others keep a null output and say why in ``detail``. Detection runs once over all:
    on a file's text, or on the flat view of a CSV file's cells, whose values are then replaced cell by cell.
    """
    known = files.withColumn("sniffed", sniff(F.col("content"), F.col("name"), F.col("mime")))
    is_text = (F.col("sniffed.kind") == "supported") & ~F.col("sniffed.format").isin("pdf", "image")
    read = known.withColumn("decoded", decode_text(F.when(is_text, F.col("content")), forced_encoding))
    read = read.withColumn("parsed", parse_csv(F.when(F.col("sniffed.format") == "csv", F.col("decoded.text"))))
    read = read.withColumn("view", csv_view(F.col("parsed")))
    is_csv = F.col("sniffed.format") == "csv"
    read = read.withColumn("text", F.when(is_csv, F.col("view.text")).otherwise(F.col("decoded.text")))
    done = redact_spans(find_spans(read, options, id_col="path"), mode, excluded, id_col="path")
    rebuilt = F.when(is_csv, serialize_csv(F.col("parsed"), redacted_values(F.col("parsed"), F.col("view"), F.col("items")))).otherwise(F.col("redacted"))
    warnings = F.array_compact(F.array(F.when(F.col("decoded.guessed"), F.struct(F.lit("encoding-guessed").alias("code"), F.concat(F.lit("no valid UTF-8; decoded by guess with "), F.col("decoded.encoding")).alias("detail")))))
    return done.select(
        "path", "name", F.col("sniffed.format").alias("format"), F.col("sniffed.detail").alias("detail"), "text", "items", "summary", warnings.alias("warnings"),
        encode_text(F.when(is_text, rebuilt), F.col("decoded.had_bom")).alias("output"), output_filename(F.col("name")).alias("output_name"),
    )


def write_outputs(done: DataFrame, path: str) -> None:
    """The rebuilt files as a table of names and bytes."""
    done.where(F.col("output").isNotNull()).select("path", "output_name", "output").write.mode("overwrite").parquet(path)
