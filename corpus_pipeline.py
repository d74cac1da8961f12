"""Corpus pipeline: documents to token ids, a stage at a time.

Each stage is ``(name, function)`` with ``function(spark, docs, sf_dir)``, works on all that the stage before it kept,
and returns the columns of ``documents``, but for the last, which returns token ids. :func:`run` writes every stage's
rows as Parquet to the shared folder and reads them again, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm.bpe import encode_decode
from maskframe.llm.decontaminate import remove_contamination
from maskframe.llm.ngram_join import keep_one_of_each
from maskframe.llm.queries import _vocabulary
from maskframe.llm.secrets import ranked_words, redact_secrets
from maskframe.llm.shared import discard, ensure_importable, scratch, shared_folder
from maskframe.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the classifier learns from those labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return reject_toxic(docs, docs, labels)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the one with the smallest doc_id stays."""
    return keep_one_of_each(docs, k=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of benchmark windows are cut from the texts; documents without any stay as they are."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The values of secrets are masked in the texts."""
    return redact_secrets(docs, ranks=ranked_words(_vocabulary("word_bpe_49k.json")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with hashes of the ids and of the text decoded from them."""
    return encode_decode(docs, _vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding", bpe_encoding),
]

#: A trained classifier, a similarity join and merges by rank aren't expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        before, path = path, f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)  # the next stage's rows are written
        docs = spark.read.parquet(path)
    return docs
