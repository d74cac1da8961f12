"""Token ids as ORC: stripes with run-length coded integers, row indexes, and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, so that files hold ascending ids: stripe and row-group minima and
maxima prune a range of ids, the Bloom filters a single id, and readers take stripes in parallel. A row carries its
offset among its file part's ids; part totals, one small row each, turn that into the corpus-wide start.

Each distinct space-delimited chunk is encoded once per Python worker, up to ``REMEMBERED`` of them. The byte-level
pattern never joins characters across a single space between two other characters (the space starts the next
piece), so chunks are encoded alone: many new ones in one string, cut apart again by the byte lengths of the ids.
Chunks are told apart by 64-bit hashes and ids are gathered from one array, without a Python object per chunk.
Texts with other spacing, or with the string of a special token, go through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskframe.llm import words as W
from maskframe.llm.idstore import IdStore
from maskframe.llm.shared import ensure_importable, held, shared_folder

END_ID = 0
REMEMBERED = 1_000_000
GROUP_BYTES = 2 << 20
SCHEMA = "doc_id long, part int, part_offset long, n_ids int, ids array<int>"
_CHUNKS = np.arange(256, dtype=np.uint8)
_CHUNKS[0] = 255  # never in UTF-8; 0 marks the separator
_CHUNKS[32] = 0
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True


def irregular(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Documents in which white space follows a space, or that end in a space or hold ``<|``."""
    out = np.zeros(len(bounds) - 1, bool)
    if not len(raw):
        return out
    ends = np.zeros(len(raw), bool)
    ends[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    p = np.flatnonzero(raw == 32)
    far = np.concatenate([raw, np.zeros(3, np.uint8)])
    x, y, z = far[p + 1], far[p + 2], far[p + 3]
    wide = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) | (x == 0xE2) & ((y == 0x80) | (y == 0x81)) & ((z <= 0x8A) | (z == 0x9F) | (z >= 0xA8) & (z <= 0xAF)) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    bad = p[ends[p] | _ASCII_SPACE[x] | wide]
    mark = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
    at = np.concatenate([bad, mark])
    out[np.searchsorted(bounds, at, "right") - 1] = True
    return out


class ChunkEncoder:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        level = spec["pre_tokenizer"]
        self.whole_only = spec["normalizer"] is not None or level["type"] != "ByteLevel" or level["add_prefix_space"] or not level["use_regex"] or spec["post_processor"] is not None or any("<|" not in t["content"] for t in spec["added_tokens"])
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for s, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = len(s)
        self.store = IdStore()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of chunks that follow a space in the text, and how many each has."""
        sizes, found = [], []
        for at in range(0, len(chunks), 1000):
            some = chunks[at : at + 1000]
            ids = self._library([(b" " + b" ".join(some)).decode()])[0]
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum([len(c) + 1 for c in some])
            cuts = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cuts - 1], wanted):
                raise RuntimeError("a token spans two chunks")
            sizes.append(np.diff(cuts, prepend=0))
            found.append(ids)
        return sizes, found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids; null is empty."""
        raw, bounds = W.text_buffers(column)
        whole = irregular(raw, bounds) if not self.whole_only else np.diff(bounds) > 0
        w = W.split_words(raw, bounds, _CHUNKS)
        doc = np.repeat(np.arange(w.docs), w.counts)
        first = w.start == w.doc_bytes[doc]
        key = np.where(first, W.mix(w.hash ^ W.U64(0x5851F42D4C957F2D)), w.hash)
        use = ~whole[doc]
        if whole.any():
            key, doc, first = key[use], doc[use], first[use]
        start, end = (w.start[use], w.end[use]) if whole.any() else (w.start, w.end)
        unique, at, where = np.unique(key, return_index=True, return_inverse=True)
        slots = self.store.slots(unique)
        new = np.flatnonzero(slots < 0)
        if len(new):
            if len(self.store) + len(new) > REMEMBERED:
                self.store = IdStore()
                new = np.arange(len(unique))
            text = raw.tobytes()
            head = first[at[new]]
            plain, heads = new[~head], new[head]
            sizes, found = self._learn([text[a:b] for a, b in zip(start[at[plain]].tolist(), end[at[plain]].tolist(), strict=True)])
            if len(heads):
                got = self._library([text[a:b].decode() for a, b in zip(start[at[heads]].tolist(), end[at[heads]].tolist(), strict=True)])
                sizes.append(np.array([len(g) for g in got]))
                found += got
            self.store.add(unique[np.concatenate([plain, heads])], np.concatenate(sizes), np.concatenate(found))
            slots = self.store.slots(unique)
        flat, size = self.store.gather(slots[where])
        counts = np.bincount(doc, size, minlength=w.docs).astype(np.int64)
        if whole.any():
            texts = column.take(pa.array(np.flatnonzero(whole))).to_pylist()
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in zip(np.flatnonzero(whole).tolist(), self._library(texts), strict=True):
                parts[i] = ids
                counts[i] = len(ids)
            flat = np.concatenate(parts)
        return flat, counts


def _encoder(vocabulary: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary: what it remembers serves the worker's later tasks."""
    return held(f"chunks-{hashlib.sha256(vocabulary.encode()).hexdigest()}", lambda: ChunkEncoder(vocabulary))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write doc_id, part, part_offset and ids (with ``end_id`` at the end) in ascending doc_id order.

    Rows that repeat a doc_id come in the order of their texts' hashes; a null doc_id comes first. A null or empty
    text has only the end id.
    """
    ensure_importable(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        coder = _encoder(sent.value)
        part, offset = TaskContext.get().partitionId(), 0
        for b in batches:
            _, bounds = W.text_buffers(b.column(1))
            for lo, hi in W.chunks(bounds, GROUP_BYTES):
                flat, counts = coder.encode(b.column(1).slice(lo, hi - lo))
                sizes = counts + 1
                ends = np.cumsum(sizes)
                ids = np.full(ends[-1], end_id, np.int32)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = flat
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(offset + ends - sizes), pa.array(sizes.astype(np.int32)), values], ["doc_id", "part", "part_offset", "n_ids", "ids"])
                offset += int(ends[-1])

    # text that repeats under one doc_id is spread by its hash
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("compression", "lz4")
        .orc(path)
    )


def _part_starts(rows: DataFrame) -> DataFrame:
    """(part, before): ids in earlier file parts; one row per part."""
    totals = rows.groupBy("part").agg(F.max(F.col("part_offset") + F.col("n_ids")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids and their place in the whole corpus."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.join(_part_starts(rows), "part").select("doc_id", (F.col("before") + F.col("part_offset")).alias("start"), "ids")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files at ``path``; ids are reduced before anything is joined."""

    def run(batches):
        for b in batches:
            ids = b.column(4)
            bounds = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "part_offset", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).orc(path)
    digest = rows.mapInArrow(run, "doc_id long, part int, part_offset long, n_tokens long, ids_crc32 long")
    return digest.join(_part_starts(rows), "part").select("doc_id", (F.col("before") + F.col("part_offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the documents' ids, read the files back and give their digest."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary)
    return token_digest(spark, path)
