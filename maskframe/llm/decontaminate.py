"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's word windows.

A shard is one Arrow batch of documents. Its words are replaced by numbers of the benchmark's vocabulary; a word
outside it can't be part of a match and ends a stretch, and so does a document's end; stretches shorter than the
shortest window are left out. Over the remaining stretches, each closed by a separator of its own, the shard's
suffix array gives a Burrows-Wheeler transform that is kept in a wavelet matrix. All windows are searched
backwards at once, a word a step, through the matrix's ranks; rows of the ranges found are walked to sampled
suffix positions. Occurrences become word spans, which are merged per document.

No shuffle: the benchmark's windows go to the executors, in blocks of at most ``BLOCK_BYTES`` of text; with more
blocks the documents pass through one map per block, each adding to what the earlier ones found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm import words as W
from maskframe.llm.shared import ensure_importable, fresh, release

U64 = np.uint64
WINDOW = 10
BLOCK_BYTES = 8 << 20
SAMPLE = 8


def wavelet(symbols: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Wavelet matrix: for each bit from the highest, packed flags, ones before each 64-bit word, and the zeros."""
    levels, cur = [], symbols
    for b in range(bits - 1, -1, -1):
        one = (cur >> b) & 1 == 1
        padded = np.zeros((len(one) // 64 + 1) * 64, bool)
        padded[: len(one)] = one
        packed = np.packbits(padded, bitorder="little").view(U64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]])
        levels.append((packed, before, int(len(one) - one.sum())))
        cur = np.concatenate([cur[~one], cur[one]])
    return levels


def _ones(level: tuple[np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
    packed, before, _ = level
    word = at >> 6
    mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
    return before[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)


class FMIndex:
    """Index of word-number stretches; 0 stands for all separators."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, sigma: int):
        n, seps = len(tokens) + len(lengths), len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = tokens
        self.sigma, self.n = sigma, n
        # separators differ from each other, so a comparison of suffixes ends at the first one
        rank = text + seps
        rank[ends] = np.arange(seps)
        order = np.argsort(rank, kind="stable")
        step, longest = 1, int(lengths.max(initial=0)) + 1
        while True:
            sorted_rank = rank[order]
            if step > 1:
                nxt = np.zeros(n, np.int64)
                nxt[: n - step // 2] = rank[step // 2 :] + 1
                key = rank * (n + seps + sigma + 2) + nxt
                order = np.argsort(key, kind="stable")
                sorted_rank = key[order]
            new = np.ones(n, bool)
            new[1:] = sorted_rank[1:] != sorted_rank[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all() or step > 2 * longest:
                break
            step *= 2
        self.bwt = np.where(order > 0, text[order - 1], 0)
        counts = np.bincount(text, minlength=sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.bits = max(1, int(sigma).bit_length())
        self.levels = wavelet(self.bwt, self.bits)
        heads = np.zeros(n, bool)
        heads[0] = True
        heads[ends[:-1] + 1] = True
        sampled = heads[order] | (order % SAMPLE == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before row ``at`` of the transform."""
        low = np.zeros(len(at), np.int64)
        high = at
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> b) & 1 == 1
            ol, oh = _ones(level, low), _ones(level, high)
            low = np.where(one, level[2] + ol, low - ol)
            high = np.where(one, level[2] + oh, high - oh)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases (a row each, of one length): numbers of those found, and their row ranges."""
        ids = np.arange(len(phrases))
        c = phrases[:, -1]
        low, high = self.before[c], self.before[c + 1]
        for j in range(phrases.shape[1] - 1, -1, -1):
            if j < phrases.shape[1] - 1:
                c = phrases[ids, j]
                low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            live = low < high
            ids, low, high = ids[live], low[live], high[live]
            if not len(ids):
                break
        return ids, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each is walked back until a sampled one."""
        out = np.zeros(len(rows), np.int64)
        at, steps, todo = rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.samples[self.sample_rank[at[done]]] + steps
            at, todo = at[~done], todo[~done]
            c = self.bwt[at]
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.string())
        raw, bounds = W.text_buffers(texts)
        w = W.split_words(raw, bounds, W.alnum_table())
        self.vocabulary = np.unique(w.hash)
        number = np.searchsorted(self.vocabulary, w.hash) + 1
        found: dict[tuple[int, ...], set] = {}
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            size = min(window, b - a)
            for s in range(a, b - size + 1) if size else ():
                found.setdefault(tuple(number[s : s + size].tolist()), set()).add(items[i][0])
        self.phrases, self.items = [], []
        for size in sorted({len(p) for p in found}):
            group = [p for p in found if len(p) == size]
            self.phrases.append(np.array(group, np.int64))
            self.items.append([sorted(x for x in found[p] if x is not None) for p in group])
        self.shortest = min((p.shape[1] for p in self.phrases), default=0)
        self.bloom = np.zeros(1 << 18, bool)
        self.bloom[self.vocabulary >> U64(46)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        maybe = np.flatnonzero(self.bloom[h >> U64(46)])
        at = np.searchsorted(self.vocabulary, h[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == h[maybe]
        out[maybe[same]] = at[same] + 1
        return out


def _stretches(number: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches of known words inside one document."""
    known = number > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    cut = first[:-1][first[:-1] < len(known)]
    begin[cut] = known[cut]
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    cut = cut[cut > 0]
    stop[cut - 1] = known[cut - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    keep = e - s >= shortest
    return s[keep], (e - s)[keep]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)


def search_shard(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[list[int]]]:
    """Of each document: its words, hit words as sorted (first byte, end byte, word) rows, and items with occurring windows."""
    table = W.alnum_table()
    n_docs = len(column)
    counts = np.zeros(n_docs, np.int64)
    parts = {x: [] for x in ("number", "length", "start", "end", "doc", "word")}
    for at, w in W.batches(column, table):
        counts[at : at + w.docs] = w.counts
        if not phrases.phrases:
            continue
        number = phrases.numbers(w.hash)
        s, length = _stretches(number, w.first, phrases.shortest)
        if not len(s):
            continue
        words = _ragged(s, length)
        doc = np.searchsorted(w.first, words, "right") - 1
        parts["number"].append(number[words].astype(np.int64))
        parts["length"].append(length)
        parts["start"].append(w.start[words] - w.doc_bytes[doc])
        parts["end"].append(w.end[words] - w.doc_bytes[doc])
        parts["doc"].append(doc + at)
        parts["word"].append(words - w.first[doc])
    hits: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * n_docs
    items: list[list[int]] = [[] for _ in range(n_docs)]
    if not parts["number"]:
        return counts, hits, items
    p = {k: np.concatenate(v) for k, v in parts.items()}
    index = FMIndex(p["number"], p["length"], len(phrases.vocabulary))
    # text positions count the separators before them
    stretch = np.repeat(np.arange(len(p["length"])), p["length"])
    word_at = np.full(index.n, -1, np.int64)
    word_at[np.arange(len(stretch)) + stretch] = np.arange(len(stretch))
    covered = np.zeros(len(stretch) + 1, np.int64)
    for group, owners in zip(phrases.phrases, phrases.items, strict=True):
        ids, low, high = index.search(group)
        if not len(ids):
            continue
        rows = _ragged(low, high - low)
        phrase = np.repeat(ids, high - low)
        first = word_at[index.locate(rows)]
        np.add.at(covered, first, 1)
        np.add.at(covered, first + group.shape[1], -1)
        for d, q in np.unique(np.stack([p["doc"][first], phrase], 1), axis=0).tolist():
            items[d].extend(owners[q])
    hit = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
    if len(hit):
        docs = p["doc"][hit]
        cuts = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])), len(hit))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = hit[a:b]
            hits[int(docs[a])] = np.stack([p["start"][at], p["end"][at], p["word"][at]], 1)
    return counts, hits, items


_FOUND = "n_words long, hit binary, items array<long>"


def _with_findings(docs: DataFrame, block: list, text_col: str, window: int, again: bool, cut: bool, marks: list[str]) -> DataFrame:
    """``docs`` with the findings of one block added to those of earlier ones, or with all of them cut from the text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)
    n_words, hit, held = marks
    names = [c for c in docs.columns if not (again and c in marks)]
    at = names.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names), *([] if cut else [f"{n_words} long, {hit} binary, {held} array<long>"])])

    def run(batches):
        release()
        phrases = Phrases(sent.value, window)
        for b in batches:
            counts, hits, items = search_shard(b.column(at), phrases)
            if again:
                old = b.column(b.schema.get_field_index(hit)).to_pylist()
                hits = [np.unique(np.concatenate([np.frombuffer(o, np.int64).reshape(-1, 3), h]), axis=0) for o, h in zip(old, hits, strict=True)]
                items = [o + i for o, i in zip(b.column(b.schema.get_field_index(held)).to_pylist(), items, strict=True)]
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            if cut:
                found = pa.array([h.tobytes() for h in hits], pa.binary())
                for part in W.slices(pa.RecordBatch.from_arrays([*kept, found], [*names, hit]), at):
                    texts = [_cut(t, h) for t, h in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))], names)
            else:
                done = pa.RecordBatch.from_arrays([*kept, pa.array(counts), pa.array([h.tobytes() for h in hits], pa.binary()), pa.array([sorted(set(i)) for i in items], pa.list_(pa.int64()))], [*names, *marks])
                yield from W.slices(done, at)

    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """``docs`` with ``_n_words``, ``_hit`` (hit words as int64 triples: first byte, end byte, word number) and ``_items``.

    Words are runs of ASCII letters and digits, A-Z in lower case, and all of non-ASCII characters. An item's
    windows are its ``window`` consecutive words, or all its words if it has fewer; no words, no window. A null
    text has no words. An item with a null item_id marks words, but isn't listed; repeated items count once.
    Rows of ``docs`` keep their number and order of columns, repeated ones too. With ``cut`` the result is ``docs``
    without the merged spans of hit words. Where ``docs`` has a column of one of the three names, all three get more
    underscores in front. An empty table stays empty; texts of any length are searched whole.
    """
    marks = fresh(docs.columns, "n_words", "hit", "items")
    ensure_importable(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs
    for i in range(blocks):
        # a block is bounded: block_bytes of text, but for the spread of the hash
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        out = _with_findings(out, [(r.item_id, r.text) for r in part.where("text is not null").collect()], text_col, window, i > 0, cut and i == blocks - 1, marks)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of documents."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    ids = F.concat_ws(",", F.sort_array(F.transform("_items", lambda x: x.cast("string"))))
    n_hit = (F.octet_length("_hit") / 24).cast("long")
    return found.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut(text: str | None, hit: bytes) -> str | None:
    if text is None or not hit:
        return text
    raw = text.encode()
    rows = np.frombuffer(hit, np.int64).reshape(-1, 3)
    new = np.append(True, rows[1:, 2] != rows[:-1, 2] + 1)
    starts, ends = rows[new, 0], rows[np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1), 1]
    out, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the merged spans of hit words cut from the text; all other characters and rows stay."""
    return find_contamination(docs, benchmark, text_col, cut=True)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict:
    """What :func:`contamination_report` gives, by plain Python, for tests."""
    import re

    def split(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    owners: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if k else ():
            owners.setdefault(tuple(w[s : s + k]), set()).add(i)
    sizes = {len(p) for p in owners}
    out = {}
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (p := tuple(w[s : s + k])) in owners:
                    hit.update(range(s, s + k))
                    found |= owners[p]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out[d] = (len(w), len(hit), len({x for x in found if x is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out
