"""BPE encoding and decoding by speculation: longest matches, a vectorised test of neighbours, merging only where it fails.

A sequence of tokens is what merging yields exactly if every two neighbours would stay apart when merged alone, so
a greedy longest-match proposal needs one test per distinct pair of neighbours. The test undoes the two tokens'
merges backwards in time, for all pairs at once in numpy, and looks up at each moment whether a merge joins the
two symbols that meet at the border before either is used up. Words that hold a failing pair are merged exactly.

Texts are cut at ASCII white space into chunks, told apart by hashes over whole batches; the ids of up to
``REMEMBERED`` chunks are kept in arrays by a worker for its later tasks. Chunks are cut into pieces by the
vocabulary's pattern. Ids and token strings become text by gathers from a table of each id's characters. The
vocabulary is a file in the format of the tokenizers library; its path is a parameter, and executors get its
contents from the driver.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from maskframe.llm import words as W
from maskframe.llm.idstore import IdStore, ragged
from maskframe.llm.shared import ensure_importable, held

REMEMBERED = 1_000_000
#: Pieces whose ids are kept as Python lists, and bytes of text handled at once.
PIECES = 100_000
GROUP_BYTES = 1 << 20
_NONE = np.int64(1) << 40


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SpeculativeBPE:
    """A BPE model with an end-of-word suffix or none."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.suffix = suffix or ""
        self.strings = {i: s for s, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for s, i in vocab.items():
            if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix):
                self.final[s[: -len(self.suffix)]] = i
            else:
                self.inner[s] = i
        if not self.suffix:
            self.final = self.inner
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.made = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.shared: set[int] = set()
        keys, ranks = [], []
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.made[z] >= 0:
                self.shared.add(z)  # two merges make it: the test below can't undo it
            else:
                self.made[z], self.left[z], self.right[z] = r, x, y
            self.ranks[x, y] = (r, z)
            keys.append(x * size + y)
            ranks.append(r)
        order = np.argsort(keys)
        self.size, self.keys, self.key_ranks = size, np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)
        # a proposed token must be what merging makes of its own string
        self.plain = {i for i in range(size) if self.made[i] >= 0 or len(self.strings.get(i, "").removesuffix(self.suffix)) == 1}
        self.product = np.array([self.ranks[x][1] for x in self.ranks], np.int64)
        # by their first two and three characters, the lengths that inner tokens have, longest first
        lengths: dict[str, set[int]] = {}
        for t, i in self.inner.items():
            if i in self.plain and len(t) > 1:
                for k in (2, 3):
                    lengths.setdefault(t[:k], set()).add(len(t))
        for t, sizes in lengths.items():
            if len(t) == 3 and t[:2] in self.inner:
                sizes.add(2)
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def propose(self, word: str) -> list[int] | None:
        """The longest tokens from the left on; None where a character has none."""
        out, at, n = [], 0, len(word)
        inner, final, lengths, plain = self.inner, self.final, self.lengths, self.plain
        while True:
            if (t := final.get(word[at:])) is not None and t in plain:
                out.append(t)
                return out
            sizes = lengths.get(word[at : at + 3])
            for size in sizes if sizes is not None else (2,):
                if at + size < n and (t := inner.get(word[at : at + size])) is not None and t in plain:
                    break
            else:
                size = 1
                if at + 1 >= n or (t := inner.get(word[at])) is None:
                    return None
            out.append(t)
            at += size

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would keep tokens a and b apart, elementwise."""
        ok = np.ones(len(a), bool)
        todo = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        used_x = np.full(len(a), _NONE)  # when x becomes part of a larger symbol
        used_y = np.full(len(a), _NONE)
        while len(todo):
            m = self.merge_rank(x, y)
            # of equal merges the leftmost comes first: x's own use precedes the border, the border precedes y's
            bad = (m < used_x) & (m <= used_y) & (m < _NONE)
            ok[todo[bad]] = False
            mx, my = self.made[x], self.made[y]
            live = ~bad & (np.maximum(mx, my) >= 0)
            todo, x, y, used_x, used_y, mx, my = (v[live] for v in (todo, x, y, used_x, used_y, mx, my))
            back_x = mx > my
            used_x = np.where(back_x, mx, used_x)
            used_y = np.where(back_x, used_y, my)
            x = np.where(back_x, self.right[x], x)
            y = np.where(back_x, y, self.left[y])
        return ok

    def start_ids(self, word: str) -> list[int]:
        return [*map(self.inner.__getitem__, word[:-1]), self.final[word[-1]]]

    def merge(self, word: str) -> list[int]:
        """Exact merging of one long word: the lowest rank first, leftmost of equals, by a heap over linked symbols."""
        ids = self.start_ids(word)
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.ranks.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.ranks[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.ranks.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (r[0], k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many words side by side: a row each, one merge of every unfinished row a round."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for lo in range(0, len(order), 8192):
            rows = order[lo : lo + 8192]
            short = [i for i in rows if len(words[i]) <= 64]
            for i in rows[len(short) :]:
                out[i] = self.merge(words[i])
            if not short:
                continue
            starts = [self.start_ids(words[i]) for i in short]
            width = len(starts[-1])
            ids = np.full((len(short), width + 1), -1, np.int64)
            for n, group in itertools.groupby(enumerate(starts), key=lambda x: len(x[1])):
                group = list(group)
                ids[group[0][0] : group[-1][0] + 1, :n] = [g[1] for g in group]
            ranks = np.where(ids[:, 1:] >= 0, self.merge_rank(ids[:, :-1], ids[:, 1:]), _NONE)
            live = np.arange(len(short))
            while len(live):
                at = ranks[live].argmin(1)
                go = ranks[live, at] < _NONE
                live, at = live[go], at[go]
                if not len(live):
                    break
                ids[live, at] = self.product[ranks[live, at]]
                # everything after the merged pair moves one place to the left
                shift = np.arange(width)[None, :] > at[:, None]
                moved = ids[live]
                moved[:, :-1] = np.where(shift, moved[:, 1:], moved[:, :-1])
                moved[:, -1] = -1
                ids[live] = moved
                old = ranks[live]
                old[:, :-1] = np.where(shift[:, :-1], old[:, 1:], old[:, :-1])
                old[:, -1] = _NONE
                ranks[live] = old
                for k in (at - 1, at):
                    inside = k >= 0
                    r, c = live[inside], k[inside]
                    x, y = ids[r, c], ids[r, c + 1]
                    ranks[r, c] = np.where(y >= 0, self.merge_rank(x, y), _NONE)
            for i, row, n in zip(short, ids.tolist(), (ids >= 0).sum(1).tolist(), strict=True):
                out[i] = row[:n]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of non-empty words in the byte alphabet."""
        out = [self.propose(w) or [] for w in words]
        lengths = np.array([len(t) for t in out])
        flat = np.fromiter(itertools.chain.from_iterable(out), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(words)), lengths)
        inside = word[:-1] == word[1:]
        keys, where = np.unique((flat[:-1] * self.size + flat[1:])[inside], return_inverse=True)
        fails = lengths == 0
        if len(keys):
            apart = self.compatible(keys // self.size, keys % self.size)
            fails[word[:-1][inside][~apart[where]]] = True
        if self.shared:
            fails[word[np.isin(flat, list(self.shared))]] = True
        failing = np.flatnonzero(fails).tolist()
        for i, t in zip(failing, self.merge_many([words[i] for i in failing]), strict=True):
            out[i] = t
        return out


class Characters:
    """Texts of ids, each with a space after it, to be joined by gathers."""

    def __init__(self, texts: dict[int, str]):
        size = max(texts) + 1
        raw = [(texts.get(i, "") + " ").encode() for i in range(size)]
        self.length = np.array([len(r) for r in raw])
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids' texts of each document, joined by spaces."""
        length = self.length[ids]
        before = np.concatenate([[0], np.cumsum(length)])
        text = self.data[ragged(self.begin[ids], length, before)].tobytes()
        ends = before[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class WordCoder:
    """Whole texts to ids for a lower-casing vocabulary that drops white space."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or level["use_regex"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("the vocabulary file prepares its texts in a way that isn't supported")
        self.bpe = SpeculativeBPE(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.lined = regex.compile(r"\n|" + split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.alphabet = byte_alphabet()
        strings = self.bpe.strings | {i: s for s, i in self.special.items()}
        self.numbers, self.strings = Characters({i: str(i) for i in strings}), Characters(strings)
        self.pieces: dict[str, list[int] | None] = {}
        self.store = IdStore()
        self.table = W.space_table(lower=True)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # character by character: a sigma at a word's end gets no form of its own
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def spelled(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        a = self.alphabet
        return "".join([a[b] for b in piece.encode()])

    def _pieces(self, cut: list[str]) -> dict[str, list[int] | None]:
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        self.pieces["\n"] = None  # stands between chunks; no piece holds white space
        new = list(set(cut).difference(self.pieces))
        if new:
            self.pieces.update(zip(new, self.bpe.encode_words([self.spelled(p) for p in new]), strict=True))
        return self.pieces

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and how many each has: all are cut into pieces in one pass."""
        cut = self.lined.findall(self.normal(b"\n".join(chunks).decode()))
        get = self._pieces(cut).__getitem__
        ids: list[int] = []
        ends = []
        for g in map(get, cut):
            if g is None:
                ends.append(len(ids))
            else:
                ids += g
        ends.append(len(ids))
        return np.diff(np.array(ends), prepend=0), np.array(ids, np.uint32)

    def encode_whole(self, text: str) -> list[int]:
        """One text, with strings of special tokens as their ids."""
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                cut = self.pattern.findall(self.normal(part))
                get = self._pieces(cut).__getitem__
                for p in cut:
                    out += get(p)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids; null is empty."""
        raw, bounds = W.text_buffers(column)
        marks = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if len(raw) else np.zeros(0, np.int64)
        whole = np.unique(np.searchsorted(bounds, marks, "right") - 1)  # documents that may hold a special token
        w = W.split_words(raw, bounds, self.table)
        unique, at, where = np.unique(w.hash, return_index=True, return_inverse=True)
        slots = self.store.slots(unique)
        new = np.flatnonzero(slots < 0)
        if len(new):
            if len(self.store) + len(new) > REMEMBERED:
                self.store = IdStore()
                new = np.arange(len(unique))
            text = raw.tobytes()
            self.store.add(unique[new], *self._learn([text[a:b] for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)]))
            slots = self.store.slots(unique)
        flat, size = self.store.gather(slots[where])
        counts = np.bincount(np.repeat(np.arange(w.docs), w.counts), size, minlength=w.docs).astype(np.int64)
        if len(whole):
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, t in zip(whole.tolist(), column.take(pa.array(whole)).to_pylist(), strict=True):
                parts[i] = np.array(self.encode_whole(t), np.uint32)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, counts


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _coder(spec: dict) -> WordCoder:
    """One coder per worker process and vocabulary: what it remembers serves the worker's later tasks."""
    merges = spec["model"]["merges"]
    key = hashlib.sha256(repr((len(merges), merges[:2000], merges[-2000:], spec["pre_tokenizer"])).encode()).hexdigest()
    return held(f"words-{key}", lambda: WordCoder(spec))


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; ``with_ids`` adds ``ids``.

    No special tokens are added, nothing is cut or padded; strings of special tokens in a text become their ids.
    A null text is empty: no tokens, and the hash of the empty string twice.
    """
    ensure_importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        coder = _coder(sent.value)
        for b in batches:
            _, bounds = W.text_buffers(b.column(1))
            for lo, hi in W.chunks(bounds, GROUP_BYTES):
                ids, n = coder.encode(b.column(1).slice(lo, hi - lo))
                sums = [[hashlib.sha256(t).hexdigest() for t in c.join(ids, n)] for c in (coder.numbers, coder.strings)]
                columns = [b.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(x, pa.string()) for x in sums)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
