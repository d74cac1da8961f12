"""Substring deduplication by relative Lempel-Ziv parsing.

Reference documents lie in blocks by the hash of their doc_id. Only those stretches of a document that a block can
explain are factored against it, so no document meets every block:

1. Routing. Every window of ``WINDOW`` words is looked up by hash among all others. Rows travel by anchor, the least
   hash of the 7-word phrases inside a window: neighbouring windows mostly share it, so a row holds a run of windows.
   A window that a smaller doc_id holds is sent to the block of the smallest holder, whose own window is marked as
   reference. A run of documents settles its own repeats first, by its own smallest holder, so a passage in a third of
   all documents costs each run one entry.
2. Indexing. A block's index are the marked stretches of its documents: exact ranks of their phrases of 1, 2, 4, 8 and
   ``WINDOW`` words, by doubling.
3. Parsing. Each stretch is factored greedily from the left: the longest common run with a reference of smaller doc_id,
   words compared exactly. Where a factor ends, the windows across its border are looked up, and the next factor starts
   at the first that is found. Words of factors, each at least a window long, are duplicate spans.

The routing pass, the one that holds whole texts, also gives each document's result as it is when its stretches parse
to the end. They do but for collisions of hashes; documents with a window that no factor holds are done again.
A block whose stretches exceed ``BLOCK_STRETCHES`` bytes is served by several tasks with a copy of its references each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm import words as W
from maskframe.llm.shared import ensure_importable, shuffle_width, stored

U64 = np.uint64
WINDOW = 13
#: Words of an anchor phrase; a window holds WINDOW - ANCHOR + 1 of them.
ANCHOR = 7
RUN_BYTES = 8 << 20
PHRASES_PER_GROUP = 2_500_000
#: Bytes of documents of one reference block, and of the stretches that one task parses against it.
BLOCK_BYTES = 16 << 20
BLOCK_STRETCHES = 32 << 20
#: References of the same window that a factor chooses the longest from; the border check makes up for the others.
CHOICES = 16
_RUNS = ("doc", "row", "count", "place", "size")
_SENT_NAMES = ["r", "anchor", "window", *(f"{k}_{n}" for k in "slf" for n in _RUNS), "l_block"]
_SENT = "r int, " + ", ".join(f"{n} binary" for n in _SENT_NAMES[1:])
_FOUND_NAMES = ["bucket", *(f"{k}_{n}" for k in "df" for n in _RUNS), "d_block"]
_FOUND = "bucket int, " + ", ".join(f"{n} binary" for n in _FOUND_NAMES[1:])
_EMPTY = np.zeros(0, np.int64)


def _pack(owner: np.ndarray, place: np.ndarray, key: np.ndarray, doc: np.ndarray, row: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Sorted (owner, place) rows as runs of neighbouring places with one key: the owners' ids, row marks and numbers
    of runs, the runs' places and sizes, ids and places as steps; and the runs' heads."""
    n = len(owner)
    if not n:
        return [b""] * 5, _EMPTY
    new = np.ones(n, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (key[1:] != key[:-1])
    at = np.arange(n)
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % 255 == 0
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, n)).astype(np.uint8)
    local, first, counts = np.unique(owner[heads], return_index=True, return_counts=True)
    starts = place[heads].astype(np.int64)
    step = np.diff(starts, prepend=0)
    step[first] = starts[first]
    kind = np.uint16 if step.max(initial=0) < 1 << 16 else np.uint32
    return [np.diff(doc[local], prepend=0).tobytes(), row[local].tobytes(), counts.astype(np.uint32).tobytes(), step.astype(kind).tobytes(), size.tobytes()], heads


def _unpack(doc, row, count, place, size) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row marks and places, a row for each place, and the sizes of the runs."""
    counts = np.frombuffer(count, np.uint32).astype(np.int64)
    total = int(counts.sum())
    step = np.frombuffer(place, np.uint32 if len(memoryview(place)) == 4 * total else np.uint16).astype(np.int64)
    run = np.cumsum(step)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[: len(counts)]
    starts = run - np.repeat(run[first] - step[first], counts)
    sizes = np.frombuffer(size, np.uint8).astype(np.int64)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spread = lambda x: np.repeat(np.repeat(x, counts), sizes)
    return spread(np.cumsum(np.frombuffer(doc, np.int64))), spread(np.frombuffer(row, np.int32)), np.repeat(starts, sizes) + within, sizes


def _bytes(x: np.ndarray, n: int) -> bytes:
    return x.astype(U64).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_bytes(raw, n: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, n)
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, :n] = part
    return wide.reshape(-1).view(U64)


def _block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (W.mix(doc.astype(np.int64).view(U64) + U64(77)) % U64(blocks)).astype(np.int64)


def _groups(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In order of hash: that order, the smallest id of each row's group, whether the row's id is greater, and whether
    the row is the one holder with the smallest id that stands for a group with greater ones."""
    order = np.argsort(h, kind="stable")
    s, ds = h[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    head, number = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.minimum.reduceat(ds, head)[number] if len(s) else ds
    later = ds > least
    wanted = np.bincount(number, later, minlength=len(head))[number] > 0 if len(s) else later
    holder = np.flatnonzero(wanted & ~later)
    one = np.zeros(len(s), bool)
    one[holder[np.append(True, number[holder][1:] != number[holder][:-1])] if len(holder) else holder] = True
    return order, least, later, one


def _anchors(w: W.Words, window: int) -> np.ndarray:
    """For each word the least hash of the anchor phrases in the window that starts there."""
    k = min(ANCHOR, window)
    h, _ = W.windows(w, k)
    low, reach = h, 1
    while reach < window - k + 1:
        step = min(reach, window - k + 1 - reach)
        nxt = low.copy()
        n = max(len(low) - step, 0)
        nxt[:n] = np.minimum(low[:n], low[step:])
        low, reach = nxt, reach + step
    return low


def _phrase_rows(window: int, groups: int, blocks: int):
    table = W.space_table(lower=False)

    def one_run(parts: list, doc: np.ndarray, row: np.ndarray):
        h, a, owner, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
        if not len(h):
            return None
        order, least, later, one = _groups(h, doc[owner])
        marked, ref = np.zeros(len(h), bool), np.zeros(len(h), bool)
        marked[order[later]] = True
        ref[order[one]] = True
        to = np.zeros(len(h), np.int64)
        to[order] = _block_of(least, blocks)
        local, mine = np.flatnonzero(marked), np.flatnonzero(ref)
        packed_l, heads = _pack(owner[local], place[local], to[local], doc, row)
        once = {**{f"l_{n}": v for n, v in zip(_RUNS, packed_l, strict=True)}, "l_block": to[local][heads].astype(np.int32).tobytes()}
        once |= {f"f_{n}": v for n, v in zip(_RUNS, _pack(owner[mine], place[mine], np.zeros(len(mine)), doc, row)[0], strict=True)}
        go = np.flatnonzero(~marked)
        r = (a[go] % U64(groups)).astype(np.int32)
        by = np.argsort(r, kind="stable")
        cuts = np.searchsorted(r[by], np.arange(groups + 1))
        out: dict[str, list] = {x: [] for x in _SENT_NAMES}
        first = int(r[0])
        for b in range(groups):
            rows = go[by[cuts[b] : cuts[b + 1]]]
            if not len(rows):
                continue
            packed, heads = _pack(owner[rows], place[rows], a[rows], doc, row)
            values = {"r": b, "anchor": _bytes(a[rows][heads] // U64(groups), 6), "window": _bytes(h[rows], 5), **{f"s_{n}": v for n, v in zip(_RUNS, packed, strict=True)}}
            values |= once if b == first else dict.fromkeys(once, b"")
            for n, v in values.items():
                out[n].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out["r"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in _SENT_NAMES[1:])], _SENT_NAMES)

    def run(batches):
        for b in batches:
            doc, row = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            parts, held = [], 0
            for at, w in W.batches(b.column(2), table):
                full, ok = W.windows(w, window)
                at_word = np.flatnonzero(ok)
                of = np.searchsorted(w.first, at_word, "right") - 1
                parts.append((full[at_word], _anchors(w, window)[at_word], of + at, (at_word - w.first[of]).astype(np.uint32)))
                held += len(w.data)
                if held >= RUN_BYTES:
                    if (out := one_run(parts, doc, row)) is not None:
                        yield out
                    parts, held = [], 0
            if parts and (out := one_run(parts, doc, row)) is not None:
                yield out

    return run


def _match_group(buckets: int, blocks: int):
    def f(table: pa.Table) -> pa.Table:
        """Windows that a smaller doc_id holds with the block of the smallest, and the windows that those refer to,
        packed by bucket of documents."""
        keys, sent, found, refs = [], [], [], []
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                get = lambda n: batch.column(batch.schema.get_field_index(n))[i].as_buffer()  # noqa: B023, E731
                d, w, p, sizes = _unpack(*(get(f"s_{n}") for n in _RUNS))
                anchor = np.repeat(_from_bytes(get("anchor"), 6), sizes)
                keys.append(W.mix(anchor * U64(0xD6E8FEB86659FD93) + _from_bytes(get("window"), 5)))
                sent.append((d, w, p))
                if get("l_count").size:
                    d, w, p, sizes = _unpack(*(get(f"l_{n}") for n in _RUNS))
                    found.append((d, w, p, np.repeat(np.frombuffer(get("l_block"), np.int32), sizes)))
                if get("f_count").size:
                    refs.append(_unpack(*(get(f"f_{n}") for n in _RUNS))[:3])
        d, w, p = (np.concatenate([x[i] for x in sent]) for i in range(3))
        order, least, later, one = _groups(np.concatenate(keys), d)
        at = order[later]
        found.append((d[at], w[at], p[at], _block_of(least[later], blocks)))
        at = order[one]
        refs.append((d[at], w[at], p[at]))
        packed = []
        for rows, keyed in ((found, True), (refs, False)):
            d, w, p = (np.concatenate([x[i] for x in rows]) for i in range(3))
            to = np.concatenate([x[3] for x in rows]) if keyed else np.zeros(len(d), np.int64)
            bucket = (W.mix(d.view(U64)) % U64(buckets)).astype(np.int32)
            order = np.lexsort((p, w, d, bucket))
            d, w, p, to, bucket = d[order], w[order], p[order], to[order], bucket[order]
            owner = np.cumsum(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]))) - 1 if len(d) else _EMPTY
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(d) else _EMPTY
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(d)).tolist() if len(d) else [0]
            by = {}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                runs, first = _pack(owner[a:b], p[a:b], to[a:b], d[heads], w[heads])
                by[int(bucket[a])] = (runs, to[a:b][first].astype(np.int32).tobytes())
            packed.append(by)
        none = ([b""] * 5, b"")
        names = sorted(packed[0].keys() | packed[1].keys())
        columns: dict[str, list] = {n: [] for n in _FOUND_NAMES}
        for b in names:
            (dr, block), (fr, _) = packed[0].get(b, none), packed[1].get(b, none)
            for n, v in zip(_FOUND_NAMES, [b, *dr, *fr, block], strict=True):
                columns[n].append(v)
        return pa.table([pa.array(columns["bucket"], pa.int32()), *(pa.array(columns[n], pa.binary()) for n in _FOUND_NAMES[1:])], names=_FOUND_NAMES)

    return f


def _merge_bucket(table: pa.Table) -> pa.Table:
    """One row per document row: the places of windows found, the blocks they refer to, and the places referred to."""
    found, refs = [], []
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            get = lambda n: batch.column(batch.schema.get_field_index(n))[i].as_buffer()  # noqa: B023, E731
            if get("d_count").size:
                d, w, p, sizes = _unpack(*(get(f"d_{n}") for n in _RUNS))
                found.append((d, w, p, np.repeat(np.frombuffer(get("d_block"), np.int32), sizes), np.zeros(len(d), np.int8)))
            if get("f_count").size:
                d, w, p, _ = _unpack(*(get(f"f_{n}") for n in _RUNS))
                refs.append((d, w, p, np.zeros(len(d), np.int32), np.ones(len(d), np.int8)))
    d, w, p, to, kind = (np.concatenate([x[i] for x in found + refs]) for i in range(5))
    order = np.lexsort((p, kind, w, d))
    d, w, p, to, kind = d[order], w[order], p[order], to[order], kind[order]
    keep = np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (kind[1:] != kind[:-1]) | (p[1:] != p[:-1]))
    d, w, p, to, kind = d[keep], w[keep], p[keep], to[keep], kind[keep]
    cuts = np.append(np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]))), len(d))
    out: dict[str, list] = {"places": [], "blocks": [], "refs": []}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        m = a + int(np.searchsorted(kind[a:b], 1))
        out["places"].append(p[a:m].astype(np.uint32).tobytes())
        out["blocks"].append(to[a:m].astype(np.int32).tobytes())
        out["refs"].append(p[m:b].astype(np.uint32).tobytes())
    return pa.table({"doc_id": d[cuts[:-1]], "row": w[cuts[:-1]], **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def _stretches(places: np.ndarray, key: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(first word, end, key) of each run of neighbouring places with one key."""
    if not len(places):
        return []
    new = np.append(True, (places[1:] != places[:-1] + 1) | (key[1:] != key[:-1]))
    head = np.flatnonzero(new)
    last = np.append(head[1:] - 1, len(places) - 1)
    return list(zip(places[head].tolist(), (places[last] + window).tolist(), key[head].tolist(), strict=True))


def _digest(words: list[bytes], places: np.ndarray, window: int) -> tuple[int, bytes]:
    """Words removed, and the kept ones joined, if all these windows are duplicates."""
    if not len(places):
        return 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for first, end, _ in _stretches(places, np.zeros(len(places), np.int64), window):
        cover[first] += 1
        cover[end] -= 1
    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
    return len(words) - len(stay), b" ".join([words[i] for i in stay])


def _ranks(tokens: np.ndarray, window: int) -> np.ndarray:
    """Number of the window that starts at each token, the same for equal windows: exact, by doubling."""

    def pair(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        nxt = np.zeros(len(a), np.int64)
        nxt[: max(len(a) - step, 0)] = b[step:] + 1
        return np.unique(a * (int(b.max(initial=0)) + 2) + nxt, return_inverse=True)[1].reshape(-1)

    rank, reach = tokens, 1
    while reach < window:
        step = min(reach, window - reach)
        rank, reach = pair(rank, rank, step), reach + step
    return rank


def parse_block(refs: list[tuple[int, bytes]], stretches: list[tuple[int, bytes]], window: int = WINDOW) -> list[tuple[list[tuple[int, int, int, int]], list[int]]]:
    """Relative Lempel-Ziv parse of each stretch (doc_id, words) against references (doc_id, words) of smaller ids.

    Gives for each stretch its factors (first word, words, number of the reference, place in it), and the windows that
    no factor holds.
    """
    pieces = [t.split(b" ") for _, t in refs] + [t.split(b" ") for _, t in stretches]
    numbers: dict[bytes, int] = {}
    size = np.array([len(x) for x in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    tokens = np.zeros(int(begin[-1]), np.int64)
    for i, x in enumerate(pieces):
        tokens[begin[i] : begin[i] + size[i]] = [numbers.setdefault(w, len(numbers)) for w in x]
    # a separator of its own closes each piece, so no window crosses it
    tokens[begin[1:] - 1] = len(numbers) + np.arange(len(pieces))
    ids = _ranks(tokens, window)
    at = np.concatenate([np.arange(begin[i], begin[i] + max(size[i] - window + 1, 0)) for i in range(len(refs))]) if refs else _EMPTY
    owner = np.searchsorted(begin, at, "right") - 1
    doc = np.array([d for d, _ in refs], np.int64)[owner] if len(at) else _EMPTY
    order = np.lexsort((doc, ids[at]))
    at, doc, owner = at[order], doc[order], owner[order]
    known = ids[at]
    out = []
    for n, (d, _) in enumerate(stretches, len(refs)):
        base, count = int(begin[n]), int(size[n]) - window + 1
        mine = ids[base : base + max(count, 0)]
        low, high = np.searchsorted(known, mine), np.searchsorted(known, mine, "right")
        # references of one window are in order of doc_id, so the first tells whether a smaller one holds it
        found = (low < high) & (doc[np.minimum(low, max(len(doc) - 1, 0))] < d) if len(doc) else np.zeros(len(mine), bool)
        starts = np.flatnonzero(found)
        factors: list[tuple[int, int, int, int]] = []
        held = np.zeros(len(mine), bool)
        i = int(starts[0]) if len(starts) else -1
        while i >= 0:
            best, source = 0, 0
            for c in range(int(low[i]), min(int(high[i]), int(low[i]) + CHOICES)):
                if doc[c] >= d:
                    break
                q = int(at[c])
                run = min(len(mine) - i, int(begin[owner[c] + 1]) - window - q)
                differ = np.flatnonzero(mine[i : i + run] != ids[q : q + run])
                if (same := int(differ[0]) if len(differ) else run) > best:
                    best, source = same, c
                if best == len(mine) - i:
                    break
            factors.append((i, best + window - 1, int(owner[source]), int(at[source] - begin[owner[source]])))
            held[i : i + best] = True
            # the windows across the factor's border, and those behind it
            following = np.searchsorted(starts, i + best)
            i = int(starts[following]) if following < len(starts) else -1
        out.append((factors, np.flatnonzero(~held).tolist()))
    return out


def _parse_rows(window: int):
    def f(table: pa.Table) -> pa.Table:
        kind, doc, row, first, text = (table[n].to_pylist() for n in ("kind", "doc_id", "row", "first", "words"))
        refs = [(doc[i], text[i]) for i in range(len(kind)) if kind[i] == 1]
        mine = [i for i in range(len(kind)) if kind[i] == 2]
        bad = [(doc[i], row[i], first[i] + p) for i, (_, left) in zip(mine, parse_block(refs, [(doc[i], text[i]) for i in mine], window), strict=True) for p in left]
        return pa.table({"doc_id": pa.array([x[0] for x in bad], pa.int64()), "row": pa.array([x[1] for x in bad], pa.int32()), "place": pa.array([x[2] for x in bad], pa.int64())})

    return f


def route(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """(doc_id, row, places, blocks, refs) of each document row with windows to be parsed or referred to, and the
    number of reference blocks.

    ``row`` is a hash that tells rows of one doc_id with different texts apart; places are uint32, blocks int32. Words
    are runs of bytes but ASCII white space, unchanged. A null doc_id is not compared, neither as holder nor as
    duplicate; equal ids aren't smaller than each other.
    """
    ensure_importable(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(docs)
    phrases = total // 6 + 1
    groups = max(1, min(width, phrases // 100_000), -(-phrases // PHRASES_PER_GROUP))
    blocks = max(1, min(4 * width, total // (1 << 18)), -(-total // BLOCK_BYTES))
    rows = docs.where("doc_id is not null").select("doc_id", F.hash("text").alias("row"), "text")
    sent = rows.mapInArrow(_phrase_rows(window, groups, blocks), _SENT)
    found = sent.groupBy("r").applyInArrow(_match_group(groups, blocks), _FOUND)
    return found.groupBy("bucket").applyInArrow(_merge_bucket, "doc_id long, row int, places binary, blocks binary, refs binary"), blocks


_ROWS = "kind int, block int, doc_id long, row int, first long, words binary, n_words long, n_removed long, kept_sha256 string"


def _cut_rows(window: int, blocks: int, with_text: bool):
    """For (doc_id, row, text, places, blocks, refs): a row with the result if all windows are duplicates (kind 0), and
    the stretches to be referred to (1) and to be parsed (2)."""
    names = [x.split()[0] for x in _ROWS.split(", ")] + ["kept"] * with_text

    def run(batches):
        for batch in batches:
            for b in W.slices(batch, 2):
                out: list[tuple] = []
                for doc, row, text, places, to, refs in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    words = (text or "").encode().split()
                    at = np.frombuffer(places or b"", np.uint32).astype(np.int64)
                    gone, kept = _digest(words, at, window)
                    out.append((0, 0, doc, row, 0, None, len(words), gone, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
                    parts = [(2, *x) for x in _stretches(at, np.frombuffer(to or b"", np.int32), window)]
                    if refs:
                        held = np.frombuffer(refs, np.uint32).astype(np.int64)
                        own = int(_block_of(np.array([doc]), blocks)[0])
                        parts += [(1, s, e, own) for s, e, _ in _stretches(held, np.zeros(len(held), np.int64), window)]
                    out += [(kind, block, doc, row, s, b" ".join(words[s:e]), None, None, None, *([None] if with_text else [])) for kind, s, e, block in parts]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in zip(range(len(names)), types, strict=False)], names)

    return run


def remove_duplicates(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; ``with_text`` adds the kept words joined by one space.

    A null or empty text has no words, an empty table gives no rows. Repeated rows with one doc_id each give a row and
    are not duplicates of each other. Of documents with equal windows the smallest doc_id keeps them. Other columns of
    ``docs`` are not read. A document's length is bounded by the memory for its words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    routed, blocks = route(docs, window)
    keyed = docs.withColumn("_row", F.hash("text"))
    found = routed.withColumnRenamed("doc_id", "_doc")
    joined = keyed.join(found.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("_row") == F.col("row")), "left").select("doc_id", F.col("_row").alias("row"), "text", "places", "blocks", "refs")
    rows = stored(joined.mapInArrow(_cut_rows(window, blocks, with_text), _ROWS + ", kept string" * with_text), "stretches")
    pieces = rows.where("kind > 0").select("kind", "block", "doc_id", "row", "first", "words")
    heavy = pieces.where("kind = 2").groupBy("block").agg(F.ceil(F.sum(F.length("words")) / BLOCK_STRETCHES).cast("int").alias("copies"))
    dealt = pieces.join(heavy, "block")  # a block without stretches to parse has nothing to do
    copy = F.when(F.col("kind") == 1, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "row", "first"), F.col("copies")).cast("int")))
    left = dealt.withColumn("copy", F.explode(copy)).groupBy("block", "copy").applyInArrow(_parse_rows(window), "doc_id long, row int, place long")
    left = stored(left, "unparsed")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    results = rows.where("kind = 0")
    if left.isEmpty():
        return results.select(*columns)
    # windows whose hashes were equal but not their words are no duplicates
    bad = left.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_bad")).agg(F.collect_set("place").alias("out"))
    sure = results.join(bad.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_bad")), "left_anti").select(*columns)
    again = joined.join(bad.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_bad"))).select("doc_id", "row", "text", "places", "out")

    def run(batches):
        for batch in batches:
            for b in W.slices(batch, 2):
                out = []
                for doc, _, text, places, wrong in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    words = (text or "").encode().split()
                    at = np.frombuffer(places or b"", np.uint32).astype(np.int64)
                    gone, kept = _digest(words, at[~np.isin(at, wrong)], window)
                    out.append((doc, len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in zip(range(len(columns)), types, strict=False)], columns)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return sure.unionByName(again.mapInArrow(run, schema))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict:
    """What :func:`remove_duplicates` gives for distinct ids, by plain Python, for tests."""
    import re

    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    least: dict[tuple, int] = {}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            least.setdefault(tuple(split[d][i : i + window]), d)
    out = {}
    for d, w in split.items():
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out
