"""Nearest neighbours by collision counting (query-aware hashing).

Vectors are dealt into shards of bounded size by the hash of their ids. A shard keeps, for each of ``m`` Gaussian
projections, its vectors sorted by the projected value. A query opens a window around its own value in every sorted
array and widens all windows together (virtual rehashing: the same arrays serve every radius); a vector that falls
into at least ``threshold`` of the windows is verified with its exact distance. The search of a shard ends when
enough different vectors are verified (equal ones are indexed and counted once), or when the k-th distance found is
below what wider windows could improve. The k best of each shard are merged per query.

Every query visits every shard: a query's copies stream past the shard's index in blocks after the shard's vectors,
so a task holds one shard and one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm.shared import ensure_importable

SHARD_VECTORS = 8192
QUERY_BLOCK = 256
#: Blocks of each sorted array; a window takes whole blocks, so it is wider by at most one of them at each end.
BLOCKS = 64
#: Windows are widened this often; a query that is still not done (one far from all vectors) is compared with all.
WIDENINGS = 60


@dataclass(frozen=True)
class Settings:
    """``projections`` arrays; a vector needs ``threshold`` of them; windows grow by ``growth`` from ``first`` of the
    spread of a projection; a shard's search verifies different vectors, at least ``verify`` times the number of its
    rows and ``verify_least``. With ``verify`` of 1 or more a search goes on until the windows hold the whole shard:
    that is the exact way, for callers who need each true neighbour."""

    projections: int = 128
    threshold: float = 0.66
    first: float = 0.25
    growth: float = 1.22
    verify: float = 0.08
    verify_least: int = 600
    seed: int = 20_240_601


class CollisionIndex:
    """Sorted arrays of one shard, cut into ``BLOCKS`` blocks of equal rank. A window is a run of blocks, held as the
    difference of two nested bit sets, so the collisions of 64 vectors with one window are counted by one word."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, s: Settings):
        # the rows of each different vector lie side by side in ``ids``, smallest id first; 0.0 and -0.0 are equal
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).reshape(-1)
        _, first, group, self.copies = np.unique(raw, return_index=True, return_inverse=True, return_counts=True)
        self.ids, self.at = ids[np.lexsort((ids, group))], np.cumsum(self.copies) - self.copies
        self.vectors, self.s = vectors[first], s
        n, m = len(self.vectors), s.projections
        rng = np.random.default_rng([s.seed, vectors.shape[1]])
        self.directions = rng.standard_normal((vectors.shape[1], m))
        h = self.vectors @ self.directions
        self.sorted = np.ascontiguousarray(np.sort(h, axis=0).T)
        self.scale = float(np.median(h.std(axis=0))) or 1.0
        self.need = max(1, math.ceil(s.threshold * m))
        self.blocks = min(BLOCKS, n)
        words = -(-n // 64)
        # below[j, b]: the vectors in the first b blocks of array j, a bit each
        self.below = np.zeros((m, self.blocks + 1, words), np.uint64)
        block = np.empty(n, np.int64)
        for j in range(m):
            block[np.argsort(h[:, j], kind="stable")] = np.arange(n) * self.blocks // n
            bits = np.zeros((self.blocks, words * 64), np.uint8)
            bits[:, :n] = block < np.arange(1, self.blocks + 1)[:, None]
            self.below[j, 1:] = np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def collided(self, h: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(queries x vectors: in at least ``need`` windows; queries: whether their windows hold the whole shard)."""
        n, m = len(self.vectors), self.s.projections
        waiting: list[list[np.ndarray]] = [[] for _ in range(m.bit_length() + 1)]

        def add(plane: np.ndarray, weight: int) -> None:
            # three planes of one weight become a plane of that weight and one of twice that weight
            waiting[weight].append(plane)
            if len(waiting[weight]) == 3:
                a, b, c = waiting[weight]
                either = a ^ b
                waiting[weight] = [either ^ c]
                add((a & b) | (either & c), weight + 1)

        whole = np.ones(len(h), bool)
        for j in range(m):
            left = np.searchsorted(self.sorted[j], h[:, j] - half)
            right = np.searchsorted(self.sorted[j], h[:, j] + half, "right")
            low = left * self.blocks // n
            high = np.where(right > left, (right - 1) * self.blocks // n + 1, low)
            whole &= high - low == self.blocks
            add(self.below[j, high] ^ self.below[j, low], 0)
        # the counts plus 2^bits - need carry into the next bit where a count reaches need
        bits = m.bit_length()
        start = (1 << bits) - self.need
        carry = None
        for weight in range(bits):
            terms = waiting[weight] + ([carry] if carry is not None else []) + ([np.uint64(0xFFFFFFFFFFFFFFFF)] if start >> weight & 1 else [])
            carry = None
            while len(terms) > 1:
                a, b = terms.pop(), terms.pop()
                c = terms.pop() if terms else np.uint64(0)
                either = a ^ b
                up = (a & b) | (either & c)
                terms.append(either ^ c)
                if carry is None:
                    carry = up
                else:
                    waiting[weight + 1].append(up)
        flags = np.zeros((len(h), self.below.shape[2]), np.uint64)
        for x in waiting[bits] + ([carry] if carry is not None else []):
            flags |= x
        return np.unpackbits(flags.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=n).view(bool), whole

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, distances) of the k nearest found of each query, itself left out; ties to smaller ids."""
        n, nq = len(self.vectors), len(queries)
        h = queries @ self.directions
        tried = np.zeros((nq, n), bool)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * nq
        exact = self.s.verify >= 1
        enough = n + 1 if exact else min(n, max(self.s.verify_least, int(self.s.verify * len(self.ids))) + k)
        seen, rows = np.zeros(nq, np.int64), np.zeros(nq, np.int64)
        live = np.arange(nq)
        half = self.scale * self.s.first
        for widening in range(WIDENINGS + 1):
            if widening < WIDENINGS:
                hit, whole = self.collided(h[live], half)
            else:
                hit, whole = np.ones((len(live), n), bool), np.ones(len(live), bool)
            hit &= ~tried[live]
            tried[live] |= hit
            done = whole
            for x in np.flatnonzero(hit.any(axis=1)).tolist():
                q, new = live[x], np.flatnonzero(hit[x])
                seen[q] += len(new)
                rows[q] += self.copies[new].sum()
                # of equal vectors the k smallest ids but the query's own can be among the best
                size = np.minimum(self.copies[new], k + 1)
                ids = self.ids[np.repeat(self.at[new] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                d = np.repeat(np.sqrt(((self.vectors[new] - queries[q]) ** 2).sum(1)), size)
                other = ids != own[q]
                ids, d = np.concatenate([best[q][0], ids[other]]), np.concatenate([best[q][1], d[other]])
                keep = np.lexsort((ids, d))[:k]
                best[q] = (ids[keep], d[keep])
            for x in np.flatnonzero(seen[live] > 0).tolist():
                q = live[x]
                # windows of this half-width hold most vectors within half / 1.2 of the query
                certain = not exact and len(best[q][0]) == k and best[q][1][-1] * 1.2 <= half and rows[q] >= k + 1
                done[x] |= certain or seen[q] >= enough
            live = live[~done]
            if not len(live):
                break
            half *= self.s.growth
        return best


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: Settings = Settings(), shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance in double precision.

    ``vectors`` and ``queries`` have vec_id and embedding. Vectors that are null, all zero, or hold a null, NaN or
    infinite component take no part, nor do null ids; only vectors of a query's length are its candidates; one with
    the query's own id is not. Of rows that repeat an id, one stays: the smallest in the order of arrays.
    """
    ensure_importable(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))

    data, asked = usable(vectors), usable(queries)
    n = data.count()
    # by the number of vectors alone: neighbours don't depend on a cluster's settings
    shards = max(1, -(-n // shard_vectors))
    keyed = data.withColumn("role", F.lit(0)).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    copies = asked.withColumn("role", F.lit(1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    mixed = keyed.unionByName(copies).withColumn("dim", F.size("embedding"))
    mixed = mixed.repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "role", "vec_id", "embedding")

    def run(batches) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "index": None, "ids": [], "vectors": [], "ask": [], "asked": []}

        def flush() -> Iterator[pa.RecordBatch]:
            if state["ask"] and state["index"] is None and state["ids"]:
                ids, v = np.concatenate(state["ids"]), np.concatenate(state["vectors"])
                first = np.append(True, ids[1:] != ids[:-1])
                state["index"] = CollisionIndex(ids[first], v[first], settings)
                state["ids"], state["vectors"] = [], []
            if state["ask"]:
                own, q = np.concatenate(state["asked"]), np.concatenate(state["ask"])
                state["ask"], state["asked"] = [], []
                first = np.append(True, own[1:] != own[:-1]) & ~np.isin(own, [state.get("last")])
                state["last"] = own[-1]
                own, q = own[first], q[first]
                for at in range(0, len(own) if state["index"] else 0, QUERY_BLOCK):
                    found = state["index"].search(q[at : at + QUERY_BLOCK], own[at : at + QUERY_BLOCK], k)
                    size = [len(i) for i, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[at : at + QUERY_BLOCK], size)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([d for _, d in found]))], ["query_id", "vec_id", "score"])

        for b in batches:
            shard, dim, role = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("shard", "dim", "role"))
            ids, emb = b.column(b.schema.get_field_index("vec_id")).to_numpy(), b.column(b.schema.get_field_index("embedding"))
            change = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (role[1:] != role[:-1]))).tolist() + [len(ids)]
            for s, e in zip(change[:-1], change[1:], strict=True):
                key = (shard[s], dim[s])
                if key != state["key"]:
                    yield from flush()
                    state.update(key=key, index=None, ids=[], vectors=[], last=None)
                part = emb.slice(s, e - s).flatten().to_numpy().reshape(-1, int(dim[s]))
                if role[s] == 0:
                    state["ids"].append(ids[s:e])
                    state["vectors"].append(part)
                else:
                    state["asked"].append(ids[s:e])
                    state["ask"].append(part)
                    if sum(map(len, state["asked"])) >= QUERY_BLOCK:
                        yield from flush()
        yield from flush()

    found = mixed.select("vec_id", "embedding", "role", "shard", "dim").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def hundredth_queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 100 == 0)
