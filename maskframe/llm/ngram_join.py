"""N-gram Jaccard join of documents by prefix trees.

Sets are distinct word shingles as 64-bit hashes; the global order is the hash order. Two steps find what to
join: sets that are equal collapse to one class, and classes that can reach the threshold are brought together
by runs. If J(A, B) >= t, then among the first ``floor(l * (1 - t) * n) + l`` values of either set in the global
order some ``l`` neighbours are neighbours in both sets: with a values missing from B and b added by B,
``a + t * b <= (1 - t) * n``, so for ``l <= 1 / (1 - t)`` the shared values outnumber l - 1 times the stretches
between differences. A hash of each such run is a signature; classes with a common signature are candidates, and
the connected candidates form a cluster. Long runs keep documents apart that only share a passage. No pair of a
group is written out: a signature links its classes as a star, first inside a batch, then across batches. Each
cluster's sets go to one task, are stored in a trie by the global order, and are joined by traversals that share
the overlaps of common beginnings, drop a subtree when its remaining length can't reach the threshold, and skip
leaves that are already connected. A cluster over ``MAX_CLUSTER_BYTES`` is cut into chunks that are joined by
pairs of chunks.

Hashes of 64 bits stand for shingles and sets; nothing else is approximate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from maskframe.llm import words as W
from maskframe.llm.shared import connected_components, ensure_importable, fresh, map_batches, shuffle_width, stored

U64 = np.uint64
#: Signatures of one reduce group, and bytes of sets of one joining task.
SIGNATURES_PER_GROUP = 2_000_000
BIN_BYTES = 16 << 20
#: Bytes of text whose signatures are settled among each other before they are sent.
SLICE_BYTES = 6 << 20
MAX_CLUSTER_BYTES = 48 << 20
#: The trie has nodes at these depths; an edge holds the values between two of them.
_DEPTHS = [0, 4, 12, 28, 60, 124, 252, 508]


def set_class(s: np.ndarray) -> int:
    """64-bit name of a set of hashes, whatever their order."""
    if len(s) == 0:
        return 0
    m = W.mix(s * U64(0xA24BAED4963EE407))
    return int(W.mix(np.array([(int(m.sum(dtype=U64)) ^ int(np.bitwise_xor.reduce(W.mix(m))) * 3) + len(s) & 0xFFFFFFFFFFFFFFFF], U64)).view(np.int64)[0])


def runs(num: int, den: int) -> list[tuple[int, int, int]]:
    """(length of runs, least and greatest set size that emit them); two similar sets have one kind in common.

    A run length l serves sizes whose prefix fits in the set. The long kind serves sizes from ``least`` on; sets
    that can be similar to a smaller one emit the short kind too. Below 4 values only equal sets reach 0.8.
    """
    gap = den - num
    long = max(1, min(4, 8 * den // (10 * gap)) if gap else 4)
    least = -(-long * den // (den - long * gap))
    short = 2 if 2 * den <= 4 * (den - 2 * gap) and num * 5 >= den * 4 else 1
    if long <= short:
        return [(short, 1, 1 << 60)]
    return [(long, least, 1 << 60), (short, 1, least * den // num)]


def run_signatures(s: np.ndarray, kinds: list[tuple[int, int, int]], num: int, den: int) -> list[np.ndarray]:
    out = []
    for size, least, most in kinds:
        if not least <= len(s) <= most:
            continue
        p = s[: size * (den - num) * len(s) // den + size]
        n = len(p) - size + 1
        if n > 0:
            h = p[:n] + U64(size)
            for j in range(1, size):
                h = W.mix(h) * U64(0xD6E8FEB86659FD93) + p[j : n + j]
            out.append(W.mix(h))
    return out


def _class_rows(k: int):
    table = W.space_table(lower=True)

    def f(batch: pa.RecordBatch):
        n, cls = [], []
        for _, w in W.batches(batch.column(1), table):
            for s in W.shingle_sets(w, k):
                n.append(len(s))
                cls.append(set_class(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], ["doc_id", "n", "cls"])

    return f


def _star(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys' first rows, and links from each other row of a key to the key's first class."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], cls[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.repeat(c[new], np.diff(np.append(np.flatnonzero(new), len(k))))
    other = ~new & (c != head)
    links = np.unique(np.stack([head[other], c[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return order[new], links[:, 0], links[:, 1]


_SIGNATURE_SCHEMA = "r int, sig binary, cls binary, count binary, a binary, b binary"
_LOW = U64((1 << 40) - 1)


def _signature_rows(k: int, num: int, den: int, groups: int):
    """One row per batch and reduce group: 40 bits of each signature by class, the classes and their counts."""
    table = W.space_table(lower=True)
    kinds = runs(num, den)
    seen: set[int] = set()

    def f(batch: pa.RecordBatch):
        for part in W.slices(batch, 0, SLICE_BYTES):
            yield from rows_of(part)

    def rows_of(batch: pa.RecordBatch):
        sigs, owners, classes = [], [], []
        for _, w in W.batches(batch.column(0), table):
            for s in W.shingle_sets(w, k):
                if len(s) < 2 or (c := set_class(s)) in seen:
                    continue
                seen.add(c)
                got = run_signatures(s, kinds, num, den)
                sigs.extend(got)
                owners.append(sum(map(len, got)))
                classes.append(c)
        if not sigs:
            return
        sig = np.concatenate(sigs)
        cls = np.array(classes, np.int64)
        owner = np.repeat(np.arange(len(cls)), owners)
        first, a, b = _star(sig, cls[owner])
        first.sort()
        sig, owner = sig[first], owner[first]
        r = ((sig >> U64(40)) % U64(groups)).astype(np.int32)
        order = np.argsort(r, kind="stable")
        cuts = np.searchsorted(r[order], np.arange(groups + 1))
        out: dict[str, list] = {x: [] for x in ("r", "sig", "cls", "count", "a", "b")}
        for g in range(groups):
            rows = order[cuts[g] : cuts[g + 1]]
            extra = g == int(r[0])
            if not len(rows) and not extra:
                continue
            local, counts = np.unique(owner[rows], return_counts=True)
            out["r"].append(g)
            out["sig"].append((sig[rows] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            out["cls"].append(cls[local].tobytes())
            out["count"].append(counts.astype(np.uint32).tobytes())
            out["a"].append(a.tobytes() if extra else b"")
            out["b"].append(b.tobytes() if extra else b"")
        yield pa.RecordBatch.from_arrays([pa.array(out["r"], pa.int32()), *(pa.array(out[x], pa.binary()) for x in ("sig", "cls", "count", "a", "b"))], list(out))

    return f


def _links_of_group(table: pa.Table) -> pa.Table:
    sig, cls, a, b = [], [], [], []
    for batch in table.to_batches():
        for s, c, n, x, y in zip(*(batch.column(batch.schema.get_field_index(i)) for i in ("sig", "cls", "count", "a", "b")), strict=True):
            raw = np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            sig.append(wide.reshape(-1).view(U64))
            cls.append(np.repeat(np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.uint32)))
            a.append(np.frombuffer(x.as_buffer(), np.int64))
            b.append(np.frombuffer(y.as_buffer(), np.int64))
    _, la, lb = _star(np.concatenate(sig), np.concatenate(cls))
    return pa.table({"a": np.concatenate([la, *a]), "b": np.concatenate([lb, *b])})


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift


class SetTrie:
    """Sorted sets in a trie whose nodes lie at the given depths."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        ordered = [sets[i] for i in self.order]
        flat = np.concatenate(ordered)
        values, dense = np.unique(flat, return_inverse=True)
        self.width = len(values)
        self.size = np.array([len(s) for s in ordered])
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = dense.reshape(-1)
        common = np.zeros(len(ordered), np.int64)
        for i in range(1, len(ordered)):
            x, y = ordered[i - 1], ordered[i]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common[i] = differ[0] if len(differ) else m
        depths = [d for d in _DEPTHS if d < int(self.size.max())]
        self.levels = []
        above = np.zeros(len(ordered), np.int64)
        for low, high in zip(depths, [*depths[1:], None], strict=True):
            new = np.ones(len(ordered), bool)
            if high is not None:
                new[1:] = common[1:] < high
            heads = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            first = self.begin[heads] + np.minimum(low, self.size[heads])
            last = self.begin[heads] + (self.size[heads] if high is None else np.minimum(high, self.size[heads]))
            self.levels.append((above[heads], first, last - first, np.minimum.reduceat(self.size, heads), np.maximum.reduceat(self.size, heads), high, heads, node))
            above = node
        self.mark = np.zeros(self.width, bool)

    def values(self, i: int) -> np.ndarray:
        return self.flat[self.begin[i] : self.begin[i] + self.size[i]]

    def matches(self, i: int, wanted: np.ndarray, num: int, den: int) -> np.ndarray:
        """Leaves among ``wanted`` (a mask) whose Jaccard similarity with leaf i reaches num / den."""
        x, nx = self.values(i), int(self.size[i])
        self.mark[x] = True
        shared = np.zeros(1, np.int64)
        alive = np.ones(1, bool)
        hit = np.zeros(0, np.int64)
        for parent, first, length, least, most, high, heads, node in self.levels:
            live = alive[parent] & (np.add.reduceat(wanted, heads, dtype=np.int64) > 0)
            live &= (np.minimum(nx, most) * den >= num * np.maximum(nx, least))
            ids = np.flatnonzero(live)
            if not len(ids):
                break
            at = _ragged(first[ids], length[ids])
            got = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
            ends = np.cumsum(length[ids])
            overlap = shared[parent[ids]] + got[ends] - got[ends - length[ids]]
            if high is None:
                leaf = ids
                ok = wanted[leaf] & (overlap * (num + den) >= num * (nx + self.size[leaf]))
                hit = leaf[ok]
                break
            # the values of x after the node's last one, and the longest rest below the node
            final = self.flat[np.maximum(first[ids] + length[ids] - 1, 0)]
            rest = np.where(length[ids] > 0, nx - np.searchsorted(x, final, "right"), nx)
            rest = np.minimum(rest, np.maximum(most[ids] - high, 0))
            keep = (overlap + rest) * (num + den) >= num * (nx + least[ids])
            shared = np.zeros(len(live), np.int64)
            shared[ids] = overlap
            alive = np.zeros(len(live), bool)
            alive[ids[keep]] = True
        self.mark[x] = False
        return hit


def trie_components(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set, an index that all sets connected with it by links have in common."""
    n = len(sets)
    if n == 1:
        return np.zeros(1, np.int64)
    trie = SetTrie(sets)
    comp = np.arange(n)
    hubs: list[int] = []
    before = np.zeros(n, bool)
    for i in range(n):
        if i:
            wanted = np.zeros(n, bool)
            for h in [*hubs[-3:], i - 1]:
                wanted[h] = comp[h] != comp[i]
            for rest in (False, True):
                if rest:
                    wanted = before & (comp != comp[i])
                if wanted.any():
                    for j in trie.matches(i, wanted, num, den).tolist():
                        if comp[j] != comp[i]:
                            comp[comp == comp[i]] = comp[j]
        if comp[i] == i:
            hubs.append(i)
        before[i] = True
    out = np.empty(n, np.int64)
    out[trie.order] = np.array(trie.order)[comp]
    return out


def _join_bin(num: int, den: int):
    def f(table: pa.Table) -> pa.Table:
        cluster = table["cluster"].to_numpy()
        cls = table["cls"].to_numpy()
        raw = table["values"].to_pylist()
        order = np.lexsort((cls, cluster))
        cuts = np.append(np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1])), len(order))
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = order[lo:hi]
            rows = rows[np.append(True, cls[rows][1:] != cls[rows][:-1])]
            root = trie_components([np.frombuffer(raw[i], U64) for i in rows.tolist()], num, den)
            a.append(cls[rows])
            b.append(cls[rows][root])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return f


def _member_sets(k: int):
    table = W.space_table(lower=True)

    def f(batch: pa.RecordBatch):
        for part in W.slices(batch, 0):
            wanted = part.column(1).to_pylist()
            keep, values = [], []
            for at, w in W.batches(part.column(0), table):
                for i, s in enumerate(W.shingle_sets(w, k)):
                    if set_class(s) == wanted[at + i]:
                        keep.append(at + i)
                        values.append(s.tobytes())
            rows = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), rows.column(3), rows.column(4), pa.array(values, pa.binary())], ["cls", "cluster", "bin", "chunks", "values"])

    return f


def similarity_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", with_class: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) and, if asked for, cls and root, the names of the row's set and of its component: documents linked by Jaccard similarity >= num / den of k-word shingles.

    Words are runs of bytes but ASCII white space, with A-Z in lower case; a document of fewer than k words is
    one shingle; without words or with a null text its set is empty and it is linked with nothing. component_id
    is the smallest doc_id that links reach. Rows that repeat a doc_id count as documents of their own with that
    id. A null doc_id gets its n_shingles, but no component, and links nothing. num / den must be over 1/2.
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must be over 1/2 and at most 1")
    spark = docs.sparkSession
    ensure_importable(spark)
    width = shuffle_width(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = stored(map_batches(docs, _class_rows(k), "doc_id long, n long, cls long"), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    classes = sets.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"))
    emitted = total * runs(num, den)[0][0] * (den - num) // den
    groups = max(1, min(width, emitted // 200_000), -(-emitted // SIGNATURES_PER_GROUP))
    signatures = map_batches(docs.where("doc_id is not null").select("text"), _signature_rows(k, num, den, groups), _SIGNATURE_SCHEMA)
    links = signatures.groupBy("r").applyInArrow(_links_of_group, "a long, b long")
    clusters = connected_components(links)
    members = clusters.withColumnRenamed("node", "cls").withColumnRenamed("component", "cluster").join(classes, "cls")
    sizes = members.groupBy("cluster").agg((F.sum("n") * 8).alias("bytes"))
    members = stored(members.join(sizes, "cluster"), "members")
    facts = members.agg(F.sum(F.col("n") * 8), F.max("bytes")).first()
    if facts[0] is None:
        joined = None
    else:
        bins = max(1, min(width, facts[0] // (1 << 18)), -(-facts[0] // BIN_BYTES))
        large = facts[1] > MAX_CLUSTER_BYTES
        chunks = F.when(F.col("bytes") > MAX_CLUSTER_BYTES, F.ceil(F.col("bytes") * 2 / MAX_CLUSTER_BYTES)).otherwise(F.lit(1)).cast("int")
        members = members.select(F.col("first_id").alias("doc_id"), "cls", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin"), chunks.alias("chunks"))
        held = map_batches(docs.join(members.hint("merge"), "doc_id").select("text", "cls", "cluster", "bin", "chunks"), _member_sets(k), "cls long, cluster long, bin long, chunks int, values binary")
        if large:
            # chunk i of a large cluster takes part in the pairs (0, i) .. (i, i) .. (i, last)
            mine = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
            held = held.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
            held = held.withColumn("pair", F.when(F.col("chunks") > 1, F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.lit(0).cast("long")))
            # a pair's cluster has a name of its own, so that two pairs in one task stay apart
            held = held.withColumn("bin", F.when(F.col("chunks") > 1, F.col("pair")).otherwise(F.col("bin"))).drop("mine", "other", "pair", "chunks")
        else:
            held = held.drop("chunks")
        joined = held.groupBy("bin").applyInArrow(_join_bin(num, den), "a long, b long")
        if large:
            joined = connected_components(joined).select(F.col("node").alias("a"), F.col("component").alias("b"))
    named = classes.select("cls", "first_id", F.col("cls").alias("root"))
    if joined is not None:
        rooted = named.join(joined.withColumnRenamed("a", "cls"), "cls", "left").select("cls", "first_id", F.coalesce("b", "cls").alias("root"))
        rooted = stored(rooted, "rooted")
        least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
        named = rooted.join(least, "root").select("cls", F.col("component").alias("first_id"), "root")
    out = sets.join(named, "cls", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"), *(["cls", "root"] if with_class else []))


def _class_of_rows(k: int, name: str):
    table = W.space_table(lower=True)

    def f(batch: pa.RecordBatch):
        at = batch.schema.get_field_index("text")
        for part in W.slices(batch, at):
            cls = [set_class(s) for _, w in W.batches(part.column(at), table) for s in W.shingle_sets(w, k)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cls, pa.int64())], [*part.schema.names, name])

    return f


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all columns, one of each component: a row with its smallest doc_id.

    Rows that repeat a doc_id are documents of their own: only those go whose own set is linked. Of several rows of a
    component with its smallest doc_id one stays, of the set with the smallest name; of those with that set the first
    in the order of text. Documents with no words and those without an id stay.
    """
    id_, cls_, kept_, repeated_, row_ = fresh(docs.columns, "id", "cls", "kept", "repeated", "row")
    found = similarity_components(docs, k, num, den, with_class=True).where("doc_id is not null")
    goes = (F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count(F.when(goes, 1)).alias("going")).where("going > 0 or rows > 1")
    ids = stored(ids.select(F.col("doc_id").alias(id_), (F.col("going") < F.col("rows")).alias(repeated_)), "ids")
    stay = docs.join(ids.select(id_).hint("merge"), docs["doc_id"] == F.col(id_), "left_anti")
    repeated = ids.where(repeated_)
    if repeated.isEmpty():
        return stay
    # ids whose rows don't all go: their rows are told apart by their sets
    mine = docs.join(repeated.select(id_).hint("merge"), docs["doc_id"] == F.col(id_), "left_semi")
    rows = stored(map_batches(mine, _class_of_rows(k, cls_), StructType([*docs.schema.fields, StructField(cls_, LongType())])), "repeated")
    kept = found.where("n_shingles > 0 and component_id = doc_id").groupBy("doc_id", "root").agg(F.min("cls").alias(cls_)).select(F.col("doc_id").alias(id_), F.col(cls_).alias(kept_))
    one = rows.where(F.col(cls_) != 0).groupBy("doc_id", cls_).agg(F.min_by(F.struct(*docs.columns), "text").alias(row_))
    one = one.join(kept.hint("merge"), (F.col("doc_id") == F.col(id_)) & (F.col(cls_) == F.col(kept_)), "left_semi").select(f"{row_}.*")
    return stay.unionByName(rows.where(F.col(cls_) == 0).drop(cls_)).unionByName(one)
