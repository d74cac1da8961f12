"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group and go to one shard; a group that is heavier than a whole shard in any of the
three dimensions is cut into pieces by its rows' ids. Groups are placed heaviest first, each in the shard whose
residual capacity has the largest dot product with the group's size, both as shares of a shard's capacity. As the law
asks for near equal bytes and the product weighs three measures, a closing pass of the driver moves single items
between the fullest and the emptiest shard.

At most ``LARGE`` groups a shard are placed by the driver one by one: those with at least 1 / LARGE of a shard in some
dimension, of which there can't be more than 3 * LARGE a shard. The others are placed by the same rule in rounds: they
are dealt into districts of about ``DISTRICT`` groups of like bytes beside rows, and each district packs its own, one by one, into bins. A bin is
an item of the next round, until at most ``DRIVER_ITEMS`` are left, which the driver places among the large groups. So
each group is placed by its dot product, and what one task or the driver holds is bounded whatever the corpus holds.
Slots are running numbers inside a piece or bundle after those of its predecessors in the shard, so no shard is
ever sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm.shared import ensure_importable, stored

SHARDS = 8
LARGE = 200
DISTRICT = 16_384
DRIVER_ITEMS = 8192
#: Districts are apart by how many bytes their groups have beside rows, in so many classes.
CLASSES = 8
#: Bins of a district: so many that a round leaves about DRIVER_ITEMS, at most this and at least one a shard.
MOST_BINS = 1024
#: Rows of a piece that one task numbers.
PART_ROWS = 4096


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (a row of sizes by dimension), heaviest first by the greatest share of any dimension."""
    total = np.maximum(sizes.sum(0), 1)
    share = sizes * (shards / total)
    order = np.lexsort((np.arange(len(sizes)), -share.max(1, initial=0)))
    residual = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        s = share[i]
        # a shard that the item would overfill most is left for last
        over = np.maximum(s - residual, 0).max(1)
        fits = over <= max(over.min(), 0) + 1e-12
        score = np.where(fits, residual @ s, -np.inf)
        best = int(np.argmax(score))
        out[i] = best
        residual[best] -= s
    return out


def even_bytes(size: np.ndarray, shard: np.ndarray, shards: int, moves: int = 1000) -> np.ndarray:
    """Moves single items from the fullest shard to the emptiest while that brings their bytes nearer."""
    load = np.bincount(shard, size, minlength=shards)
    for _ in range(moves):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        mine = np.flatnonzero((shard == full) & (size > 0) & (size < gap))
        if gap <= 1e-4 * max(load.mean(), 1) or not len(mine):
            break
        i = mine[np.abs(size[mine] - gap / 2).argmin()]
        shard[i] = empty
        load[full] -= size[i]
        load[empty] += size[i]
    return shard


def packer(bins: int) -> Callable[[pa.Table], pa.Table]:
    """(name, bin) of a district's items; bins are numbered over all districts."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("name")
        sizes = np.stack([t[c].to_numpy() for c in "btn"], 1).astype(float)
        return pa.table({"name": t["name"], "bin": pa.array(t["home"][0].as_py() * bins + place(sizes, bins))})

    return pack


def in_rounds(items: DataFrame, shards: int, district: int, driver_items: int) -> tuple[DataFrame, DataFrame]:
    """Packs items (grp, b, t, n) into at most ``driver_items`` bins, or leaves them as they are if there aren't more;
    that must be at least ``CLASSES`` times the shards.

    Gives (grp, name), the bin of each item, and (name, b, t, n), the bins.
    """
    ensure_importable(items.sparkSession)
    names = items.select("grp", F.col("grp").alias("name"))
    bins = items.select(F.col("grp").alias("name"), "b", "t", "n")
    while True:
        count, b, n = bins.agg(F.count("*"), F.sum("b"), F.sum("n")).first()
        if count <= driver_items:
            return names, bins
        per_class = -(-count // district)
        width = int(min(max(driver_items // (CLASSES * per_class), shards), MOST_BINS))
        # bytes beside rows: bins of one class are heavy in one of them, so that later items can still balance both
        weight = F.col("b") / F.lit(float(b))
        of_class = F.least(F.floor(weight / (weight + F.col("n") / F.lit(float(n))) * CLASSES), F.lit(CLASSES - 1))
        dealt = bins.withColumn("home", of_class * per_class + F.pmod(F.xxhash64("name", F.lit(29)), F.lit(per_class)))
        packed = stored(dealt.groupBy("home").applyInArrow(packer(width), "name long, bin long"), "packed")
        bins = stored(bins.join(packed, "name").groupBy("bin").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).withColumnRenamed("bin", "name"), "bins")
        names = names.join(packed, "name").select("grp", F.col("bin").alias("name"))


def pack_shards(docs: DataFrame, shards: int = SHARDS, district: int = DISTRICT, driver_items: int = DRIVER_ITEMS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row under the law ``bytes``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has no bytes, no tokens and the checksum 0 of no bytes, and
    null texts are one group. Tokens are runs of characters but white space. ``grown_shard`` is null under this law.
    Slots follow the texts' hashes and doc_ids; rows that repeat both take the next slots in any order.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64("text").alias("grp"),
    )
    rows = stored(rows, "rows")  # five numbers a row; texts are read once
    groups = rows.groupBy("grp").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    full = [max((x or 0) / shards, 1.0) for x in total]
    share = F.greatest(*(F.col(c) / F.lit(f) for c, f in zip("btn", full, strict=True)))
    groups = stored(groups.withColumn("share", share), "groups")
    # bounded: a group here has 1 / LARGE of a shard in one of three dimensions
    pieces = {r.grp: int(np.ceil(r.share * 4)) if r.share > 1 else 1 for r in groups.where(F.col("share") >= 1.0 / LARGE).select("grp", "share").collect()}
    spark = docs.sparkSession
    known = spark.createDataFrame(list(pieces.items()), "_g long, pieces int")
    # at most 3 * LARGE * shards rows of two numbers
    known = F.broadcast(known)
    large = rows.join(known, F.col("grp") == F.col("_g"))
    of_piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", F.lit(17)), F.col("pieces"))).otherwise(F.lit(0)).cast("long")
    columns = ("doc_id", "size", "text_crc32", "tokens", "grp")
    large = large.select(*columns, F.lit(True).alias("own"), F.col("grp").alias("name"), of_piece.alias("piece"))
    names, bins = in_rounds(groups.where(F.col("share") < 1.0 / LARGE).select("grp", "b", "t", "n"), shards, district, driver_items)
    # no row of a large group takes part in this join, so none of its keys holds much
    small = rows.join(known, F.col("grp") == F.col("_g"), "left_anti").join(names, "grp")
    named = large.unionByName(small.select(*columns, F.lit(False).alias("own"), "name", F.lit(0).cast("long").alias("piece")))
    weights = large.groupBy("own", "name", "piece").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("name", "piece").collect()
    weights += bins.select(F.lit(False).alias("own"), "name", F.lit(0).cast("long").alias("piece"), "b", "t", "n").orderBy("name").collect()
    sizes = np.array([[w.b, w.t, w.n] for w in weights], float).reshape(-1, 3)
    shard = even_bytes(sizes[:, 0], place(sizes, shards), shards)
    start, after = [], [0] * shards
    for w, s in zip(weights, shard.tolist(), strict=True):
        start.append(after[s])
        after[s] += w.n
    fields = [("own", T.BooleanType()), ("name", T.LongType()), ("piece", T.LongType()), ("shard", T.IntegerType()), ("start", T.LongType()), ("parts", T.IntegerType())]
    rows_of_plan = [(w.own, w.name, w.piece, int(s), int(a), int(w.n) // PART_ROWS + 1) for w, s, a in zip(weights, shard, start, strict=True)]
    plan = spark.createDataFrame(rows_of_plan, T.StructType([T.StructField(n, t) for n, t in fields]))
    keys = ["own", "name", "piece"]
    # a piece in numbered parts by its rows, so that one that holds very many is not sorted by one task
    part = F.pmod(F.xxhash64("grp", "doc_id", F.lit(5)), F.col("parts")).cast("long").alias("part")
    parted = named.join(F.broadcast(plan), keys).select("doc_id", "size", "text_crc32", "grp", *keys, "shard", "start", part)
    parts = parted.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("grp", "doc_id", "text_crc32", "size"))
    ranked = parted.withColumn("rank", rank).join(parts, [*keys, "part"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
