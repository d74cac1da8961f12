"""Toxicity: a logistic classifier of words and word beginnings, kept from reacting to who is mentioned.

Features are hashed words, their beginnings of 3 to 8 bytes, and nothing else; a document has each at most once. Only
features whose split between the classes is unlikely by chance, given how many are tried, and that are mostly in
toxic documents take part, and their weights can't fall below zero: toxicity is the presence of something, so length
and neutral words can't make up for it. Each labelled document with identity terms is also taken with those terms swapped
for others of the same language in the sentences that hold them: beside the log loss, training penalises the squared
difference of the two logits, documents of either label weighted as in the loss, so that who is mentioned doesn't move
the score. Weights are shrunk towards zero.

Training uses at most ``SAMPLE`` labelled documents, those with the smallest hashes of their ids; the bound is a
parameter. Scoring is one map over all whole texts with the weights as a table of fixed size.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm import words as W
from maskframe.llm.shared import ensure_importable, release

U64 = np.uint64
SAMPLE = 10_000
BITS = 20
PREFIXES = (3, 4, 5, 6, 8)
THRESHOLD = 0.7
#: Added to the logarithm of the number of features tried: what a feature's evidence must exceed. Chosen on a split of
#: the labels that training may see (crc32 mod 3 of 0 to learn from, 2 to compare).
MARGIN = -3.0

# Words for groups of people, English, French, German and Spanish.
IDENTITY_TERMS = {
    "en": """women men woman man girls boys muslims muslim christians christian jews jewish hindus hindu buddhists
atheists catholics catholic protestants immigrants immigrant refugees refugee foreigners migrants gay lesbian bisexual
transgender queer straight black white asian african latino hispanic arab indian chinese mexican european american
disabled deaf blind autistic elderly young old poor rich""",
    "fr": """femmes hommes femme homme musulmans musulman chrétiens chrétien juifs juif immigrés réfugiés étrangers noirs blancs
arabes asiatiques handicapés""",
    "de": """frauen männer frau mann muslime christen juden einwanderer flüchtlinge ausländer schwarze weiße araber behinderte""",
    "es": """mujeres hombres mujer hombre musulmanes musulmán cristianos cristiano judíos judío inmigrantes refugiados extranjeros
negros blancos árabes asiáticos discapacitados""",
}


_PARTNERS = {t: [o for o in terms.split() if o != t] for terms in IDENTITY_TERMS.values() for t in terms.split()}
_MENTION = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(_PARTNERS, key=len, reverse=True)) + r")(?![^\W\d_])", re.I)


def _letters_table() -> np.ndarray:
    t = W.alnum_table()
    t[48:58] = 0
    return t


_LETTERS = _letters_table()


def features_of_words(w: W.Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of each distinct feature of each document; with a mask, of the wanted ones only."""
    parts, docs = [], []

    def put(h: np.ndarray, doc: np.ndarray) -> None:
        f = (h >> U64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            at = np.flatnonzero(wanted[f])
            f, doc = f[at], doc[at]
        parts.append(f)
        docs.append(doc)

    doc = np.repeat(np.arange(w.docs), w.counts)
    put(w.hash, doc)
    if len(w.hash):
        length = w.end - w.start
        power, inverse = W._powers(len(w.data))
        run = np.concatenate([[U64(0)], np.cumsum(W._VALUES[_LETTERS[w.data]] * power[: len(w.data)])])
        for k in PREFIXES:
            # bytes, not characters: a beginning is a stretch of the UTF-8 form
            long = np.flatnonzero(length > k)
            s = w.start[long]
            put(W.mix((run[s + k] - run[s]) * inverse[s] + U64(k)), doc[long])
    key = np.unique(np.concatenate(docs) << BITS | np.concatenate(parts))
    return key & (1 << BITS) - 1, key >> BITS


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by another of its language, one that the text decides; None without
    any. Repeated mentions of a term get the same one."""
    turn = crc32(text.encode())
    out, n = _MENTION.subn(lambda m: (others := _PARTNERS.get(m[0].lower(), [m[0]]))[(turn + crc32(m[0].lower().encode())) % len(others)], text)
    return out if n else None


def _features(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, w in W.batches(column, _LETTERS):
        f, d = features_of_words(w)
        out += np.split(f.astype(np.int32), np.searchsorted(d, np.arange(1, w.docs))) if w.docs else []
    return out


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Features and labels of at most ``sample`` labelled documents that aren't held out, and the features of each with
    its identity terms swapped (none where it has no such terms)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(sample).select("doc_id", "toxic")
    # at most ``sample`` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def featurize(batches):
        for batch in batches:
            for b in W.slices(batch, 2):
                other = [swapped(t or "") for t in b.column(2).to_pylist()]
                f, g = _features(b.column(2)), _features(pa.array([t or "" for t in other], pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array([x.tobytes() for x in f], pa.binary()), pa.array([None if t is None else x.tobytes() for t, x in zip(other, g, strict=True)], pa.binary())], ["doc_id", "toxic", "f", "g"])

    found = sorted(rows.mapInArrow(featurize, "doc_id long, toxic int, f binary, g binary").collect(), key=lambda r: (r.doc_id, bytes(r.f)))
    return [np.frombuffer(r.f, np.int32) for r in found], np.array([r.toxic for r in found], float), [np.frombuffer(r.f if r.g is None else r.g, np.int32) for r in found]


def fit(rows: list[np.ndarray], y: np.ndarray, other: list[np.ndarray], swap_weight: float = 2.0, decay: float = 1e-3, rounds: int = 300, margin: float = MARGIN) -> tuple[np.ndarray, float]:
    """Weights of all 2**BITS features and the bias, by projected descent with a scale for each weight. ``other`` has the
    features of each row with its identity terms swapped, ``swap_weight`` the weight of the squared change of its logit."""
    weights = np.zeros(1 << BITS)
    if not len(rows) or y.min(initial=1) == y.max(initial=0):
        p = float(y.mean()) if len(y) else 0.0
        return weights, float(np.log((p + 1e-3) / (1 - p + 1e-3)))
    size = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    feature = np.concatenate(rows)
    n, ones = len(rows), y > 0
    with_one = np.bincount(feature[ones[doc]], minlength=1 << BITS)
    with_zero = np.bincount(feature[~ones[doc]], minlength=1 << BITS)
    seen_in = with_one + with_zero
    share_one = ones.sum() / n
    # how unlikely a feature's split between the classes is by chance, as a log likelihood ratio, against the number
    # of features that are tried
    part = np.maximum(with_one / np.maximum(seen_in, 1), 1e-9)
    rest = np.maximum(with_zero / np.maximum(seen_in, 1), 1e-9)
    odd = with_one * np.log(part / share_one) + with_zero * np.log(rest / (1 - share_one))
    tried = max(int((seen_in >= 3).sum()), 2)
    used = np.flatnonzero((with_one >= 3) & (part > 0.6 + 0.4 * share_one) & (odd > np.log(tried) + margin))
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    keep = place[feature] >= 0
    doc, feature = doc[keep].astype(np.int64), place[feature[keep]]
    # what a swap adds to a row and takes from it
    swaps = [(i, s, f) for i, (x, z) in enumerate(zip(rows, other, strict=True)) if x is not z for s, part in ((1.0, np.setdiff1d(z, x)), (-1.0, np.setdiff1d(x, z))) for f in place[part].tolist() if f >= 0]
    at, sign, moved = (np.array(c, t) for c, t in zip(zip(*swaps, strict=True) if swaps else ([], [], []), (np.int64, float, np.int64), strict=True))
    w, b = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
    seen_w, seen_b = np.full(len(used), 1e-8), 1e-8
    # both classes count the same in total
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(doc, w[feature], minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        gw = np.bincount(feature, g[doc], minlength=len(used)) + decay * w / len(used) ** 0.5
        change = np.bincount(at, sign * w[moved], minlength=n) * share
        gw += 2 * swap_weight * np.bincount(moved, sign * change[at], minlength=len(used))
        seen_w += gw * gw
        seen_b += g.sum() ** 2
        w = np.maximum(w - 0.3 * gw / np.sqrt(seen_w), 0)
        b -= 0.3 * g.sum() / np.sqrt(seen_b)
    weights[used] = w
    return weights, b


def score_column(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(column))
    wanted = weights != 0
    for at, w in W.batches(column, _LETTERS):
        f, d = features_of_words(w, wanted)
        out[at : at + w.docs] = np.bincount(d, weights[f], minlength=w.docs) if len(f) else 0
    return 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    ensure_importable(docs.sparkSession)
    return fit(*training_rows(docs, labels, sample))


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "_toxicity") -> DataFrame:
    """``docs`` with the score of each whole text; a null text is empty. Rows, also repeated ones, and all columns stay;
    a column of ``docs`` that is named like the score's must be renamed, else a ValueError says so."""
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col} already: give another score_col")
    ensure_importable(docs.sparkSession)
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    names = docs.columns
    at = names.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{score_col}` double"])

    def run(batches):
        release()
        w, b0 = sent.value
        for b in batches:
            for part in W.slices(b, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_column(part.column(at), w, b0))], [*names, score_col])

    return docs.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, repeated ones too; a null doc_id isn't held out. Without usable
    labels all score the same, as all empty and null texts do; an empty table gives no rows; texts are scored whole."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_scores(docs, train(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), F.col("_toxicity").alias("score"), F.when(F.col("_toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def reject_toxic(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without those that score ``THRESHOLD`` or more."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    scored = with_scores(docs, train(training_docs, labels), score_col=name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)
