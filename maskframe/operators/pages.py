"""Positioned text: runs of a page and words of a character recogniser, their flat text, and boxes over spans.

Rasters are out of scope: these give the geometry that a renderer fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Gaps as shares of the em, box extents as shares of the em, density limits, warning limits.
SPACE_GAP, LINE_GAP, NUMERIC_GAP = 0.18, 0.5, 0.35
ASCENT, DESCENT, PAD = 0.88, 0.26, 0.12
LEAST_CHARS, LEAST_CHARS_PER_SQ_IN = 40, 8
MAX_AREA, MAX_SIDE = 4096 * 4096, 4096
LOW_CONFIDENCE, LOW_MEAN_CONFIDENCE = 60, 70
LARGE_FACTOR, LARGE_BYTES, PHOTO_COLOURS = 3, 5 * 1024 * 1024, 500
MAX_UPLOAD_BYTES = 25 * 1024 * 1024


def frame_from_matrix(matrix: Column, width: Column, scale: Column) -> Column:
    """struct(ox, oy, ax, ay, ux, uy, width, em) of an affine matrix [a, b, c, d, e, f] and an unscaled width."""
    a, b, c, d, e, f = (F.element_at(matrix, i) for i in range(1, 7))
    along, up = F.hypot(a, b), F.hypot(c, d)
    unit = lambda x, n, other: F.when(F.isnan(n) | n.isNull() | (n < 1e-9) | (n == float("inf")), F.lit(float(other))).otherwise(x / n)
    em = F.when(up != 0, up).when(along != 0, along).otherwise(F.lit(1.0))
    return F.struct(e.alias("ox"), f.alias("oy"), unit(a, along, 1).alias("ax"), unit(b, along, 0).alias("ay"), unit(c, up, 0).alias("ux"), unit(d, up, -1).alias("uy"), (width * scale).alias("width"), em.alias("em"))


def item_gap(prev: Column, nxt: Column) -> Column:
    """struct(along, across) from the end of one run to the start of the next, in the first one's frame."""
    dx = nxt["ox"] - (prev["ox"] + prev["ax"] * prev["width"])
    dy = nxt["oy"] - (prev["oy"] + prev["ay"] * prev["width"])
    return F.struct((dx * prev["ax"] + dy * prev["ay"]).alias("along"), F.abs(dx * prev["ux"] + dy * prev["uy"]).alias("across"))


def quad(frame: Column, start: Column, end: Column, ascent: Column, descent: Column) -> Column:
    """Eight numbers: the rotated rectangle over a stretch of a run."""
    corner = lambda at, up: (frame["ox"] + frame["ax"] * at + frame["ux"] * up, frame["oy"] + frame["ay"] * at + frame["uy"] * up)
    points = [*corner(start, ascent), *corner(end, ascent), *corner(end, -descent), *corner(start, -descent)]
    return F.array(*points)


def contains_rtl(text: Column) -> Column:
    return text.rlike("[֐-ࣿיִ-﷿ﹰ-ﻼ]")


def page_text(runs: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """One row per page: ``text`` and ``runs``, the runs with their places in it.

    ``runs`` has the keys, ord, str, has_eol and frame (of :func:`frame_from_matrix`). Empty runs only end lines. What
    stands between two runs follows from their geometry: a line feed after a line's end or a shift of the baseline, a
    space over a gap unless there is one already, or nothing.
    """
    page = Window.partitionBy(*keys).orderBy("ord")
    full = runs.where(F.length("str") > 0)
    # a line end counts for the run before it, whether it stands on that run or on an empty one after it
    runs = runs.withColumn("_n", F.sum(F.when(F.length("str") > 0, 1).otherwise(0)).over(page))
    ends = runs.groupBy(*keys, "_n").agg(F.max("has_eol").alias("_eol"))
    full = runs.where(F.length("str") > 0).drop("has_eol").join(ends, [*keys, "_n"])
    prev = lambda c: F.lag(c).over(page)
    full = full.withColumn("_p", prev(F.struct("str", "frame", "_eol")))
    gap = item_gap(F.col("_p.frame"), F.col("frame"))
    numeric = r"^[\d.,\-/]+$"
    ratio = F.when(F.col("_p.str").rlike(numeric) & F.col("str").rlike(numeric), NUMERIC_GAP).otherwise(SPACE_GAP)
    em = F.col("_p.frame.em")
    before = (
        F.when(F.col("_p").isNull(), "")
        .when(F.col("_p._eol"), "\n")
        .when(gap["across"] > LINE_GAP * em, "\n")
        .when(F.col("_p.str").rlike(r"\s$") | F.col("str").rlike(r"^\s"), "")
        .when(gap["along"] > ratio * em, " ")
        .otherwise("")
    )
    placed = full.withColumn("_b", before)
    end = F.sum(F.length("_b") + F.length("str")).over(page)
    placed = placed.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("str")).cast("int"))
    one = F.struct("ord", "str", "start", "end", "frame", contains_rtl(F.col("str")).alias("rtl"), "_b")
    held = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_r"))
    return held.select(*keys, F.array_join(F.transform("_r", lambda r: F.concat(r["_b"], r["str"])), "").alias("text"), F.transform("_r", lambda r: r.dropFields("_b")).alias("runs"))


def quads_for_span(runs: Column, start: Column, end: Column, measured: Column) -> Column:
    """struct(quads, used_whole_run): boxes over the runs that a span touches.

    ``measured`` is an array beside the runs: each an array of the widths of the run's first 0, 1, .. all characters
    as measured, which is scaled to the run's own width. Runs with right-to-left text are covered whole.
    """
    pairs = F.transform(runs, lambda r, i: F.struct(r.alias("r"), F.element_at(measured, i + 1).alias("w")))
    over = F.filter(pairs, lambda p: (p["r"]["start"] < end) & (p["r"]["end"] > start))

    def one(p: Column) -> Column:
        r, w = p["r"], p["w"]
        a = F.when(r["rtl"], 0).otherwise(F.greatest(r["start"], start) - r["start"])
        b = F.when(r["rtl"], F.length(r["str"])).otherwise(F.least(r["end"], end) - r["start"])
        all_of = F.element_at(w, -1)
        factor = r["frame"]["width"] / F.when(all_of != 0, all_of).otherwise(1.0)
        em = r["frame"]["em"]
        return quad(r["frame"], F.element_at(w, (a + 1).cast("int")) * factor - em * PAD, F.element_at(w, (b + 1).cast("int")) * factor + em * PAD, em * ASCENT, em * DESCENT)

    return F.struct(F.transform(over, one).alias("quads"), F.exists(over, lambda p: p["r"]["rtl"]).alias("used_whole_run"))


def text_density(runs: Column, width: Column, height: Column, scale: Column) -> Column:
    """struct(char_count, chars_per_sq_in, text_area_ratio, looks_scanned) of a page's runs and viewport."""
    chars = F.aggregate(runs, F.lit(0), lambda acc, r: acc + F.length(F.regexp_replace(r["str"], r"^\s+|\s+$", "")))
    area = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + r["frame"]["width"] * r["frame"]["em"])
    inches = F.greatest(F.lit(0.01), (width / scale / 72) * (height / scale / 72))
    per = chars / inches
    return F.struct(chars.alias("char_count"), per.alias("chars_per_sq_in"), (area / F.greatest(F.lit(1.0), width * height)).alias("text_area_ratio"), ((chars < LEAST_CHARS) | (per < LEAST_CHARS_PER_SQ_IN)).alias("looks_scanned"))


def clamp_scale(width: Column, height: Column) -> Column:
    """The largest scale up to 1 at which a surface fits the limits of area and side."""
    return F.when((width <= 0) | (height <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.lit(float(MAX_AREA)) / (width * height)), F.lit(float(MAX_SIDE)) / F.greatest(width, height)))


def pick_encoding(looks_scanned: Column, distinct_colours: Column) -> Column:
    return F.when(looks_scanned | (distinct_colours > PHOTO_COLOURS), "jpeg").otherwise("png")


def flatten_words(lines: Column) -> Column:
    """struct(text, words, mean_confidence) of recognised lines: array<array<struct<text, confidence, bbox>>>.

    Words are joined by a space, a line with words ends in a line feed, words without text don't count; a page
    without words has a mean confidence of 100.
    """
    from maskframe.operators.textview import text_view

    kept = F.filter(F.transform(lines, lambda l: F.filter(l, lambda w: F.coalesce(F.length(w["text"]), F.lit(0)) > 0)), lambda l: F.size(l) > 0)
    words = F.flatten(F.transform(kept, lambda l, n: F.transform(l, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, " ").when(n > 0, "\n").otherwise("").alias("before")))))
    parts = F.transform(words, lambda x, i: F.struct(x["w"]["text"].alias("text"), x["before"].alias("before"), i.alias("src_start"), (i + 1).alias("src_end"), i.alias("ref")))
    view = text_view(parts)
    listed = F.transform(view["segments"], lambda s, i: F.struct(s["view_start"].alias("start"), s["view_end"].alias("end"), F.element_at(words, i + 1)["w"]["bbox"].alias("bbox"), F.coalesce(F.element_at(words, i + 1)["w"]["confidence"], F.lit(0.0)).alias("confidence")))
    mean = F.aggregate(words, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["w"]["confidence"], F.lit(0.0))) / F.size(words)
    text = F.when(F.size(words) > 0, F.concat(view["text"], F.lit("\n"))).otherwise("")
    return F.struct(text.alias("text"), listed.alias("words"), F.when(F.size(words) > 0, mean).otherwise(100.0).alias("mean_confidence"))


def boxes_for_span(words: Column, start: Column, end: Column) -> Column:
    return F.transform(F.filter(words, lambda w: (w["start"] < end) & (w["end"] > start)), lambda w: w["bbox"])


def low_confidence_spans(words: Column, threshold: float = LOW_CONFIDENCE) -> Column:
    return F.transform(F.filter(words, lambda w: w["confidence"] < threshold), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end")))


def page_warnings(scanned: Column, mean_confidence: Column, n_words: Column) -> Column:
    """Codes of a page's warnings."""
    codes = F.array(F.when(scanned, "scanned-page"), F.when((mean_confidence < LOW_MEAN_CONFIDENCE) & (n_words >= 1), "low-ocr-confidence"))
    return F.array_compact(codes)


def output_large(in_bytes: Column, out_bytes: Column) -> Column:
    return (out_bytes > in_bytes * LARGE_FACTOR) & (out_bytes > LARGE_BYTES)
