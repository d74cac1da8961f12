"""Flat views of positioned text: fragments with separators between them, and the way back to the fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.kernel import sweep

SEGMENT = "array<struct<src_start:int,src_end:int,view_start:int,view_end:int,ref:int>>"


def text_view(parts: Column) -> Column:
    """struct(text, segments) of an array of struct(text, before, src_start, src_end, ref).

    ``before`` is glue that belongs to no source; an empty fragment has no segment.
    """

    def step(acc: Column, p: Column) -> tuple[dict[str, Column], Column, Column]:
        s = acc["at"] + F.length(p["before"])
        e = s + F.length(p["text"])
        one = F.struct(p["src_start"].alias("src_start"), p["src_end"].alias("src_end"), s.cast("int").alias("view_start"), e.cast("int").alias("view_end"), p["ref"].cast("int").alias("ref"))
        return {"at": e.cast("int")}, e > s, F.array(one)

    text = F.array_join(F.transform(parts, lambda p: F.concat(p["before"], p["text"])), "")
    return F.struct(text.alias("text"), sweep(parts, {"at": F.lit(0)}, step, SEGMENT)["out"].alias("segments"))


def range_to_source(segments: Column, start: Column, end: Column) -> Column:
    """Fragments that a half-open range of the view touches, with the touched part of each."""
    over = F.filter(segments, lambda s: (s["view_start"] < end) & (s["view_end"] > start) & (end > start))
    return F.transform(
        over,
        lambda s: F.struct(
            s["ref"].alias("ref"), s["src_start"].alias("src_start"), s["src_end"].alias("src_end"),
            (F.greatest(s["view_start"], start) - s["view_start"]).alias("frag_start"), (F.least(s["view_end"], end) - s["view_start"]).alias("frag_end"),
        ),
    )
