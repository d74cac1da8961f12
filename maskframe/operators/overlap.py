"""Resolution of overlapping spans: a sweep in order of start, as one fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.kernel import code_points, cut, let, sweep
from maskframe.functions.registry import SPACE, lookup

_KEPT = "struct<category:string,s:int,e:int>"


def resolve_overlaps(spans: Column, text: Column) -> Column:
    """Disjoint spans that leave no covered word character uncovered.

    Spans are taken by start, then priority, then length, then place in the array. One that ends inside what is
    covered is dropped. One that reaches beyond it extends the last span kept if they are of one category or the border
    splits a word; else what reaches beyond is kept on its own, unless it is only white space and punctuation.
    """
    order = F.transform(
        spans,
        lambda x, i: F.struct(x["start"].alias("s"), lookup(x["category"], "priority").alias("p"), (x["start"] - x["end"]).alias("shorter"), i.alias("i"), x["end"].alias("e"), x["category"].alias("category")),
    )

    def resolved(codes: Column) -> Column:
        # the last span may still grow, so it is listed when the next one is kept
        def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
            cursor, last = acc["cursor"], acc["last"]
            beyond = x["e"] > cursor
            apart = x["s"] >= cursor
            splits_word = cut(codes, cursor - 1, 2).rlike(r"^[\p{L}\p{N}_]{2}")
            blank = cut(codes, cursor, x["e"] - cursor).rlike(rf"^[{SPACE}\p{{P}}\p{{S}}]*$")
            grows = beyond & ~apart & ((last["category"] == x["category"]) | splits_word)
            new = beyond & (apart | (~grows & ~blank))
            one = lambda category, s: F.struct(category.alias("category"), s.alias("s"), x["e"].alias("e"))
            following = F.when(new, one(x["category"], F.greatest(x["s"], cursor))).when(grows, one(last["category"], last["s"])).otherwise(last)
            return {"cursor": F.when(new | grows, x["e"]).otherwise(cursor), "last": following}, new & (cursor >= 0), F.array(last)

        swept = sweep(F.array_sort(order), {"cursor": F.lit(-1), "last": F.lit(None).cast(_KEPT)}, step, f"array<{_KEPT}>")
        kept = let(swept, lambda r: F.concat(r["out"], F.array(r["last"])))
        return F.transform(kept, lambda x: F.struct(x["category"].alias("category"), x["s"].alias("start"), x["e"].alias("end"), cut(codes, x["s"], x["e"] - x["s"]).alias("text")))

    return F.when(F.size(spans) > 1, let(code_points(text), resolved)).otherwise(spans)
