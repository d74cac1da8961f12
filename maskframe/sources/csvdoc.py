"""Delimited files as cells with their places, and back. Cells are plain values; a header row is a row.

Spark's own reader keeps neither places nor quotes nor ragged rows, so parsing is an Arrow function; the flat view and
the cuts are column expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
CELL = "struct<row:int,col:int,value:string,start:int,end:int,quoted:boolean>"
PARSED = f"struct<cells:array<{CELL}>,rows:int,delimiter:string,eol:string,tail:string>"


def _outside_quotes(line: str, delimiter: str) -> int:
    # a doubled quote closes and opens again, which counts the same
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def detect_delimiter(text: str) -> str:
    """The delimiter that gives most of the first ten lines the first one's number of fields; then most fields."""
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if x][:10]
    best, top = ",", -1
    for d in DELIMITERS:
        counts = [_outside_quotes(x, d) + 1 for x in lines]
        if not counts or counts[0] < 2:
            continue
        score = 100 * counts.count(counts[0]) + counts[0]
        if score > top:
            best, top = d, score
    return best


def parse(text: str, delimiter: str | None = None) -> dict:
    """Cells of a file. What follows a closing quote belongs to its cell, so nothing of the file is lost."""
    sep = delimiter or detect_delimiter(text)
    cells, row, col, at, n = [], 0, 0, 0, len(text)
    while at < n:
        begin, value, quoted = at, [], text[at] == '"'
        if quoted:
            at += 1
            while at < n:
                close = text.find('"', at)
                if close < 0:
                    value.append(text[at:])
                    at = n
                elif text[close + 1 : close + 2] == '"':
                    value.append(text[at : close + 1])
                    at = close + 2
                    continue
                else:
                    value.append(text[at:close])
                    at = close + 1
                break
        stop = at
        while stop < n and text[stop] != sep and text[stop] not in "\r\n":
            stop += 1
        value.append(text[at:stop])
        at = stop
        cells.append({"row": row, "col": col, "value": "".join(value), "start": begin, "end": at, "quoted": quoted})
        if at >= n:
            break
        if text[at] == sep:
            at, col = at + 1, col + 1
            if at == n:
                cells.append({"row": row, "col": col, "value": "", "start": n, "end": n, "quoted": False})
        else:
            at += 2 if text.startswith("\r\n", at) else 1
            row, col = row + 1, 0
    tail = "\r\n" if text.endswith("\r\n") else text[-1:] if text[-1:] in ("\n", "\r") else ""
    return {"cells": cells, "rows": cells[-1]["row"] + 1 if cells else 0, "delimiter": sep, "eol": "\r\n" if "\r\n" in text else "\n", "tail": tail}


def parse_csv(text: Column, delimiter: str | None = None) -> Column:
    """struct(cells, rows, delimiter, eol, tail) of a text column; ``tail`` is the line end after the last row."""

    @F.pandas_udf(PARSED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t or "", delimiter) for t in texts], columns=["cells", "rows", "delimiter", "eol", "tail"])

    return run(text)


def csv_view(parsed: Column) -> Column:
    """struct(text, segments): values joined by a space in a row and a line feed between rows, and where each lies.

    Separators belong to no cell, and empty values have no segment.
    """
    from maskframe.operators.textview import text_view

    cells = parsed["cells"]
    parts = F.transform(
        cells,
        lambda c, i: F.struct(c["value"].alias("text"), F.when(i == 0, "").when(c["row"] != F.element_at(cells, F.greatest(i, F.lit(1)))["row"], "\n").otherwise(" ").alias("before"), c["start"].alias("src_start"), c["end"].alias("src_end"), i.alias("ref")),
    )
    return text_view(parts)


def serialize_csv(parsed: Column, values: Column) -> Column:
    """The file with the given values (an array beside the cells). A value is quoted if it holds the delimiter, a quote
    or a line end, or if it is empty and was quoted."""
    cells, sep = parsed["cells"], parsed["delimiter"]

    def one(c: Column, i: Column) -> Column:
        v = F.element_at(values, i + 1)
        must = F.contains(v, sep) | v.rlike('["\r\n]') | (c["quoted"] & (v == ""))
        quoted = F.when(must, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
        before = F.when(i == 0, "").when(c["row"] != F.element_at(cells, F.greatest(i, F.lit(1)))["row"], parsed["eol"]).otherwise(sep)
        return F.concat(before, quoted)

    return F.concat(F.array_join(F.transform(cells, one), ""), parsed["tail"])


def redacted_values(parsed: Column, view: Column, items: Column) -> Column:
    """Cell values with the items' replacements. An item is cut from the cell it starts in, and from later cells only
    where it covers their whole value."""
    from maskframe.operators.textview import range_to_source

    cuts = F.flatten(
        F.transform(
            F.filter(items, lambda x: ~x["kept"]),
            lambda x: F.transform(
                F.filter(
                    F.transform(range_to_source(view["segments"], x["start"], x["end"]), lambda s, i: F.struct(i.alias("i"), s.alias("s"))),
                    lambda p: (p["i"] == 0) | (F.trim(F.substr(F.element_at(parsed["cells"], p["s"]["ref"] + 1)["value"], p["s"]["frag_start"] + 1, p["s"]["frag_end"] - p["s"]["frag_start"])) == F.trim(F.element_at(parsed["cells"], p["s"]["ref"] + 1)["value"])),
                ),
                lambda p: F.struct((-p["s"]["frag_start"]).alias("k"), p["s"]["ref"].alias("ref"), p["s"]["frag_start"].alias("start"), p["s"]["frag_end"].alias("end"), x["replacement"].alias("with")),
            ),
        )
    )

    def apply(value: Column, mine: Column) -> Column:
        # from the right, so that places stay true
        start = F.struct(value.alias("v"), F.lit(2147483647).alias("last"))
        step = lambda acc, c: F.when(c["end"] > acc["last"], acc).otherwise(F.struct(F.concat(F.substr(acc["v"], F.lit(1), c["start"]), c["with"], F.substr(acc["v"], c["end"] + 1)).alias("v"), c["start"].alias("last")))
        return F.aggregate(F.array_sort(mine), start, step, lambda acc: acc["v"])

    from maskframe.functions.kernel import let

    return let(cuts, lambda all_cuts: F.transform(parsed["cells"], lambda c, i: apply(c["value"], F.filter(all_cuts, lambda x: x["ref"] == i))))
