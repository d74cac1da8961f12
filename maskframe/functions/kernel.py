"""The scan that all detectors run on, as one column expression, and the folds that it and later steps use.

A regular scan takes the leftmost match, goes on after it if it is accepted and one character after its start if not.
Where every match is accepted, one replacement puts marks around each. Where a match may be refused, its pattern is of
bounded length: a lookahead then marks the candidate at every position, and a fold keeps those that start at or after
the last accepted end. Either way the marked text is a constant times the text at most, and so is the work.

Marks are control characters; those that a text has itself are matched as another control character.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.validators import VALIDATORS

SPAN = "array<struct<category:string,start:int,end:int,text:string>>"
_OPEN, _CLOSE, _GROUP, _OTHER = "\u0001", "\u0002", "\u0003", "\u0004"
#: Elements that a fold holds in one growing array before it starts the next: appending copies the array.
_CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_spans() -> Column:
    return F.array().cast(SPAN)


def code_points(text: Column) -> Column:
    """The text in a form in which :func:`cut` finds a place without counting from the start."""
    return F.encode(text, "UTF-32")


def cut(codes: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` code points from ``start`` (from 0) of :func:`code_points`."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.decode(F.substr(codes, (lit(start) * 4 + 1).cast("int"), (F.greatest(lit(length), F.lit(0)) * 4).cast("int")), "UTF-32")


def sweep(values: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column | None, Column]], kind: str) -> Column:
    """struct(*state, out) of a fold over an array that lists what its steps emit, in time linear in what it lists.

    ``step`` gives, for the state and an element, the next state, whether something is listed (None: always), and the
    array of what is; ``kind`` is that array's type.
    """
    none = F.array().cast(kind)

    def held(acc: Column) -> list[Column]:
        return [acc[n].alias(n) for n in state]

    def inner(acc: Column, x: Column) -> Column:
        following, emits, listed = step(acc, x)
        longer = F.concat(acc["out"], listed)
        out = longer if emits is None else F.when(emits, longer).otherwise(acc["out"])
        return F.struct(*(following[n].alias(n) for n in state), out.alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        # no transform around it: that would copy all that has been listed
        return F.concat(acc, F.array(F.aggregate(chunk, F.struct(*held(F.element_at(acc, -1)), none.alias("out")), inner)))

    def run(items: Column) -> Column:
        parts = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / _CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        # element by element: a slice would convert the whole array each time
        chunks = F.transform(parts, lambda i: F.transform(F.sequence(i * _CHUNK + 1, F.least((i + 1) * _CHUNK, F.size(items))), lambda j: F.element_at(items, j)))
        start = F.struct(*(c.alias(n) for n, c in state.items()), none.alias("out"))
        long = F.aggregate(chunks, F.array(start), outer, lambda acc: F.struct(*held(F.element_at(acc, -1)), F.flatten(F.transform(acc, lambda x: x["out"])).alias("out")))
        # few elements, as most texts have, need no chunks
        return F.when(F.size(items) <= _CHUNK, F.aggregate(items, start, inner)).otherwise(long)

    return let(values, run)


@dataclass(frozen=True)
class Scan:
    """One pattern's scan. ``part``: the span is the whole match, or the group at its ``head`` or ``tail``. ``gate`` is
    a cheap pattern that a text with a match always has. ``valid`` names a check that refuses matches, so that the scan
    goes on one character after their start; a pattern with it must be of bounded length. ``after`` names one that only
    leaves spans out."""

    pattern: str | Column
    category: str
    part: str = "whole"
    valid: str | None = None
    after: str | None = None
    gate: str | None = None


def scan(text: Column, *scans: Scan) -> Column:
    """Spans of all scans in code points, ends exclusive, scan by scan and in order; none for a null text.

    Each scan only marks the text; one expression for all of them reads the marks.
    """
    if not scans:
        return empty_spans()

    def marked(clean: Column, x: Scan) -> Column:
        before, behind = ("(?=(", "))") if x.valid else ("(", ")")
        wrapped = F.lit(before + x.pattern + behind) if isinstance(x.pattern, str) else F.concat(F.lit(before), x.pattern, F.lit(behind))
        text_of = F.regexp_replace(clean, wrapped, F.lit(_OPEN + "$1" + (_GROUP + "$2" if x.part != "whole" else "") + _CLOSE))
        one = F.struct(F.lit(x.category).alias("category"), F.lit(x.part).alias("part"), F.lit(x.valid or "").alias("valid"), F.lit(x.after or "").alias("after"), text_of.alias("text"))
        return F.when(clean.rlike(x.gate), one) if x.gate else one

    valid = sorted({x.valid for x in scans if x.valid})
    after = sorted({x.after for x in scans if x.after})
    parts = {x.part for x in scans}
    own = text.rlike(f"[{_OPEN}-{_GROUP}]")

    def check(name: Column, names: list[str], value: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out = F.when(name == n, VALIDATORS[n](value)).otherwise(out)
        return out

    def spans(m: Column) -> Column:
        def step(acc: Column, piece: Column) -> tuple[dict[str, Column], Column | None, Column]:
            s, size = acc["at"], piece["size"]
            e = s + size
            begin = s if parts <= {"whole", "head"} else F.when(m["part"] == "tail", e - piece["long"]).otherwise(s)
            span = F.struct(begin.cast("int").alias("s"), (begin + piece["long"]).cast("int").alias("e"), piece["inside"].alias("t"))
            ok = (m["valid"] == "") | ((s >= acc["cursor"]) & check(m["valid"], valid, piece["whole"])) if valid else None
            listed = ok
            if after:
                fine = check(m["after"], after, piece["inside"])
                listed = fine if ok is None else ok & fine
            at = (e if not valid else F.when(m["valid"] == "", e).otherwise(s)) + piece["rest"]
            return {"at": at.cast("int"), "cursor": (F.when(ok, e).otherwise(acc["cursor"]) if valid else e).cast("int")}, listed, F.array(span)

        def read(piece: Column) -> Column:
            close = F.instr(piece, _CLOSE)
            match = F.substr(piece, F.lit(1), close - 1)
            rest = F.length(piece) - close
            whole, inside = match, match
            if parts != {"whole"}:
                bar = F.instr(match, _GROUP)
                whole = F.when(bar > 0, F.substr(match, F.lit(1), bar - 1)).otherwise(match)
                inside = F.when(bar > 0, F.substr(match, bar + 1)).otherwise(match)
            return F.struct(F.length(whole).alias("size"), F.length(inside).alias("long"), rest.alias("rest"), whole.alias("whole"), inside.alias("inside"))

        def found(pieces: Column) -> Column:
            first = F.length(F.element_at(pieces, 1)).cast("int")
            read_pieces = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), read)
            return sweep(read_pieces, {"at": first, "cursor": F.lit(0)}, step, "array<struct<s:int,e:int,t:string>>")["out"]

        return F.transform(let(F.split(m["text"], _OPEN, -1), found), lambda x: F.struct(m["category"].alias("category"), x["s"].alias("start"), x["e"].alias("end"), x["t"].alias("text")))

    def run(clean: Column) -> Column:
        return F.flatten(F.transform(F.array_compact(F.array(*(marked(clean, x) for x in scans))), spans))

    def with_own_marks(found: Column) -> Column:
        return let(code_points(text), lambda c: F.transform(found, lambda x: F.struct(x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"), cut(c, x["start"], x["end"] - x["start"]).alias("text"))))

    clean = F.when(own, F.translate(text, _OPEN + _CLOSE + _GROUP, _OTHER * 3)).otherwise(text)
    # a text that has marks of its own gets them back
    found = let(let(clean, run), lambda x: F.when(own & (F.size(x) > 0), with_own_marks(x)).otherwise(x))
    return F.when(text.isNotNull(), found).otherwise(empty_spans())
