"""Bytes to text and back. Unicode is decoded in the JVM; only files that aren't valid UTF-8 go through Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Encodings and their names.
ENCODINGS = {"utf-8": "Unicode (UTF-8)", "utf-16le": "Unicode (UTF-16, little-endian)", "utf-16be": "Unicode (UTF-16, big-endian)", "windows-1252": "Western European (Windows-1252)", "windows-1255": "Hebrew (Windows-1255)"}
_BOM = bytes.fromhex("EFBBBF")


def guess_legacy(raw: bytes) -> str:
    """Hebrew code page if most bytes over 0x7F are its letters, else the Western one."""
    hebrew = sum(0xE0 <= b <= 0xFA for b in raw)
    return "windows-1255" if hebrew > sum(b >= 0x80 for b in raw) - hebrew else "windows-1252"


def _table(codec: str) -> list[str]:
    """Characters of a code page; bytes without one stand for the control character of their number."""
    return [bytes([i]).decode(codec, "ignore") or chr(i) for i in range(256)]


def decode_bytes(raw: bytes, encoding: str) -> str:
    """Lenient decoding; a byte order mark of the encoding itself isn't part of the text."""
    if encoding.startswith("windows"):
        table = _table(encoding.replace("windows-", "cp"))
        return "".join([table[b] for b in raw])
    mark = {"utf-8": _BOM, "utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}[encoding]
    return raw.removeprefix(mark).decode(encoding, "replace")


def _legacy_udf():
    @F.pandas_udf("struct<text:string,encoding:string>")
    def legacy(raw: pd.Series, forced: pd.Series) -> pd.DataFrame:
        names = [f or (guess_legacy(r) if r is not None else None) for r, f in zip(raw, forced, strict=True)]
        return pd.DataFrame({"text": [None if r is None else decode_bytes(r, n) for r, n in zip(raw, names, strict=True)], "encoding": names})

    return legacy


def decode_text(content: Column, forced: str | None = None) -> Column:
    """struct(text, encoding, had_bom, guessed). A forced encoding wins, then a byte order mark, then valid UTF-8;
    otherwise a code page is guessed."""
    code = F.hex(F.substring(content, 1, 3))
    legacy = _legacy_udf()

    def out(text: Column, encoding: Column | str, bom: Column | bool, guessed: bool) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(text.alias("text"), lit(encoding).alias("encoding"), lit(bom).alias("had_bom"), F.lit(guessed).alias("guessed"))

    if forced is not None:
        if forced not in ENCODINGS:
            raise ValueError(f"unknown encoding {forced}")
        return out(legacy(content, F.lit(forced))["text"], forced, code == "EFBBBF", False)
    body = F.substring(content, 4, 2147483647)
    wide = F.substring(content, 3, 2147483647)
    found = legacy(F.when(~F.is_valid_utf8(content.cast("string")) & ~code.rlike("^(?:FFFE|FEFF|EFBBBF)"), content), F.lit(None).cast("string"))
    return (
        F.when(content.isNull(), F.lit(None))
        .when(code == "EFBBBF", out(F.make_valid_utf8(body.cast("string")), "utf-8", True, False))
        .when(code.startswith("FFFE"), out(F.decode(wide, "UTF-16LE"), "utf-16le", True, False))
        .when(code.startswith("FEFF"), out(F.decode(wide, "UTF-16BE"), "utf-16be", True, False))
        .when(F.is_valid_utf8(content.cast("string")), out(content.cast("string"), "utf-8", False, False))
        .otherwise(out(found["text"], found["encoding"], False, True))
    )


def encode_text(text: Column, had_bom: Column) -> Column:
    """UTF-8 bytes, with a byte order mark if the input had one."""
    raw = F.encode(text, "UTF-8")
    return F.when(had_bom, F.concat(F.lit(_BOM), raw)).otherwise(raw)
