"""Secret scan: fixed forms of keys, and credential values whose cheapest guess is dear.

The fixed forms are assignments to credential names, access key ids and long hexadecimal runs. Beside them, every
value in a credential context (a name of a wider list, then a colon or equals sign) is split by dynamic programming
at minimum guess cost into ranked words, dates, repeats, keyboard walks and brute-force stretches; a value whose
cheapest split takes ``THRESHOLD`` decimal digits of guesses or more is a finding of kind ``guess``. The ranked words
are the whole words of a tokenizer's vocabulary, which lists frequent ones first, behind a few common passwords; letters
in no word are guessed one by one. The splitting takes time in proportion to the value's length.

A batch is scanned as one byte string with a line feed between documents, which no form contains. Candidates come
from vectorised class flags (hexadecimal runs, colons and equals signs) or a literal search, so that regular
expressions only run where one can match.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskframe.llm import words as W
from maskframe.llm.shared import ensure_importable, release

KINDS = ("assign", "access", "hex", "guess")
#: Decimal digits of guesses from which a credential value counts as a secret, and the least length of one.
THRESHOLD = 8.0
LEAST_LENGTH = 6

_ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_VALUE = re.compile(rb"""\x20*[:=]>?\x20*["'`]?([^\s"'`<>,;]+)""")
#: The names of the assign form, longest first where one ends another.
ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Names before a colon or equals sign that make a value a credential's.
CONTEXT_NAMES = (*ASSIGN_NAMES, b"passphrase", b"passcode", b"pwd", b"pass", b"pin", b"secret_key", b"secretkey", b"access_key", b"accesskey", b"access_token", b"auth_token", b"auth", b"bearer", b"client_secret", b"private_key", b"credential", b"credentials", b"passwort", b"kennwort", b"mot de passe", "contraseña".encode(), b"clave")
_LONGEST_NAME = max(map(len, CONTEXT_NAMES))

# Common passwords and words in them, the most usual first.
COMMON_WORDS = """password qwerty letmein welcome admin login monkey dragon master shadow sunshine princess football
baseball iloveyou trustno hello freedom whatever secret summer winter spring autumn flower superman batman pass test
guest root user default change changeme please love angel jordan michael daniel hunter ranger buster soccer hockey
killer george charlie andrew thomas robert jessica pepper ginger access money mustang maggie cookie cheese computer
internet service server system database example sample demo temp none null true false your here enter value string
token key correct horse battery staple january february march april june july august september october november
december monday tuesday wednesday thursday friday saturday sunday""".split()
_WORD_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
# Keyboard rows and plain sequences on which walks are made.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_STEPS = {(r[i], r[i + d]): d for r in _ROWS for i in range(len(r)) for d in (1, -1) if 0 <= i + d < len(r)} | {(r[i], s[i]): 2 for r, s in zip(_ROWS[:3], _ROWS[1:4], strict=True) for i in range(min(len(r), len(s)))}
# Usual letter substitutions.
_LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})
_DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?(?:0?[1-9]|1[0-2])(?:[-/.]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d))")
#: The longest word, date, part of a walk or brute-force stretch that is tried; whole walks and repeats are besides.
_SEGMENT = 24
#: Values that a worker remembers the cost of.
_REMEMBERED = 20_000


def ranked_words(path: str) -> dict[str, int]:
    """Ranks of words by a BPE vocabulary file: common passwords first, then its whole words of 3 letters or more in
    the order of their ids."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [w.removesuffix("</w>") for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>")]
    listed = dict.fromkeys([*COMMON_WORDS, *(w for w in words if len(w) >= 3 and w.isalpha())])
    return {w: i for i, w in enumerate(listed, 1)}


def _classes(c: str) -> int:
    """The number of the character's class: digits, lower case, upper case, all else."""
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


_CLASS_SIZE = (10, 26, 26, 33)


def _brute(s: str) -> float:
    return len(s) * math.log10(max(10, sum(_CLASS_SIZE[k] for k in {_classes(c) for c in s})))


class GuessCost:
    """Decimal digits of the guesses for a value, with ranks of words."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.ranks = ranks or {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
        self.known: dict[str, float] = {}

    def segments(self, v: str) -> dict[tuple[int, int], float]:
        """The cheapest pattern for each span of v that is one."""
        low, plain, n, ranks = v.lower(), v.lower().translate(_LEET), len(v), self.ranks
        if len(low) != n:
            low = plain = v  # letters whose lower case is longer are no words
        found: dict[tuple[int, int], float] = {}

        def put(i: int, j: int, cost: float) -> None:
            found[i, j] = min(cost, found.get((i, j), math.inf))

        # how far the walk, and the repeats of each length, reach that start at a character, from the right
        steps = [_STEPS.get((low[i], low[i + 1])) for i in range(n - 1)]
        walk = [n] * n
        for i in range(n - 2, -1, -1):
            walk[i] = walk[i + 1] if steps[i] is not None else i + 1
        turns = list(accumulate([0, *(int(a is not None and b is not None and a != b) for a, b in zip(steps, steps[1:]))]))
        reach = {}
        for unit in (1, 2, 3, 4):
            r = [n] * n
            for i in range(n - unit - 1, -1, -1):
                r[i] = r[i + 1] if v[i] == v[i + unit] else i + unit
            reach[unit] = r
        for i in range(n):
            for j in range(i + 3, min(n, i + _SEGMENT) + 1):
                word = low[i:j]
                rank, more = ranks.get(word), 0.0
                if rank is None:
                    rank, more = ranks.get(plain[i:j]), 0.7
                if rank is not None:
                    part = v[i:j]
                    case = 0.0 if part.islower() or not part.isalpha() else 0.3 if part[0].isupper() and part[1:].islower() else 1.0
                    put(i, j, math.log10(rank + 1) + case + more)
            if m := _DATE.match(v, i):
                put(i, m.end(), 2.2 if m.end() - i <= 4 else 4.6)
            for j in {*range(i + 3, min(walk[i], i + _SEGMENT) + 1), walk[i]}:
                if j - i >= 3:
                    put(i, j, math.log10(20 * (j - i)) + 0.6 * (turns[j - 2] - turns[i]))
            for unit, r in reach.items():
                times = (r[i] - i) // unit
                if times * unit >= max(3, 2 * unit):
                    put(i, i + times * unit, _brute(v[i : i + unit]) + math.log10(times))
        return found

    def digits(self, v: str) -> float:
        """Decimal digits of the guesses that the cheapest split of v takes."""
        if v in self.known:
            return self.known[v]
        n = len(v)
        ends: dict[int, list[tuple[int, float]]] = {}
        for (i, j), c in self.segments(v).items():
            ends.setdefault(j, []).append((i, c))
        counts = [list(accumulate([0, *(int(_classes(c) == k) for c in v)])) for k in range(4)]
        best = [0.0]
        for j in range(1, n + 1):
            options = [(best[i] + c + (0.3 if i else 0)) for i, c in ends.get(j, ())]
            for i in range(max(0, j - _SEGMENT), j):
                size = sum(_CLASS_SIZE[k] for k in range(4) if counts[k][j] > counts[k][i])
                options.append(best[i] + (j - i) * math.log10(max(10, size)) + (0.3 if i else 0))
            best.append(min(options))
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        self.known[v] = best[-1]
        return best[-1]


def _runs(flag: np.ndarray, least: int) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    s, e = edge[::2], edge[1::2]
    return np.stack([s, e], 1)[e - s >= least]


_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


def scan_bytes(buf: bytes, cost: GuessCost) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value's start, value's end) in bytes of all findings, in order."""
    raw = np.frombuffer(buf, np.uint8)
    found = [(s, 2, e, s, e) for s, e in _runs(_HEX[raw], 16).tolist()]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(buf) if m.end() - m.start() >= 18]
    signs = np.flatnonzero((raw == 58) | (raw == 61))
    if len(signs):
        # the last byte before the sign, its spaces and one quote must end a name
        low = buf.lower()
        cursor, values = 0, []
        last = frozenset(n[-1] for n in CONTEXT_NAMES)
        for p in signs.tolist():
            q = p
            while q and buf[q - 1] == 32:
                q -= 1
            if q and buf[q - 1] in b"\"'":
                q -= 1
            if not q or low[q - 1] not in last:
                continue
            tail = low[max(0, q - _LONGEST_NAME) : q]
            name = max((n for n in CONTEXT_NAMES if tail.endswith(n)), key=len, default=None)
            if name is None:
                continue
            own = next((n for n in ASSIGN_NAMES if tail.endswith(n)), None)
            if own and q - len(own) >= cursor and (m := _ASSIGN.match(buf, q - len(own))):
                cursor = m.end()
                if m.end(1) - m.start(1) >= 12:
                    found.append((m.start(), 0, m.end(), m.start(1), m.end(1)))
            before = low[q - len(name) - 1 : q - len(name)] if q > len(name) else b" "
            if not before.isalnum() and (m := _VALUE.match(buf, p)):
                values.append((m.start(1), m.end(1)))
        covered = sorted((v, e) for _, _, _, v, e in found)
        begins, reach = [v for v, _ in covered], list(accumulate((e for _, e in covered), max))
        for s, e in values:
            while e > s and buf[e - 1] in b".)]}":
                e -= 1
            v = buf[s:e].decode()
            if len(v) >= LEAST_LENGTH and not ((at := bisect_right(begins, s)) and reach[at - 1] >= e) and cost.digits(v) >= THRESHOLD:
                found.append((s, 3, e, s, e))
    return sorted(set(found))


def scan_batch(column: pa.Array, cost: GuessCost) -> list[list[tuple[int, int, int, int, int]]]:
    """Findings of each text in code points."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    out: list[list] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= W.CHUNK_BYTES):
            held += len(texts[stop])
            stop += 1
        some = texts[at:stop]
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])])
        by: dict[int, list] = {}
        for f in scan_bytes(b"\n".join(some), cost):
            by.setdefault(int(np.searchsorted(first, f[0], "right")) - 1, []).append(f)
        for d, fs in by.items():
            raw = np.frombuffer(some[d], np.uint8)
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            base = int(first[d])
            out[at + d] = [(int(points[s - base]), k, int(points[e - base]), int(points[vs - base]), int(points[ve - base])) for s, k, e, vs, ve in fs]
        at = stop
    return out


def _listed(found: list, kinds: tuple[int, ...]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _, _ in found if k in kinds)


def secret_report(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row; spans in code points, ends exclusive.

    A null text is empty, an empty text or table has no findings. An assign span is the whole match, from the name on;
    a guess span is the value. Values that a base finding's value covers aren't listed again; findings that start
    together are listed in the order of kinds. Rows that repeat a doc_id are scanned each on their own, and other
    columns aren't read. ``ranks`` are those of :func:`ranked_words`, a few ten thousand words.
    """
    ensure_importable(docs.sparkSession)

    def run(batches):
        cost = GuessCost(ranks)
        for b in batches:
            found = scan_batch(b.column(1), cost)
            counts = [[sum(f[1] == k for f in fs) for fs in found] for k in range(3)]
            base = [hashlib.sha256(_listed(fs, (0, 1, 2)).encode()).hexdigest() for fs in found]
            spans = [_listed(fs, (0, 1, 2, 3)) for fs in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", ranks: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with the value of every finding replaced by ``mask``; names and other text stay, as do all rows, nulls,
    empty texts and other columns."""
    ensure_importable(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def redact(text: str | None, found: list) -> str | None:
        out, cursor = [], 0
        for vs, ve in sorted((f[3], f[4]) for f in found):
            if vs >= cursor:
                out += [text[cursor:vs], mask]
            cursor = max(cursor, ve)
        return "".join([*out, text[cursor:]]) if out else text

    def run(batches):
        release()
        cost = GuessCost(ranks)
        for b in (part for batch in batches for part in W.slices(batch, at)):
            texts = [redact(t, fs) for t, fs in zip(b.column(at).to_pylist(), scan_batch(b.column(at), cost), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)
