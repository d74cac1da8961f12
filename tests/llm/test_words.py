import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from maskframe.llm import words as W

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="abAB 01.,\n\t\x00éß\x0b\x1c日", max_size=30)), max_size=6)


def split(table, texts, size=W.CHUNK_BYTES):
    out = []
    for _, w in W.batches(pa.array(texts, pa.string()), table, size):
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            out.append([bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
    return out


@settings(deadline=None, max_examples=150)
@given(TEXT, st.sampled_from([1, 5, 1 << 20]))
def test_words_are_the_patterns(texts, size):
    assert split(W.space_table(False), texts, size) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert split(W.alnum_table(), texts, size) == [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for t in texts]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="abAB é", max_size=20), min_size=1, max_size=5))
def test_hashes_tell_words_apart(texts):
    seen = {}
    for _, w in W.batches(pa.array(texts), W.space_table(True)):
        for s, e, h in zip(w.start, w.end, w.hash.tolist(), strict=True):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bytes(w.data[s:e]).decode())
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_in_their_document():
    w = W.split_words(*W.text_buffers(pa.array(["a b c d", "a b", None, "x a b c"])), W.space_table(False))
    full, ok = W.windows(w, 3)
    assert ok.tolist() == [True, True, False, False, False, False, True, True, False, False]
    assert full[0] == full[7] and full[0] != full[1]
    assert [len(s) for s in W.shingle_sets(w, 3)] == [2, 1, 0, 2]
    assert np.array_equal(W.shingle_sets(w, 4)[0], W.shingle_sets(W.split_words(*W.text_buffers(pa.array(["a b c d"])), W.space_table(False)), 4)[0])
