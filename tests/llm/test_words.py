import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratakeep.llm.words import ALNUM, PLAIN, Words, chunks, shingle_sets

TEXTS = st.lists(st.one_of(st.none(), st.text("aZ \n\t,.1éß😀", max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((PLAIN, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        w = Words(pa.array(texts, pa.string()), table)
        data = w.data.tobytes()
        got = [[data[w.starts[k] : w.ends[k]].decode() for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
        assert got == [re.findall(pattern, t or "") for t in texts]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingles_count_and_equality(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    got = list(shingle_sets(pa.array(texts, pa.string()), 4))
    assert [len(x) for x in got] == [len(x) for x in sets]
    for a, x in zip(sets, got):
        for b, y in zip(sets, got):
            assert len(a & b) == len(np.intersect1d(x, y))


def test_chunks_keep_rows_and_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (k * 37 % 90) for k in range(49)] + [None])], ["k", "text"])
    parts = list(chunks(iter([batch, batch.slice(0, 0)]), "text", 100))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(50)) and len(parts) > 5
