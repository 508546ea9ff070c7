import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from cohortfold.llm.words import slices, utf8, words

_TEXT = st.text(alphabet=st.sampled_from(list("aAbZé  \t\n\x0b\x1c\x85,日")), max_size=40)


@given(st.lists(st.one_of(st.none(), _TEXT), max_size=8))
def test_words_equal_the_pattern(texts):
    w = words(*utf8(pa.array(texts, pa.string())))
    told = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [[x.decode() for x in w.of(i)] for i in range(len(texts))] == told
    flat, hashes = [x for t in told for x in t], w.hashes()
    assert len(set(hashes.tolist())) == len(set(flat)) and all((hashes[i] == hashes[j]) == (a == b) for i, a in enumerate(flat) for j, b in enumerate(flat))


def test_long_words_and_lower_case():
    texts = ["a" * 5000 + "b", "a" * 5000 + "c", "A" * 5000 + "B", "x" * 3_000_000]
    h = words(*utf8(pa.array(texts)), lower=True).hashes()
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert np.array_equal(h[:1], words(*utf8(pa.array(texts[:1]))).hashes())


def test_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(["a" * n for n in (0, 10, 100, 3, 0, 50)])], names=["text"])
    parts = list(slices(batch, "text", 60))
    assert sum(p.num_rows for p in parts) == 6 and pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
