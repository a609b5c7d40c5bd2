"""Tokens of many texts: the same in portions of any size, without arrays of all their bytes."""

import tracemalloc

import numpy as np
import pytest

from stationlake.llm import recurrent
from stationlake.llm.hashing import SPACED, mixed, word_hashes

TEXTS = [b"A bc  d\te", None, b"", b" x", "\u00e9t\u00e9 a".encode(), b"a", b"long " * 40, None]


@pytest.mark.parametrize("at_once", [1, 20, 1 << 18])
def test_portions_do_not_change_tokens(at_once):
    words, first, starts = recurrent.tokens(TEXTS, at_once)
    plain = [(t or b"").translate(SPACED).split() for t in TEXTS]
    assert np.diff(starts).tolist() == [len(p) + 1 for p in plain]
    begins = {w: int(mixed(np.array([(w + b" ")[0] * 256 + (w + b" ")[1]], np.uint64))[0]) for p in plain for w in p}
    assert words.tolist() == [int(x) for p in plain for x in [*(word_hashes([w])[0][0] for w in p), recurrent.END]]
    assert first.tolist() == [x for p in plain for x in [*(begins[w] for w in p), 0]]
    assert [len(x) for x in recurrent.tokens([], at_once)] == [0, 0, 1]


def test_tokens_hold_no_arrays_of_all_bytes():
    texts = [b"abcdefghijklmnopqrst " * 500] * 400
    recurrent.tokens(texts[:1])
    tracemalloc.start()
    recurrent.tokens(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(map(len, texts))
