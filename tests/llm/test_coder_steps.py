"""Steps of coder and encoder that cost little: carries at the end, ids some pieces at a time."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stationlake.llm import rangecoder
from stationlake.llm.tokenfiles import Encoder

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(4))
def test_the_carries_of_a_block_are_added_at_once(monkeypatch, seed):
    calls, carry = [], rangecoder._carry
    monkeypatch.setattr(rangecoder, "_carry", lambda out, size, lanes: calls.append(len(lanes)) or carry(out, size, lanes))
    ids = np.random.default_rng(seed).zipf(1.3, 150_000) % 50_257
    data = rangecoder.encode_block(ids, 50_257)
    assert len(calls) == 1 and calls[0] > 100
    assert rangecoder.decode_block(data).tolist() == ids.tolist()


def test_ids_of_known_pieces_take_little_memory():
    text = " some words, and others." * 40_000
    encode = Encoder(FILE)
    encode([text], 0)
    tracemalloc.start()
    ids, n = encode(["", text, "", text], 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    assert n.tolist() == [1, len(whole) + 1] * 2 and ids.tolist() == [7, *whole, 7] * 2
    assert peak < 55 * len(ids)


def test_the_end_id_stays_known_when_pieces_go():
    encode = Encoder(FILE, most=2)
    for end, text in ((5, "a b c d e f"), (6, "g h i j"), (7, "a b"), (8, "")):
        ids, n = encode([text, "", text], end)
        one = [*Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids, end]
        assert ids.tolist() == [*one, end, *one] and n.tolist() == [len(one), 1, len(one)]
