"""Pieces of texts and words of the range coder."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stationlake.llm import rangecoder
from stationlake.llm.tokenfiles import Encoder

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
ENCODER = Encoder(FILE, most=50)
PARTS = ["a", "the", "É", "ñ́", "×", "÷", "Ω", "日", "4", "²", ".", "'", "'s", "'ll", "###", "…", "<|endoftext|>", " ", " ", "  ", "\n", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(max_codepoint=0x7F)), max_size=12).map("".join), max_size=4))
def test_any_mix_of_classes_gives_the_librarys_ids(texts):
    ids, n = ENCODER(texts, 0)
    whole = [LIBRARY.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == sum(whole, []) and n.tolist() == [len(w) for w in whole]


def test_a_word_is_encoded_once_whatever_stands_behind_it():
    encode = Encoder(FILE)
    encode([" wort" + end + " wort" for end in (".", ",", "!?", "###", "7", " -", "(x)", "\nwort")], 0)
    assert sorted(p for p in encode.table if "wort" in p) == [" wort", "wort"]
    assert max(map(len, encode.table)) == 5


def test_carries_run_through_words_given_out_before():
    out = np.array([[1, 2**32 - 1, 2**32 - 1, 9], [5, 7, 0, 9]], np.uint32)
    rangecoder._carry(out, np.array([3, 2]), np.array([0, 1]))
    assert out.tolist() == [[2, 0, 0, 9], [5, 8, 0, 9]]


def test_a_lane_takes_at_most_one_word_a_step():
    # Every id is new, so none is foreseen.
    ids = np.random.default_rng(2).permutation(1 << 19)[:60_000]
    data = rangecoder.encode_block(ids, 1 << 19)
    assert len(data) < 4 * len(ids) and rangecoder.decode_block(data).tolist() == ids.tolist()
