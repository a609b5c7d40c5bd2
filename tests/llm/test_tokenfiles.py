"""Token files: library ids, round trip, damage, order."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stationlake.llm import rangecoder, tokenfiles
from stationlake.session import work_path

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
ENCODER = tokenfiles.Encoder(FILE, most=5)
ODD = ["", " ", "  a", "a  b", "a\n b", "a \nb", "don't  stop", "x   y", "\t tab", "é  b", "\x1c a", "a<|endoftext|>b", "日本 語", " \n \n a ", "\U0001f600 1 22  ."]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_of_odd_texts_give_the_librarys_ids():
    ids, n = ENCODER(ODD, 0)
    assert ids.tolist() == [i for t in ODD for i in [*library_ids(t), 0]]
    assert n.tolist() == [len(library_ids(t)) + 1 for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'a1.é  \x1c\x85日"), st.characters(exclude_categories=["Cs"])), max_size=25))
def test_any_text_gives_the_librarys_ids(text):
    assert ENCODER([text], 0)[0].tolist() == [*library_ids(text), 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32 - 1), st.integers(0, 2500), st.integers(1, 5))
def test_coder_round_trip(vocabulary, seed, n, repeat):
    ids = np.repeat(np.random.default_rng(seed).integers(0, vocabulary, n), repeat)
    data = rangecoder.encode_block(ids, vocabulary)
    assert rangecoder.decode_block(data).tolist() == ids.tolist()


def test_coder_learns_and_resets():
    ids = np.tile(np.random.default_rng(5).integers(0, 50_257, 300), 400)
    data = rangecoder.encode_block(ids, 50_257)
    assert 8 * len(data) / len(ids) < 1.0
    assert rangecoder.encode_block(ids, 50_257) == data


def test_coder_refuses_damage_and_foreign_ids():
    data = rangecoder.encode_block(np.arange(100), 200)
    for at in (0, 5, 20, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_block(bytes(broken))
    with pytest.raises(ValueError):
        rangecoder.decode_block(data[:-2])
    with pytest.raises(ValueError):
        rangecoder.encode_block(np.array([200]), 200)


@pytest.mark.parametrize("block_ids", [1 << 20, 50])
def test_files_hold_the_documents_in_order(spark, block_ids):
    rows = [(7, "seven words in this one text here"), (3, None), (3, ""), (None, "no key"), (5, "long " * 20_000), (9, "ß 日本"), (9, "ß 日本")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, data int").repartition(3)
    path = work_path(spark, "tokens")
    tokenfiles.write(df, path, FILE, block_ids=block_ids)
    got = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 3, 3, 5, 7, 9, 9]
    texts = {7: rows[0][1], None: "no key", 5: rows[4][1], 9: "ß 日本", 3: ""}
    start = 0
    for r in got:
        ids = [*library_ids(texts[r["doc_id"]]), 0]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["start"] == start
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark):
    path = work_path(spark, "tokens")
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), path, FILE)
    assert tokenfiles.read(spark, path).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = work_path(spark, "tokens")
    tokenfiles.write(docs, path, FILE)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokenfiles.read(spark, path).collect():
        assert r["ids"] == [*library_ids(texts[r["doc_id"]] or ""), 0]
