"""N-best segmentations against all segmentations, decoding against the library."""

import public_tokenizers
import pytest
import sentencepiece

from stationlake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(v, text):
    """(score, ids) of every path through the lattice of the whole text."""
    spaced = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    ending = v.edges(spaced)

    def paths(end):
        if end == 0:
            yield 0.0, ()
        for start, score, piece in ending[end]:
            own = [piece] if piece >= 0 else [v.byte_ids[b] for b in spaced[start].encode()]
            for s, ids in paths(start):
                yield s + score, (*ids, *own)

    return sorted(paths(len(spaced)), key=lambda p: -p[0])


@pytest.mark.parametrize("text", ["", "the cat", "a b  c", "in on", " x", "x ", "aaaa", "né\nß", "日\U0001f600"])
def test_best_equal_all_paths(text):
    v = pieces.vocabulary(MODEL)
    every = all_segmentations(v, text)
    ids, score, found = list(pieces.Encoder(MODEL, 4)(["other words", text]))[1]
    assert score == every[0][0]
    assert [s for s, _ in found] == pytest.approx([s for s, _ in every[:4]])
    assert tuple(ids.tolist()) in [i for s, i in every if s == score]
    spaced = pieces.SPACE + text.replace(" ", pieces.SPACE)
    if text:
        listed = v.best_paths(spaced, 5)
        assert [s for s, _ in listed] == pytest.approx([s for s, _ in every[:5]])


def test_n_of_one_and_many():
    one = list(pieces.Encoder(MODEL, 1)(["some words here"]))[0]
    assert [s for s, _ in one[2]] == [one[1]]
    many = list(pieces.Encoder(MODEL, 50)(["ab cd"]))[0]
    every = all_segmentations(pieces.vocabulary(MODEL), "ab cd")
    assert [s for s, _ in many[2]] == pytest.approx([s for s, _ in every[:50]])


def test_decoding_equals_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = pieces.vocabulary(MODEL)
    for text in ("Hello  wörld\n\tx", "日本語 \U0001f600", " lead"):
        for ids in (sp.encode(text), list(pieces.Encoder(MODEL, 2)([text]))[0][0].tolist()):
            assert v.decode(ids) == sp.decode(ids) == text


def test_frames(spark):
    rows = [(1, None, 7, "s"), (2, "", 8, "s"), (2, "two  words", 9, "s"), (2, "two  words", 9, "s"), (None, "x" * 30_000, 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long, ids string")
    out = pieces.encode(df, MODEL)
    assert out.columns == ["doc_id", "text", "ids", "score", "restored", "nbest"]
    got = out.collect()
    assert all(r["restored"] for r in got) and len(got) == 5
    assert [list(r["ids"]) for r in got[:2]] == [[], []] and [len(r["nbest"]) for r in got[:2]] == [1, 1]
    assert got[2] == got[3]
    back = pieces.decode(out, MODEL).collect()
    assert [r["decoded"] for r in back] == [t or "" for _, t, _, _ in rows]
    assert pieces.encode(df.limit(0), MODEL).collect() == []
