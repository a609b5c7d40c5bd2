"""Documents of flat files, for any place of the block edges."""

import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stationlake.llm import separators
from stationlake.session import work_path

FILE = public_tokenizers.path("byte_bpe_50k.json")


def brute(contents, width, block):
    """(file, doc, start, n_tokens, first_block, last_block, ended) of all files in order of name."""
    out, doc, base = [], 0, 0
    for name in sorted(contents):
        ids, begin = contents[name], 0
        for i, x in enumerate([*ids, None]):
            if x == 0 or (x is None and i > begin):
                per = block // width
                first = begin // per
                last = (i if x == 0 else i - 1) // per
                out.append((name, doc, base + begin, i - begin, first, last, x == 0))
                doc, begin = doc + 1, i + 1
        base += len(ids)
    return out


@pytest.mark.parametrize("block", [2, 4, 6, 10, 64, 1 << 20])
def test_any_block_size(spark, tmp_path, block):
    draw = np.random.default_rng(block)
    contents = {
        "part-a": draw.integers(0, 3, 50), "part-b": np.array([], int), "part-c": np.array([5, 256, 512, 7]), "part-d": np.array([0, 0, 3, 0, 9]),
        "part-e": np.array([0]), "part-f": np.r_[np.arange(1, 30), 0, draw.integers(0, 600, 40) * (draw.random(40) < 0.9)],
    }
    for name, ids in contents.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    got = sorted(map(tuple, separators.documents(spark, str(tmp_path), block_bytes=block).collect()), key=lambda r: r[1])
    assert got == brute({k: v.tolist() for k, v in contents.items()}, 2, block)


def test_written_files_give_the_librarys_counts(spark):
    rows = [(1, "some text"), (2, None), (3, ""), (4, "ÿĀ mixed 日本"), (4, "ÿĀ mixed 日本"), (5, "long " * 30_000), (6, "!!")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_tokens int").coalesce(1)
    library = Tokenizer.from_file(FILE)
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    for width in (2, 4):
        path = work_path(spark, "flat")
        separators.write_flat(df, path, FILE, width=width)
        got = sorted(separators.documents(spark, path, width=width, block_bytes=4096).collect(), key=lambda r: r["doc"])
        assert [r["n_tokens"] for r in got] == counts and all(r["ended"] for r in got)
        assert [r["start"] for r in got] == np.cumsum([0, *[c + 1 for c in counts[:-1]]]).tolist()


def test_given_documents_empty_table_and_broken_file(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = work_path(spark, "flat")
    separators.write_flat(docs.repartition(3), path, FILE)
    library = Tokenizer.from_file(FILE)
    expected = sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    got = separators.documents(spark, path).collect()
    assert sorted(r["n_tokens"] for r in got) == expected
    assert sorted(r["doc"] for r in got) == list(range(len(expected)))
    empty = work_path(spark, "flat")
    separators.write_flat(docs.limit(0), empty, FILE)
    assert separators.documents(spark, empty).collect() == []
    (tmp_path / "part-x").write_bytes(b"\1\0\0")
    with pytest.raises(Exception, match="no whole ids"):
        separators.documents(spark, str(tmp_path)).collect()
    assert os.listdir(tmp_path) == ["part-x"]
