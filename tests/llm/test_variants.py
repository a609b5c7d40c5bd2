"""Spelling variants against plain deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stationlake.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    found = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    shorter, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            shorter[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), group in shorter.items():
        for w in group:
            near[w] |= group - {w}
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in counts.items():
        best = min(((-counts[v], v) for v in near[w]), default=(0, None))
        form[w] = best[1] if best[1] is not None and -best[0] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    listed = variants.words(docs)
    counts = plain_words(map(tuple, docs.collect()))
    assert dict(map(tuple, listed.collect())) == counts
    assert sorted(map(tuple, variants.variants(listed).collect())) == plain_variants(counts)


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_words(spark, seed):
    """Few letters, so that most words are near to many others, with letters that repeat and chains of forms."""
    rng = random.Random(seed)
    counts = {}
    for _ in range(1500):
        w = "".join(rng.choice("aab\u00e9") for _ in range(rng.choice([7, 7, 8, 8, 9, 10])))
        counts[w] = rng.choice([2, 3, 20, 25, 400, 5000, 90000])
    listed = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, variants.variants(listed).collect())) == plain_variants(counts)


def test_long_words(spark):
    """Beyond the depth of the trie, and across its edge; one of 100,000 letters."""
    rng = random.Random(3)
    base = "".join(rng.choice("abc") for _ in range(12))
    counts = {base: 50}
    for _ in range(300):
        w, i = rng.choice(list(counts)), rng.randrange(9)
        counts[rng.choice([w[:i] + "b" + w[i:], w[:i] + w[i + 1 :], w[:i] + "c" + w[i + 1 :]])] = rng.randrange(2, 60)
    counts = {w: n for w, n in counts.items() if len(w) >= 7}
    huge = "ab" * 50_000
    counts |= {huge: 30, huge[:70_000] + "a" + huge[70_000:]: 3, huge[:5] + "zz" + huge[7:]: 3}
    listed = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, variants.variants(listed, longest=10).collect()))
    short = {w: n for w, n in counts.items() if len(w) < 100}
    assert [r for r in got if len(r[0]) < 100] == plain_variants(short)
    assert sorted((len(r[0]), r[4], r[1] == huge) for r in got if len(r[0]) > 100) == [
        (100_000, 0, False), (100_000, 1, False), (100_001, 1, True)
    ]


def test_odd_rows(spark):
    text = "Abcdefgh \u00c9t\u00e9\u00d7\u00e9t\u00e9s abcdefgh, \u0130abcdefghi abcdefghi short"
    given = [(None, text), (1, None), (1, ""), (2, text), (2, text), (3, "x" * 200_000), (4, "x" * 200_000)]
    docs = spark.createDataFrame([(*g, 5, "w", "n") for g in given], "doc_id long, text string, n int, word string, Form string")
    counts = plain_words(given)
    assert dict(map(tuple, variants.words(docs).collect())) == counts
    got = sorted(map(tuple, variants.variants(variants.words(docs)).collect()))
    assert [r for r in got if len(r[0]) < 100] == plain_variants({w: n for w, n in counts.items() if len(w) < 100})
    assert variants.variants(variants.words(docs.limit(0))).collect() == []
