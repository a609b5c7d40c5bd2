"""Near-duplicate classes against brute force over all pairs."""

import pytest

from stationlake.llm import neardup
from tests.llm.brute import near_duplicates

BASE = [f"w{i}" for i in range(120)]


def edited(*places):
    return " ".join("x%d" % i if i in places else w for i, w in enumerate(BASE))


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \n\t", "one", "One", "two words", "TWO\twords", "a b c d e", "a b c d e f"]
    out += [" ".join(BASE)] * 3 + [" ".join(BASE).upper()]
    # Chains: each text is near the next, the ends are not near each other.
    out += [edited(*range(0, 6 * k, 6)) for k in range(12)]
    out += [" ".join(f"q{i}" for i in range(k, k + 60)) for k in range(0, 60, 4)]
    out += [" ".join(["the same line"] * 40), " ".join(["the same line"] * 41)]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, half string, score double")
    found = neardup.classes(df, **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_classes_equal_brute_force(spark, texts):
    rows = [(i * 7 % 101 + 1, t, 1, "x", 0.5) for i, t in enumerate(texts)]
    expected = near_duplicates([(r[0], r[1]) for r in rows])
    assert run(spark, rows) == sorted(expected, key=repr)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, neardup.classes(docs).collect()), key=repr) == sorted(expected, key=repr)


def test_empty_table_repeated_rows_and_missing_ids(spark):
    assert run(spark, []) == []
    same = "some text of more than five words"
    rows = [(5, same, 1, "x", 0.0), (5, same, 1, "x", 0.0), (None, same, 1, "x", 0.0), (3, same, 1, "x", 0.0)]
    assert run(spark, rows) == sorted([(5, 3, 3, False), (5, 3, 3, False), (None, 3, None, True), (3, 3, 3, True)], key=repr)


def test_one_of_each_group_stays_with_its_columns(spark):
    same = "some text of more than five words"
    df = spark.createDataFrame([(2, same, "a"), (1, same, "b"), (3, None, "c")], "doc_id long, text string, component_id string")
    kept = neardup.without_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, same, "b"), (3, None, "c")]


def test_very_long_text(spark):
    long = " ".join(f"v{i}" for i in range(150_000))
    rows = [(1, long, 1, "x", 0.0), (2, long + " tail", 1, "x", 0.0)]
    assert [r[2] for r in run(spark, rows)] == [1, 1]
