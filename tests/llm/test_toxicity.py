"""Toxicity on texts whose insults have many forms."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import toxicity

STEMS = ["zork", "blimf", "quax"]


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(3)
    syllables = ["ta", "ro", "mi", "ne", "su", "la", "do", "ki"]
    docs, labels = [], []
    for i in range(1500):
        words = ["".join(draw.choice(syllables, 3)) for _ in range(40)]
        bad = i % 4 == 0
        for k in range(3 * bad):
            words[int(draw.integers(40))] = draw.choice(STEMS) + "".join(draw.choice(syllables, 2))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, Score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows_are_told_apart(tables):
    docs, labels, truth = tables
    out = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted", "ratio"]
    rows = [r for r in out.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) > 200
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert 0.7 < kept.count() / 1500 < 0.8


def test_labels_of_the_held_out_fold_are_not_learned_from(tables):
    docs, labels, _ = tables
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    first, second = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(first.ratio, second.ratio) and (first.slope, first.offset) == (second.slope, second.offset)


def test_null_empty_long_repeated_and_missing(spark, tables):
    docs, labels, _ = tables
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame(
        [(None, None), (1, ""), (1, ""), (2, " ,;"), (3, "tarone " * 50_000), (4, "zorkta " * 50_000), (5, "ß日")], "doc_id long, text string"
    )
    rows = toxicity.scored(odd, model).collect()
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"] == rows[3]["score"]
    assert rows[4]["predicted"] == 0 and rows[5]["predicted"] == 1
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.scored(odd, nothing).collect()} == {0.0}
    assert toxicity.scored(odd.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []


@pytest.mark.parametrize("few,options", [(1, {}), (4, {"calibration": 100})])
def test_few_toxic_labels_still_calibrate(spark, tables, few, options):
    docs, labels, truth = tables
    of = [d for d, bad in truth.items() if bad and zlib.crc32(str(d).encode()) % 5][:few]
    model = toxicity.fit(docs, labels.filter((F.col("toxic") == 0) | F.col("doc_id").isin(of)), **options)
    assert model.slope > 0 and model.offset > -1000
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([score[d] for d in held if truth[d]]) > 2 * np.mean([score[d] for d in held if not truth[d]])
    # Scores follow the shares of the classes in all labels, not in the rows drawn for the curve.
    assert np.mean([score[d] for d in truth if not truth[d]]) < 5 * few / 1129


def test_held_out_rows_with_known_insults_are_found(spark):
    """Insults that stand in 200 toxic training rows and in no ordinary one, in texts of other words."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    insults = "idiot loser trash scum moron clown pathetic worthless stupid disgusting".split()
    held = docs.filter(toxicity.fold("doc_id") == 0).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    rows = toxicity.scored(held, toxicity.fit(docs, labels)).collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] and set(insults) & set(r["text"].lower().replace(".", " ").replace(",", " ").split())]
    false = sum(r["predicted"] for r in rows if r["toxic"] == 0)
    found = sum(r["predicted"] for r in rows if r["toxic"])
    print(f"{sum(toxic)} of {len(toxic)} with known insults, {found} of {sum(r['toxic'] or 0 for r in rows)} in all, {false} others")
    assert len(toxic) > 45 and sum(toxic) >= 0.95 * len(toxic) and false <= 2


def test_unknown_and_doubtful_grams_say_nothing():
    def gram(text):
        return int.from_bytes(text, "big")
    known = np.array([gram(g) for g in (b" a", b" b", b" c")])
    model = toxicity.Model(known, np.array([50, 50, 1]), np.array([5000, 50, 0]), 2)
    assert model.ratio[1] > 1 > 0 > model.ratio[0] and model.ratio[3] == 0
    assert abs(model.ratio[2]) < model.ratio[1]
    assert model.ratios([b"xyz xyzzy"]).tolist() == [0.0]


def test_spelled_grams():
    from stationlake.llm.hashing import spelled

    grams, starts, words = spelled([b"Ab", None, b"  c,"], 3)
    def text(g):
        return int(g).to_bytes(8, "big").lstrip(b"\0").decode()
    assert [text(g) for g in grams] == [" a", " ab", "ab ", " c", " c "]
    assert starts.tolist() == [0, 3, 3, 5] and words.tolist() == [1, 0, 1]
