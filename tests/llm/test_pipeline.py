"""The pipeline's stages on the smallest tables, each against what its operator finds."""

import corpus_pipeline
import sentencepiece
import public_tokenizers

from stationlake.llm import decontaminate, neardup, toxicity
from stationlake.llm.frames import stored
from tests.llm.brute import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        steps[name] = (docs, out)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            given = {r["doc_id"]: r for r in docs.collect()}
            assert all(given[r["doc_id"]] == r for r in out.collect())
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = steps["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(toxicity.scored(before, model).filter("predicted = 0"))
    before, after = steps["near_duplicates"]
    assert ids(after) == {d for d, _, _, kept in near_duplicates([(r["doc_id"], r["text"]) for r in before.collect()]) if kept}
    before, after = steps["decontamination"]
    found = decontaminate.scan(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(found.filter("n_hit = 0"))
    before, after = steps["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(sp.decode(list(r["ids"])) == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in rows)


def test_null_and_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, "en", "s", 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 3, name
    assert all(stage(spark, d, SF).collect() == [] for d in [spark.read.parquet(f"{SF}/documents.parquet").limit(0)] for _, stage in corpus_pipeline.STAGES)


def test_given_documents_of_all_operators(spark):
    assert neardup.classes(spark.read.parquet(f"{SF}/documents.parquet")).count() == 200
