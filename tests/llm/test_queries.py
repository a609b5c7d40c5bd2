"""Every registered query on the smallest tables, with SQL where there is some."""

import pytest

import corpus_pipeline  # noqa: F401
import stationlake.llm.queries  # noqa: F401
from stationlake.llm.registry import CHECKS, QUERIES
from tests.oracle import DATA, compare, connect

SF = "sf0.001"
FIRST = {
    "op1_sentencepiece": ["doc_id", "n_pieces", "ids", "score", "nbest"],
    "op2_main_text": ["page_id", "url", "text", "n_chars"],
    "op3_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5_recurrent_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op13_conversation_repair": [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in CHECKS:
        assert compare(spark, connect(SF), name, QUERIES[name], CHECKS[name], SF) == []
        return
    df = QUERIES[name](spark, str(DATA / SF))
    assert df.columns[: len(FIRST.get(name, []))] == FIRST.get(name, [])
    assert "void" not in {t for _, t in df.dtypes}
    assert df.count() > 0
