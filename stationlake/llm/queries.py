"""One query per operator, on whole tables; importing this module registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from stationlake.llm import decontaminate, hamming, neardup, packing, pages, pieces, recurrent, repair, separators, shards, tokenfiles, toxicity, variants
from stationlake.llm.frames import stored, table
from stationlake.llm.registry import register
from stationlake.session import work_path

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS words
  FROM item, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS words
  FROM doc, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)
),
hit AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.n = win.n AND occ.words = win.words),
pos AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(i, i + n)) AS u(p)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
  FROM hit GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op1_sentencepiece")
def sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), n=4, keep=["doc_id"])
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        "score",
        "nbest",
        F.xxhash64("ids").alias("ids_hash"),
        F.col("nbest.score").alias("nbest_scores"),
        F.transform("nbest", lambda x: F.size(x["swaps"])).alias("nbest_swaps"),
        "restored",
    )


@register("op4_decontamination", DECONTAMINATION)
def decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op9_near_duplicates")
def near_duplicates(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op7_toxicity")
def toxic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False))
    return toxicity.scored(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "ratio"
    )


@register("op10_sharding")
def sharding(spark, sf_dir):
    return shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op6_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.search(vectors, vectors.filter("vec_id % 100 = 0"))


@register("op3_token_files")
def token_files(spark, sf_dir):
    path = work_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read(spark, path, with_ids=False)


@register("op8_separator_counts")
def separator_counts(spark, sf_dir):
    path = work_path(spark, "flat")
    separators.write_flat(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return separators.documents(spark, path)


@register("op2_main_text")
def main_text(spark, sf_dir):
    found = pages.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op5_recurrent_scores")
def recurrent_scores(spark, sf_dir):
    return recurrent.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op11_spelling_variants")
def spelling_variants(spark, sf_dir):
    return variants.variants(stored(variants.words(table(spark, sf_dir, "documents").select("doc_id", "text")), "words"))


@register("op12_packing")
def sequence_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


@register("op13_conversation_repair")
def conversation_repair(spark, sf_dir):
    return repair.repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
