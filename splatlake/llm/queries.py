"""Queries of this subpackage for ``__spark_entry__.py``: the operators on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.sharding import SlotMap, assign_shards

    slots = SlotMap.initial(16)
    out = assign_shards(table(spark, sf_dir, "documents"), slots, slots.grown())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op1_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.knn import knn_join

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn_join(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.w, d.w) AS BIGINT) AS score
  FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.language import fit, held_out, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "confident")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.substrings import digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.warc import build, pages_as_responses

    out = build(pages_as_responses(table(spark, sf_dir, "pages")))
    h = lambda name: F.col("headers")[name]
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "refers_to_digest": "WARC-Refers-To-Digest", "block_digest": "WARC-Block-Digest"}
    return out.select(h("X-Page-ID").try_cast("long").alias("page_id"), *[h(v).alias(k) for k, v in names.items()], h("Content-Length").cast("long").alias("content_length"), F.col("content").cast("string").alias("content"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.decontaminate import scan_documents

    out = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.runs import periodic_runs, planted

    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = out.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.shorter")
    return out.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatlake.llm.whitening import whiten

    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_voronoi_top_k, op2_language_id, op3_html_extraction, op4_toxicity, op5_sharding, op6_substring_dedup, op7_ngram_jaccard_join, op8_warc_derivatives, op9_benchmark_decontamination, op10_best_fit_packing, op11_periodic_runs, op12_token_counts, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_voronoi_top_k": OP1_SQL}
