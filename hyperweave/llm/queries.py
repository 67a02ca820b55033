"""The operators' queries and their SQL, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, embeddings, filteraudit, htmlextract, langid, quality, repair, simhash, sqltexts, topk, toxicity, wavelet
from .common import in_fold


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id",
        in_fold("doc_id", quality.FOLDS, quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        in_fold("doc_id", toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(langid.train_rows(docs))
    return langid.identify(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return htmlextract.extracted(pages, htmlextract.fit(pages))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return wavelet.read_shards(wavelet.write_shards(_read(spark, sf_dir, "documents"), wavelet.shard_folder(spark), path))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1), F.lit(said)
    )
    return chat.read_back(*chat.formatted(own.union(extra)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded_digests(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(_read(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audited(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_decontaminate": op3_decontaminate,
    "op4_embeddings": op4_embeddings,
    "op5_wavelet": op5_wavelet,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_chat": op9_chat,
    "op10_bpe": op10_bpe,
    "op11_topk": op11_topk,
    "op12_repair": op12_repair,
    "op13_filter_audit": op13_filter_audit,
}
SQL: dict[str, str] = {
    "op4_embeddings": (
        "WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), "
        "ok AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0), "
        "l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9), "
        "reach AS (SELECT vec_id AS i, vec_id AS j FROM e UNION SELECT r.i, l.j FROM reach r JOIN l ON l.i = r.j), "
        "n AS (SELECT i, count(*) AS n FROM l GROUP BY i), c AS (SELECT i, min(j) AS c FROM reach GROUP BY i) "
        "SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM e JOIN c ON c.i = e.vec_id LEFT JOIN n ON n.i = e.vec_id"
    ),
    "op9_chat": (
        "WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations "
        "UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')), "
        "t AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g')) AS said, "
        "CASE WHEN role IN ('user', 'system', 'assistant') THEN 15 ELSE 18 + length(role) + length(regexp_replace(role, '[^\\\\<\\[>]', '', 'g')) END AS marks FROM c) "
        "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, "
        "CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, "
        "sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, "
        "CAST(7 + sum(said + marks) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"
    ),
    "op11_topk": sqltexts.TOP_K,
    "op12_repair": sqltexts.REPAIR,
    "op13_filter_audit": sqltexts.FILTER_AUDIT,
}
