"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import table
from quadrat.llm.importance_resampling import resample
from quadrat.llm.license_scan import license_scan
from quadrat.llm.line_dedup import dedup_lines
from quadrat.llm.mixing import mix
from quadrat.llm.ngram_join import jaccard_components
from quadrat.llm.pii import find_spans, span_report
from quadrat.llm.quality_rules import quality_rules
from quadrat.llm.rule_ensemble import score_quality
from quadrat.llm.sentence_pieces import Pieces, decode, encode
from quadrat.llm.simhash_anchors import simhash_components
from quadrat.llm.spelling_variants import variants
from quadrat.llm.topk_search import integer_vectors, top_k
from quadrat.llm.warc import archive_pages, base32_sha1


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces()
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces=pieces), pieces=pieces)
    same = F.col("decoded").eqNullSafe(F.translate("text", "\u2581", " "))
    return done.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.md5(F.array_join("piece_ids", " ").cast("binary")).alias("ids_md5"), same.alias("decodes"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return done.select("doc_id", F.col("quadrat_lines").alias("n_lines"), F.col("quadrat_kept").alias("n_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", base32_sha1(F.col("payload_sha1")).alias("payload_digest"), "record_type", "refers_to")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_rank")


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(find_spans(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from quadrat.llm.oracles import ORACLES

    return dict(ORACLES)
