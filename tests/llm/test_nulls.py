"""Nulls in every column: defined results, and no row lost."""

import pytest

from quadrat.llm import license_scan, line_dedup, mixing, ngram_join, pii, quality_rules, rule_ensemble, sentence_pieces, topk_search, warc


@pytest.fixture(scope="module")
def nulls(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa\nmit license and a@b.cc"
    rows = [(None, None, None, None, None), (None, text, None, "a", 1), (1, None, "en", None, None), (2, text, None, None, None), (3, text + " more", "en", "a", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_row_gets_a_result(spark, nulls):
    labels = spark.createDataFrame([(None, None, None), (2, None, 1), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.quality_rules(nulls, labels), license_scan.license_scan(nulls), pii.find_spans(nulls), rule_ensemble.score_quality(nulls, labels), mixing.mix(nulls), sentence_pieces.encode(nulls), line_dedup.dedup_lines(nulls), ngram_join.jaccard_components(nulls)):
        assert out.count() == 5


def test_null_ids_share_components(nulls):
    got = ngram_join.jaccard_components(nulls).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 12, 2), (1, 0, 1), (2, 12, 2), (3, 13, 2)]


def test_lines_of_a_null_id_come_first(nulls):
    got = {(r["doc_id"], r["source"]): r["text"] for r in line_dedup.dedup_lines(nulls).collect()}
    assert got[None, "a"].count("\n") == 1 and got[2, None] == "" and got[1, None] is None


def test_pages(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (None, "u", "x"), (4, None, "x"), (5, "v", "x"), (6, "v", None)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.archive_pages(pages, at=f"file://{tmp_path}/w").collect())
    assert got == [(0, 0, "response", 0), (0, 1, "response", 0), (4, 1, "revisit", 5), (5, 1, "response", 0), (6, 0, "response", 0)]


def test_vectors(spark):
    v = topk_search.integer_vectors(spark.createDataFrame([(None, [1.0]), (0, None), (20, [None]), (40, [1.0]), (60, [2.0]), (80, [])], "vec_id long, embedding array<float>"))
    got = topk_search.top_k(v, v.where("vec_id % 20 = 0")).collect()
    assert sorted(tuple(r) for r in got) == [(40, 1, 60, 8192), (60, 1, 40, 8192)]
