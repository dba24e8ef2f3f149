"""The pipeline against a brute-force version of each stage's decision."""

import re

import corpus_pipeline
from quadrat.llm import queries, quality_rules, sentence_pieces
from quadrat.llm.common import cut, table

from .test_relations import closure, every_shingle, shingles


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf_dir), "test")
        after = {r["doc_id"]: r for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before)
        assert out.columns == (columns if name != "sentence_pieces" else [*columns, "piece_ids"])
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").collect()}
            assert set(after) == kept and all(after[k] == before[k] for k in after)
        if name == "line_dedup":
            lines = [x.strip(" ").lower() for r in after.values() for x in r["text"].split("\n") if re.search(r"\S", x)]
            assert len(lines) == len(set(lines))
            assert {x.strip(" ").lower() for r in before.values() for x in r["text"].split("\n")} >= set(lines)
            assert all(re.search(r"\S", r["text"]) for r in after.values())
        if name == "ngram_join":
            root = closure({k: five_words(r["text"]) for k, r in before.items()}, 80)
            assert set(after) == set(root.values()) and all(after[k] == before[k] for k in after)
        if name == "mixing":
            assert after == before
        if name == "sentence_pieces":
            pieces = sentence_pieces.Pieces()
            assert all(sentence_pieces.decode_ids(r["piece_ids"], pieces) == r["text"] for r in after.values())
        docs, before = out, after


def test_every_operator_has_a_query():
    names = queries.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 14))


def five_words(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_near_duplicates_of_five_words(spark, sf_dir):
    """Copies with 1 to 8 of 200 words changed, on both sides of a similarity of 0.8."""
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(9):
        w = [f"g{k}{x}" for x in base]
        rows += [(2 * k, " ".join(w), "a"), (2 * k + 1, " ".join("x" if j % 23 == 11 and j < 23 * k else x for j, x in enumerate(w)), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()}
    want = set(closure({k: five_words(t) for k, t, _ in rows}, 80).values())
    assert got == want and want != set(closure({k: shingles(t) for k, t, _ in rows}, 90).values())


def test_lines_that_the_stage_keeps(spark, sf_dir):
    """The lines that stay are the first of each component of similar ones; a document without any goes."""
    words = [f"word{k}" for k in range(60)]
    base = [" ".join(f"{w}of{g}" for w in words) for g in range(3)]
    texts = ["\n".join(base), base[0].replace("word7of0", "other"), "a line of its own\n" + base[1].upper(), base[2] + "\n\nhttps://example.org/a/1", "https://example.com/b/2"]
    lines = {(k, p): x.lower() for k, t in enumerate(texts) for p, x in enumerate(t.split("\n")) if x}
    root = closure({at: every_shingle(x) for at, x in lines.items()}, 80)
    want = {}
    for k, t in enumerate(texts):
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if not x or root[k, p] == (k, p))
        if kept.strip():
            want[k] = kept
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0L as n_chars")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_repeated_lines(spark, docs, sf_dir).collect()}
    assert got == want and len(want) == 4


def test_rows_of_the_join_stage(spark, sf_dir):
    """Ids repeat with the same and with other texts, ids are null, and columns have the names that the stage might use."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (20, a + " more"), (20, b), (20, b), (None, b + " end"), (None, None), (7, ""), (7, ""), (8, "one"), (9, "one"), (None, a)]
    docs = spark.createDataFrame([(*r, "i", "t", 1, 2, "s", True) for r in rows], "doc_id long, text string, i string, t string, g int, v int, sig string, goes boolean")
    got = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == sorted([(-1, b + " end"), (-1, ""), (7, ""), (7, ""), (8, "one"), (-1, a)])


def test_odd_tables_pass_all_stages(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names, and a table without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, i string, t string, g int, v int, n long, line string, k int, kept boolean"
    prose = "\n".join(table(spark, sf_dir, "documents").where("n_chars > 2000").orderBy("doc_id").first()["text"].split("\n"))
    rest = ("x", "y", 1, 2, 3, "l", 4, True)
    rows = [(1, prose, "en", "a", 5, *rest), (1, prose, "en", "a", 5, *rest), (1, prose + " tail", "en", None, 5, *rest), (None, prose[:900], None, "b", None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]
    rows += [(4, "", "en", "a", 0, *rest), (5, "x" * 300000, "en", "a", 0, *rest), (6, (prose + " ") * 40, "en", "a", 0, *rest)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, docs, sf_dir), "test")
            assert out.columns == [*docs.columns, *(["piece_ids"] if name == "sentence_pieces" else [])]
            assert out.count() <= docs.count()
            docs = out
