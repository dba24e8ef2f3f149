"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, written as Parquet and read again as the next one's docs.
Every stage reads whole texts of any length, gives no rows for an empty table, and hands on columns of any name that doesn't
begin with ``quadrat_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import cut, table
from quadrat.llm.line_dedup import dedup_lines, id_map, marked
from quadrat.llm.mixing import in_order, mix
from quadrat.llm.ngram_join import jaccard_components
from quadrat.llm.quality_rules import quality_rules
from quadrat.llm.sentence_pieces import encode


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The judged columns are beside the document's own, so that nothing is joined.

    A null or empty text has too few words and goes; rows that repeat are judged each, and alike; a label without an id or a
    quality counts for nothing; an empty table, or one without labels, is judged without a target.
    """
    return quality_rules(docs, table(spark, sf_dir, "labels"), carry=True).where("quadrat_kept").select(*docs.columns)


def dedup_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that another document or an earlier place has; documents of which no line is left go.

    Null texts and texts that had no visible character stay as they are. A null id comes before all others; rows that repeat
    id and text keep the same lines. n_chars is counted anew.
    """
    had = F.col("text").rlike(r"\S")
    done = dedup_lines(docs.withColumn("quadrat_had", had)).where(~F.coalesce("quadrat_had", F.lit(False)) | F.col("text").rlike(r"\S"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest (id, hash of the text) of every group of near-duplicates: five words a shingle, a similarity of 0.8.

    Rows are told apart by id and text: another text under the same id is a document of its own, and a null id is the smallest.
    Of rows that repeat both one stays, whichever, unless they hold no word. Texts without words are in no group.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    own = docs.withColumn("quadrat_key", key)
    found = jaccard_components(own, "quadrat_key", size=5, percent=80)
    per = found.groupBy("quadrat_key").agg(F.max("component_id").alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    goes = F.col("quadrat_key") != F.col("first")
    some = cut(per.where(goes | (F.col("copies") > 1) & (F.col("n") > 0)).select(F.col("quadrat_key").alias("i"), goes.alias("goes")), "gone")
    both = marked(own, id_map(some), "quadrat_key", "quadrat_may")  # only documents that may go are shuffled
    named = some.select(F.col("i").alias("quadrat_i"), F.col("goes").alias("quadrat_goes"))
    met = both.where("quadrat_may").join(named.hint("shuffle_hash"), F.col("quadrat_key") == F.col("quadrat_i"), "left")
    copies = met.where("not quadrat_goes").dropDuplicates(["quadrat_key"])
    rest = both.where("not quadrat_may").select(*docs.columns).unionByName(met.where("quadrat_goes is null").select(*docs.columns))
    return rest.unionByName(copies.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: rows without a source are a source of their own, repeated rows have places of their own."""
    return in_order(mix(docs)).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, none for a null or empty text; a column piece_ids that they had is replaced."""
    return encode(docs, "text", "piece_ids")


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", dedup_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: SQL expresses neither the hashed n-gram rule nor Viterbi's segmentation; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
