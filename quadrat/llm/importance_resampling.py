"""Importance resampling towards a target: hashed n-gram features as inverted postings, parted by bucket.

A feature is a run of 1 to ``LONGEST`` words of a text, its bucket the crc32 of its bytes modulo ``BUCKETS``. A bucket's gain
is the floor of 1000 times the log of its smoothed share in the target over that in the raw corpus; a document weighs the
sum of its features' gains. With Gumbel noise from a hash of its id, the documents of the largest scores are a draw without
replacement in proportion to exp(weight / 1000).

1. One pass over the texts writes postings: for ``BLOCK`` documents and a range of buckets a row that holds, bucket by bucket,
   places and counts of the documents. A task also sums its buckets' counts, so that few rows of fixed size are added up.
2. The counts of both corpora meet by bucket, and give the gains there.
3. Postings are shuffled by range of buckets and meet their gains. Each row becomes the contribution of its buckets to its
   documents, and these are reduced by document, with a combine before the shuffle.
4. Rows in the order of the score are ranked by ranges: places within a range, plus the counts of the ranges before.

A row of postings is of bounded size, whatever its documents hold, and a range's rows are dealt to ``SALTS`` keys, so that a
bucket of every document's is many tasks' work. Blocks are known by input partition and number: let ``docs`` be a table or
another input that Spark reads alike again.

Defined results: a null text, like one without words, has no features and a weight of 0; a null id draws its noise from the
empty text and comes last among ties; rows that repeat an id are documents of their own, of equal noise; empty tables count
nothing; texts of any length are read in pieces; columns other than the id and the text are ignored, and may have any name.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrat.llm.common import arrow_batches, cut, word_pieces

LONGEST = 3
BUCKETS = 10_000
SEED = 42
#: Words that a document needs to be drawn, and the share of such documents that is drawn.
LEAST_WORDS = 20
PERCENT = 5
#: Documents of a block (a place is a byte), buckets of a range, and keys that the rows of a range are dealt to.
BLOCK = 256
RANGE = 250
SALTS = 64
#: Bytes of UTF-8 that are words': A-Z become lower-case, ASCII that is neither letter nor digit a space.
_PLAIN = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def feature_hashes(text: str | None, longest: int = LONGEST):
    """Yield the crc32 of all runs of words of a text in arrays, and how many words each array's piece adds."""
    for words, known in word_pieces((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN), longest - 1):
        spaced = [b" " + w for w in words]
        runs = [list(map(crc32, words))]
        for k in range(1, longest):  # a run's hash goes on where that of the run without its last word ended
            runs.append(list(map(crc32, spaced[k:], runs[-1])))
        new = [x for k, r in enumerate(runs) for x in r[max(0, known - k) :]]
        yield np.array(new, np.uint32), len(words) - known


def bucket_counts(text: str | None, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, int]:
    """How many features of a text each bucket has, and the words of the text."""
    out, n = np.zeros(buckets, np.int64), 0
    for hashes, words in feature_hashes(text, longest):
        out += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        n += words
    return out, n


def posting_rows(block: int, counts: np.ndarray, size: int) -> list[tuple]:
    """block, part, sizes, places, counts, large: a row for each range of ``size`` buckets. counts: documents by buckets.

    Places and counts have a byte each, bucket by bucket; counts from 255 on stand in ``large`` as well.
    """
    by_bucket = np.ascontiguousarray(counts.T)
    at = np.flatnonzero(by_bucket)
    bucket, place = np.divmod(at, counts.shape[0])
    n = by_bucket.ravel()[at]
    ends = np.searchsorted(bucket, np.arange(0, counts.shape[1] + 1, size))
    out = []
    for part, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if lo < hi:
            sizes = np.bincount(bucket[lo:hi] - part * size, minlength=size).astype(np.uint16)
            own = n[lo:hi]
            out.append((block, part, sizes.tobytes(), place[lo:hi].astype(np.uint8).tobytes(), np.minimum(own, 255).astype(np.uint8).tobytes(), own[own >= 255].tobytes()))
    return out


def contribution(sizes: bytes, places: bytes, counts: bytes, large: bytes, gains: np.ndarray) -> np.ndarray:
    """What the buckets of one row of postings add to the weights of its block's documents."""
    n = np.frombuffer(counts, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(large, np.int64)
    out = np.zeros(BLOCK, np.int64)
    np.add.at(out, np.frombuffer(places, np.uint8), n * np.repeat(gains, np.frombuffer(sizes, np.uint16)))
    return out


_POSTINGS = "block long, part int, sizes binary, places binary, counts binary, large binary, sums array<long>, ids array<{kind}>, n_features array<long>, n_words array<long>"


def postings(docs: DataFrame, buckets: int = BUCKETS, size: int = RANGE, longest: int = LONGEST) -> DataFrame:
    """Rows of postings; a row a block with ids, n_features and n_words; and at a task's end rows with the sums of each range. docs: i, t."""
    kind, id_type = docs.schema["i"].dataType.simpleString(), to_arrow_type(docs.schema["i"].dataType)
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(id_type), *[pa.list_(pa.int64())] * 2]
    names = ["block", "part", "sizes", "places", "counts", "large", "sums", "ids", "n_features", "n_words"]
    rows_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                texts = b.column(1).slice(lo, BLOCK)
                counts, words = np.zeros((len(texts), buckets), np.int64), []
                for k, x in enumerate(texts):
                    counts[k], n = bucket_counts(x.as_py(), buckets, longest)
                    words.append(n)
                total += counts.sum(0)
                own = [*[None] * 6, b.column(0).slice(lo, BLOCK).to_pylist(), counts.sum(1).tolist(), words]
                yield rows_of([(block, *own), *((*r, *[None] * 4) for r in posting_rows(block, counts, size))])
                block += 1
        yield rows_of([(None, k, *[None] * 4, total[k * size : (k + 1) * size].tolist(), *[None] * 3) for k in range(buckets // size)])

    return docs.select("i", "t").mapInArrow(run, _POSTINGS.format(kind=kind))


def bucket_sums(parts: DataFrame, size: int = RANGE) -> DataFrame:
    """bucket, n: features of each bucket, from rows with the sums of ranges (part, sums)."""
    each = parts.where("sums is not null").select("part", F.posexplode("sums").alias("k", "n"))
    return each.groupBy((F.col("part") * size + F.col("k")).alias("bucket")).agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: both corpora's counts (bucket, n) meet by bucket."""
    total = lambda counts: float((counts.agg(F.sum("n")).first()[0] or 0) + buckets)
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    share = lambda n, of: (F.coalesce(n, F.lit(0)) + 1).cast("double") * F.lit(of)
    ratio = share(F.col("t"), total(raw)) / share(F.col("s"), total(target))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def contributions(rows: DataFrame, by_bucket: DataFrame, size: int = RANGE, salts: int = SALTS) -> DataFrame:
    """block, place, gain: postings shuffled to their gains by range of buckets and salt."""
    packed = by_bucket.groupBy(F.floor(F.col("bucket") / size).cast("int").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))
    dealt = packed.select("p", "gains", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s")).hint("shuffle_hash")
    own = rows.where("sizes is not null").select("block", "part", "sizes", "places", "counts", "large", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    met = own.join(dealt, (F.col("part") == F.col("p")) & (F.col("salt") == F.col("s"))).select("block", "sizes", "places", "counts", "large", "gains")

    def run(batches):
        for b in batches:
            gains_of = b.column(5)
            out = [contribution(*(c[k].as_py() for c in b.columns[1:5]), gains_of[k].values.to_numpy()) for k in range(b.num_rows)]
            if out:
                block = np.repeat(b.column(0).to_numpy(), BLOCK)
                place = np.tile(np.arange(BLOCK, dtype=np.int32), len(out))
                some = (w := np.concatenate(out)) != 0
                yield pa.RecordBatch.from_arrays([pa.array(block[some]), pa.array(place[some]), pa.array(w[some])], ["block", "place", "gain"])

    return met.mapInArrow(run, "block long, place int, gain long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, eligible: Column, drawn: int, score: str = "score", id_col: str = "i") -> DataFrame:
    """The rows with rank: 1 to ``drawn`` by falling score, then id, among those that are eligible; null for others.

    Ranges of the order go to partitions; a row's place is its number in its range and the rows of the ranges before.
    """
    order = [F.col("quadrat_out"), F.desc(score), F.col(id_col).asc_nulls_last()]
    sorted_ = rows.withColumn("quadrat_out", ~eligible).repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    kept = cut(sorted_.withColumn("quadrat_p", F.shiftright(number, 33)).withColumn("quadrat_k", number.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = kept.groupBy(F.col("quadrat_p").alias("p")).count().select("p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("quadrat_before"))
    place = F.col("quadrat_before") + F.col("quadrat_k")
    out = kept.join(F.broadcast(offsets), F.col("quadrat_p") == F.col("p"))  # as many rows as partitions
    return out.withColumn("rank", F.when(~F.col("quadrat_out") & (place < drawn), place + 1)).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: its id, n_features, weight, score and rank (null if it isn't drawn)."""
    own = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    aim = target.select(F.lit(0).alias("i"), F.col(target_text).alias("t"))
    with arrow_batches(docs.sparkSession):
        rows = cut(postings(own), "postings")
        wanted = cut(bucket_sums(postings(aim).select("part", "sums")), "target")
        of = gains(bucket_sums(rows.select("part", "sums")), wanted)
        by_document = contributions(rows, of).groupBy("block", "place").agg(F.sum("gain").alias("gain"))
        about = rows.where("ids is not null").select("block", F.posexplode(F.arrays_zip("ids", "n_features", "n_words")).alias("place", "x"))
        both = about.join(by_document.hint("shuffle_hash"), ["block", "place"], "left")
        scored = both.select(F.col("x.ids").alias("i"), "x.n_features", "x.n_words", F.coalesce("gain", F.lit(0)).alias("weight"))
        scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("i"), seed)), "scored")
    eligible = F.col("n_words") >= least_words
    n = scored.where(eligible).count()
    return ranked(scored, eligible, percent * n // 100).select(F.col("i").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long"))
