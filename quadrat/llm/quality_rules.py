"""Quality rules: base word rules, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed character n-grams are counted: one of trusted target documents, one of the raw corpus. A
document's score is the mean over its n-grams of ``log p_target - log p_raw``; it stays when the mean reaches a fixed
threshold. The counts live in a table of fixed size (``buckets`` rows), however large the corpus is, so that table alone
goes through the driver. Every document labelled good counts as target. Only documents that a bit map of their ids names
meet the ids themselves, which Spark broadcasts while they are few; beyond that, the texts of these are shuffled.

Defined results: a null text has no words and is rejected by the base rules, as is an empty one; documents are rows, so
repeated rows give repeated results; with no trusted document the ratio rejects nothing; columns other than the id and
the text are ignored, and may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from quadrat.llm.common import in_batches
from quadrat.llm.line_dedup import id_map, marked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

NGRAM = 3
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Mean log ratio from which a document stays. Clean text lies near 0; noise of symbols or capitals far below.
THRESHOLD = -0.35
CHUNK = 1 << 20
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def ngram_buckets(text: str, buckets: int = BUCKETS, n: int = NGRAM):
    """Yield arrays of the buckets of all n-grams of code points, a chunk at a time."""
    for at in range(0, max(1, len(text) - n + 1), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK + n - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = len(codes) - n + 1
        if size <= 0:
            return
        h = np.zeros(size, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i : i + size]) * MULTIPLIERS[i % len(MULTIPLIERS)]
            h ^= h >> np.uint32(15)
        yield h % np.uint32(buckets)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    if len(ids) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    found: dict[tuple, int] = {}
    for k in at:  # equal hashes are checked word by word
        key = tuple(codes[k : k + window].tolist())
        found[key] = found.get(key, 0) + 1
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for k in at:
        if found[tuple(codes[k : k + window].tolist())] > 1:
            marks[k] += 1
            marks[k + window] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif WORD.search(line):
                seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeated_words(words)


def count_ngrams(docs: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, target, raw: how often each bucket occurs in trusted documents, and in all of them."""

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for t, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for h in ngram_buckets(t or "", buckets):
                    c = np.bincount(h, minlength=buckets)
                    raw += c
                    if good:
                        target += c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(target), pa.array(raw)], ["bucket", "target", "raw"])

    counts = docs.select(F.col(text).alias("t"), F.col(trusted).alias("g")).mapInArrow(count, "bucket long, target long, raw long")
    return counts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """The smoothed log ratio of every bucket; ``counts`` has at most ``buckets`` rows."""
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    if not target.sum():
        return np.zeros(buckets)
    p = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * buckets))
    return p(target) - p(raw)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", good: str = "quality") -> DataFrame:
    """The ids that every label row calls good."""
    return labels.groupBy(F.col(id_col).alias("trusted_id")).agg(F.min(good).alias("g")).where("g = 1 and trusted_id is not null").select("trusted_id")


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """t, g of documents (i, t): the text, and whether the document is trusted."""
    trusted = trusted_ids(labels).select(F.col("trusted_id").cast(docs.schema["i"].dataType))
    both = marked(docs, id_map(trusted.select(F.col("trusted_id").alias("i"))), "i", "may")
    some = both.where("may").join(trusted, F.col("i") == F.col("trusted_id"), "left")
    return some.select("t", F.col("trusted_id").isNotNull().alias("g")).unionByName(both.where("not may").select("t", F.lit(False).alias("g")))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, carry: bool = False) -> DataFrame:
    """Every document's base counts and its verdict: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    With ``carry``, all columns of the documents, and these as quadrat_n_words and so on.
    """
    docs = in_batches(docs)
    judged = with_trust(docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")), labels)
    ratios = log_ratios(count_ngrams(judged, "t", "g", buckets), buckets)
    own = docs if carry else docs.select(id_col, text)
    at = own.columns.index(text)

    def judge(batches):
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                base = base_rules(t)
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                total, n = 0.0, 0
                for h in ngram_buckets(t or "", buckets):
                    total, n = total + float(ratios[h].sum()), n + len(h)
                ratio = total / n if n else 0.0
                out.append((*base, failed, not failed and ratio >= threshold, ratio))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            judged = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.columns if carry else [b.column(0)]), *judged], [*(b.schema.names if carry else [id_col]), *names])

    names = [f"quadrat_{n}" if carry else n for n in NAMES]
    kinds = [LongType()] * 5 + [BooleanType()] * 2 + [DoubleType()]
    kept = own.schema.fields if carry else own.schema.fields[:1]
    return own.mapInArrow(judge, StructType([*kept, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
