"""Spelling variants: words that differ by one code point, found by reporting points of a rectangle.

A vocabulary's words are points: their place in the order of the words, and in the order of the words read backwards. The
words that have q's first p code points are an interval of the first order, and those that end as q does after p an interval
of the second. Words of q's length in both differ from q in one place at most; words one longer have one code point more. A
wavelet tree over the points reports those of a rectangle in as many steps as the length's logarithm, for each.

To part the work, an edit's place p lies in a window of places; what stands before and after the window is then equal in both
words, and is the key by which words meet. Two windows, a word's halves, do for a start; keys that more than ``GROUP`` words
have are parted again, each window by halves, until a window is one place, where an alphabet bounds the group. Keys are dealt
to shards of about ``SHARD`` rows, each with trees of its own. A pair has one place of its edit (an inserted code point counts
where its run begins), which is in one window, so it is found once.

Forms: a word's form is its near word of most occurrences, if these are ``RATIO`` times its own. Counts grow along forms, so
following them ends; paths are halved in each round.

Defined results: a null text has no words; a null id is the empty text in its hash; rows that repeat an id count each; texts
of any length are read in pieces, words of any length count; of near words of equal counts the smallest in code-point order is
the form; an empty table gives no rows; columns other than the id and the text are ignored, and may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import arrow_batches, cut

LETTERS = r"A-Za-zÀ-ÿ"
#: Of the runs whose hash with the id is divisible by this, one code point goes.
NOISE = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Rows of a key that are parted no more, and of a shard.
GROUP = 1 << 14
SHARD = 1 << 16
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17
PIECE = 1 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}
_AFTER = chr(0x10FFFF)


def noisy_words(id_, text: str | None, runs: re.Pattern, gap: re.Pattern, noise: int = NOISE) -> dict[str, int]:
    """The words of a text, a few of them with a code point less, and their counts."""
    found: Counter = Counter()
    at, text = 0, text or ""
    while at < len(text):
        end = gap.search(text, at + PIECE)
        end = end.end() if end else len(text)
        found.update(runs.findall(text, at, end))
        at = end
    low: Counter = Counter()
    for w, n in found.items():
        low[w.lower() if w.isascii() else w.translate(_LOWER)] += n
    start, out = crc32(f"{'' if id_ is None else id_}:".encode()), Counter()
    for w, n in low.items():
        h = crc32(w.encode(), start)
        if h % noise == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        out[w] += n
    return out


def vocabulary(docs: DataFrame, letters: str = LETTERS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """w, n: the words of all texts that are long and frequent enough. docs: i, t."""

    def run(batches):
        runs, gap = re.compile(f"[{letters}]+"), re.compile(f"[^{letters}]")
        held: Counter = Counter()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["w", "n"])
            held.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                for w, n in noisy_words(i.as_py(), t.as_py(), runs, gap, noise).items():
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) >= HELD:
                    yield batch()
        yield batch()

    counts = docs.select("i", "t").mapInArrow(run, "w string, n long")
    return counts.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """A sequence of distinct values below its length; level by level the bits of the values, from the highest."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (len(values) - 1).bit_length())
        self.zeros = []
        for level in reversed(range(self.bits)):
            one = (values >> level) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)])
            values = np.r_[values[~one], values[one]]

    def report(self, left, right, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Of rectangles, places [left, right) by values [low, high): the number of a rectangle and a value in it, for all values."""
        k, base = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
            middle = base + (1 << level)
            down = (l0 < r0) & (base < high[k]) & (middle > low[k])
            up = (l1 < r1) & (middle < high[k]) & (middle + (1 << level) > low[k])
            left, right = np.r_[l0[down], l1[up]], np.r_[r0[down], r1[up]]
            k, base = np.r_[k[down], k[up]], np.r_[base[down], middle[up]]
        return k, base


class Words:
    """Words of one length in both orders, and the tree of their points."""

    def __init__(self, words: list[str]):
        self.forward = sorted(words)
        self.backward = sorted(w[::-1] for w in words)
        place = {w[::-1]: k for k, w in enumerate(self.backward)}
        self.tree = WaveletTree(np.array([place[w] for w in self.forward]))

    def rectangles(self, q: str, skip: int, lo: int, hi: int):
        """place, interval of the first order, interval of the second, for edits of q at places lo to hi - 1; q goes on ``skip``
        code points after the place. Only rectangles that may hold a word other than q."""
        least = 1 + skip  # of equal length q itself is in each interval
        ends, c, d = [], 0, len(self.backward)
        back = q[::-1]
        for p in reversed(range(lo, hi)):
            tail = back[: len(q) - p - skip]
            c, d = bisect_left(self.backward, tail, c, d), bisect_left(self.backward, tail + _AFTER, c, d)
            if d - c < least:
                break
            ends.append((p, c, d))
        a, b = 0, len(self.forward)
        for p, c, d in reversed(ends):
            head = q[:p]
            a, b = bisect_left(self.forward, head, a, b), bisect_left(self.forward, head + _AFTER, a, b)
            if b - a < least:
                break
            yield p, a, b, c, d

    def near(self, queries: list[tuple[str, int, int, int]]) -> list[tuple[int, str]]:
        """The number of a query (word, skip, lo, hi) and a word that it is an edit from, for all such words."""
        of, rows = [], []
        for k, q in enumerate(queries):
            for p, *rest in self.rectangles(*q):
                of.append((k, p))
                rows.append(rest)
        out, step = [], 1 << 18
        for at in range(0, len(rows), step):
            found, values = self.tree.report(*np.array(rows[at : at + step], np.int64).T)
            for x, v in zip(found.tolist(), values.tolist(), strict=True):
                (k, p), w = of[at + x], self.backward[v][::-1]
                q, skip = queries[k][:2]
                if w != q and (skip or p == 0 or q[p - 1] != w[p]):
                    out.append((k, w))
        return out


def windows(words: DataFrame) -> DataFrame:
    """w, n, size, lo, hi: every word in both halves of the places of words of its own length, and of words one longer."""
    length = F.char_length("w")
    sizes = words.select("w", "n", F.explode(F.array(length, length + 1)).alias("size"))
    half = (F.col("size") / 2).cast("int")
    return sizes.select("w", "n", "size", F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("size").alias("hi")))).alias("x")).select("w", "n", "size", "x.lo", "x.hi")


def keyed(rows: DataFrame) -> DataFrame:
    """The rows with key: what stands before and after the window, by its places in words of ``size``."""
    shorter = F.col("size") - F.char_length("w")
    tail = F.substring(F.col("w"), F.col("hi") - shorter + 1, F.col("size"))
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", F.substring(F.col("w"), F.lit(1), F.col("lo")), tail))


def parted(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows of windows with keys that at most ``group`` rows have, or windows of one place."""
    rows, done = keyed(windows(words)), None
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("key")
        large = cut(large, "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        stay = rows.join(large, "key", "left_anti").unionByName(rows.join(large, "key", "left_semi").where("hi - lo = 1"))
        done = stay if done is None else done.unionByName(stay)
        open_ = rows.join(large, "key", "left_semi").where("hi - lo > 1").withColumn("half", ((F.col("lo") + F.col("hi")) / 2).cast("int"))
        halves = F.explode(F.array(F.struct("lo", F.col("half").alias("hi")), F.struct(F.col("half").alias("lo"), "hi"))).alias("x")
        rows = cut(keyed(open_.select("w", "n", "size", halves).select("w", "n", "size", "x.lo", "x.hi")), "windows")


def near_words(words: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """w, near, m: all pairs of words one edit apart, each way round, with the second's count. words: w, n."""
    rows = parted(words, group)
    shards = max(1, -(-words.count() * 4 // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, near, m = [], [], []
        for size, rows in pdf.groupby("size"):
            length = rows["w"].str.len()
            count = dict(zip(rows["w"], rows["n"], strict=True))
            targets = rows.loc[length == size, "w"].unique().tolist()
            if not targets:
                continue
            queries = list(zip(rows["w"], (length == size).astype(int), rows["lo"], rows["hi"], strict=True))
            for k, other in Words(targets).near(queries):
                q, same = queries[k][:2]
                w.append(q)
                near.append(other)
                m.append(count[other])
                if not same:  # only the shorter one asks
                    w.append(other)
                    near.append(q)
                    m.append(count[q])
        return pd.DataFrame({"w": w, "near": near, "m": m}).astype({"m": "int64"})

    return rows.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInPandas(run, "w string, near string, m long")


def roots(forms: DataFrame) -> DataFrame:
    """w, root: the last of the forms that follow from each word. forms: w, form."""
    now = cut(forms.select("w", F.col("form").alias("root")), "roots")
    while True:
        over = now.select(F.col("w").alias("v"), F.col("root").alias("further"))
        step = cut(now.join(over, F.col("root") == F.col("v"), "left").select("w", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("w", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: int = RATIO, group: int = GROUP, shard: int = SHARD, noise: int = NOISE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    with arrow_batches(docs.sparkSession):
        words = cut(vocabulary(docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")), noise=noise), "words")
        pairs = near_words(words, group, shard)
        best = pairs.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("x"))
        best = cut(best.select(F.col("w").alias("v"), "n_near", F.col("x.near").alias("near"), (-F.col("x.less")).alias("m")), "near")
    joined = words.join(best, F.col("w") == F.col("v"), "left").withColumn("is_form", F.coalesce(F.col("m") >= ratio * F.col("n"), F.lit(False)))
    formed = cut(joined.select("w", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("near")).alias("form"), F.when(F.col("is_form"), F.col("m")).alias("form_n")), "formed")
    last = roots(formed.where("form is not null")).withColumnRenamed("w", "v")
    out = formed.join(last, F.col("w") == F.col("v"), "left")
    return out.select(F.col("w").alias("word"), "form", F.coalesce("root", "w").alias("root"), "n", "n_near", "form_n")
