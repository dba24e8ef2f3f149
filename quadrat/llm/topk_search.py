"""Exact top-k search by no-random-access aggregation.

The inner product of a query and a vector is a sum over dimensions, so each dimension is a list of the vectors sorted by
what they add: by the component downwards where the query's is positive, upwards where it is negative. The lists are read
from the front at the same pace. At a depth, what has been read of a vector gives a lower and an upper bound of its score:
an unread component lies between the list's last entry and the entry read last. Vectors whose upper bound, and unread
vectors ("outsiders") whose sum of frontiers, lie under the k-th best lower bound cannot qualify. Reading stops when few
vectors are left; only their final scores are resolved.

Spark deals the work in blocks: a block of candidates meets a block of queries in one task, which works through the
candidates slice by slice, so that later slices start with the k-th best score of earlier ones. Bounds of all queries at a
depth are products of small matrices of the read and the unread part. Scores are integers; sums stay exact in float64.

Defined results: vectors that are null, hold null or non-finite components take no part, nor do those without an id; a query
is compared with vectors of its own length only, one of length 0 included; rows that repeat an id are candidates and queries of
their own, and a query leaves out its own row only; with fewer than k candidates all are returned; ties go to the smaller id;
extra columns are ignored; an empty table gives no rows. Sums are exact up to 2^53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 20
#: Parts in which a query's candidates of all blocks are merged first.
PARTS = 64
SCALE = 64.0
#: Rows of a block of queries and of a block of candidates, and candidates that are read together.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16384
SLICE = 2048
#: Share of each list that is read before each look at the bounds.
DEPTHS = (0.5, 0.75)
#: Resolve final scores once at most this share of the vectors can still qualify.
RESOLVE_SHARE = 0.15


def nra_bounds(q: np.ndarray, lists: np.ndarray, rank: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores after ``depth`` entries of every list.

    q: queries x dimensions; lists: each dimension's values in ascending order; rank: each vector's place in that order. A
    positive query component reads its list from the end, a negative one from the front.
    """
    n = len(lists)
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    values = np.take_along_axis(lists, rank, 0)
    from_top, from_front = rank >= n - depth, rank < depth
    high = lists[n - depth - 1 if depth < n else 0]  # the largest that an unread entry can be, from the end
    low = lists[depth if depth < n else n - 1]
    left = np.concatenate([positive, negative], 1)
    seen = left @ np.concatenate([np.where(from_top, values, 0), np.where(from_front, values, 0)], 1).T
    unread = np.concatenate([~from_top, ~from_front], 1).astype(q.dtype).T
    upper = seen + (left * np.concatenate([high, low])) @ unread
    lower = seen + (left * np.concatenate([lists[0], lists[-1]])) @ unread
    return lower, upper


def search_slice(q: np.ndarray, x: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row, score) that may be among the k best. best: each query's k-th best score so far."""
    n = len(x)
    order = np.argsort(x, 0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    lists = np.take_along_axis(x, order, 0)
    alive = None
    for share in (*DEPTHS, 1.0):
        depth = max(1, int(np.ceil(share * n)))
        lower, upper = nra_bounds(q, lists, rank, depth)
        bound = best
        if n > k:  # the k-th best lower bound
            bound = np.maximum(best, np.partition(lower, n - k, 1)[:, n - k])
        alive = upper >= bound[:, None]
        if depth >= n or alive.mean() <= RESOLVE_SHARE:
            break
    a, b = np.nonzero(alive)
    score = np.empty(len(a), q.dtype)
    for at in range(0, len(a), 1 << 18):
        s = slice(at, at + (1 << 18))
        score[s] = np.einsum("ij,ij->i", q[a[s]], x[b[s]])
    return a, b, score


def search_block(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best candidates of the block: the query's row, candidate ids, scores; ties to the smaller id."""
    best = np.full(len(q), -np.inf)
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for at in range(0, len(x), SLICE):
        a, b, s = search_slice(q, x[at : at + SLICE], k, best)
        a, b, s = np.concatenate([held[0], a]), np.concatenate([held[1], ids[at : at + SLICE][b]]), np.concatenate([held[2], s])
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.searchsorted(a, np.arange(len(q)))
        place = np.arange(len(a)) - first[a]
        keep = place < k
        kth = place == k - 1
        best[a[kth]] = s[kth]
        held = (a[keep], b[keep], s[keep])
    return held


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in order of the ids."""
    ids = pdf["vec_id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.stack([np.asarray(v, np.float64) for v in pdf["v"]])[order]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id, d (length) and v: floor(scale * x) of every component, for the vectors that take part."""
    x = F.col(vector)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("d"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest integer inner products. Both inputs are ``integer_vectors``.

    Rows are told apart, not ids: k + 1 candidates of each query are found, and its own row is taken from them.
    """
    n_q = max(1, -(-queries.count() // query_block))
    n_c = max(1, -(-vectors.count() // candidate_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")
    c = vectors.select(block(n_c).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), "d", "vec_id", "v").withColumn("q", F.col("q").cast("long"))
    once = queries.groupBy("vec_id", "d", "v").agg(F.count("*").alias("copies"))  # equal queries have equal results
    q = once.select(block(n_q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), "d", "vec_id", "v", "copies", F.xxhash64("v").alias("key")).withColumn("c", F.col("c").cast("long"))

    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "key", "copies", "own", "part", "vec_id", "score"]
        if not len(qs) or not len(cs):
            return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
        x = np.stack([np.asarray(v, np.float64) for v in qs["v"]])
        a, b, s = search_block(x, *_matrix(cs), k + 1)
        rows = [qs["vec_id"].to_numpy()[a], qs["key"].to_numpy()[a], qs["copies"].to_numpy()[a], (x * x).sum(1)[a], np.full(len(a), cs["c"].iloc[0] % PARTS), b, s]
        return pd.DataFrame({n: v.astype(np.int64) for n, v in zip(names, rows, strict=True)})

    found = q.groupBy("c", "q", "d").cogroup(c.groupBy("c", "q", "d")).applyInPandas(run, "query_id long, key long, copies long, own long, part long, vec_id long, score long")
    query = ["query_id", "key", "copies", "own"]
    first = lambda xs: F.slice(F.array_sort(xs), 1, k + 1)
    parts = found.groupBy(*query, "part").agg(first(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("b"))  # k + 1 rows a query and block
    best = parts.groupBy(*query).agg(first(F.flatten(F.collect_list("b"))).alias("b"))
    at = F.array_position("b", F.struct((-F.col("own")).alias("s"), F.col("query_id").alias("vec_id")))
    others = F.when(at > 0, F.concat(F.slice("b", F.lit(1), at.cast("int") - 1), F.slice("b", at.cast("int") + 1, F.lit(k + 1)))).otherwise(F.col("b"))
    each = best.select("query_id", F.slice(others, 1, k).alias("b"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    rows = each.select("query_id", F.posexplode("b").alias("p", "x"))
    return rows.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
