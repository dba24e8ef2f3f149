"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as a T-occurrence search.

A document's set is a query to an inverted index; a partner must stand in at least T of the query's lists. DivideSkip divides
the lists: the L = T - m longest are only probed, the others are merged, and a partner must occur m times among these. With
a Jaccard threshold T is a tenth less than the set's size, so a document's short lists are its rarest tenth of tokens, and
only they are shuffled. Frequencies come from a table of fixed size that counts hashed tokens over all documents; a token
may look more frequent in it than it is, which costs time and never a link, as any common order of the tokens will do.

1. Every text gives the signature of its set; equal sets are one node from here on.
2. Nodes emit their short lists' entries. A task streams the entries token by token; lists of up to ``MERGE_LIST`` nodes
   give each node its partners' lists, which are heap-merged for each query; longer lists are left to step 4.
3. The candidates' long lists are probed by binary search in the partner's sorted set, which gives the exact overlap.
4. Long lists come from groups of copies or from very frequent passages: each node is compared with a pivot of its list,
   and then, in blocks that emit links only, with all nodes of it that may be in other components
   (components.link_large_groups). No list is capped.

Defined results: a null or wordless text has an empty set and links with nothing; fewer words than a shingle has make one
shingle; equal sets link; repeated rows of an id are one document to their component, with a row each in the result; an
empty table gives no rows; columns other than the id and the text are ignored, and may have any name.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrat.llm.common import cut, in_batches
from quadrat.llm.components import link_large_groups

SHINGLE = 3
PERCENT = 90
#: m, the occurrences that a partner needs in the merged short lists.
MERGED = 2
#: Lists of up to so many nodes are merged; longer ones are searched by pivots and components.
MERGE_LIST = 48
SKETCH_BITS = 22
SKETCH_ROW = 1 << 16
#: Members of a long list that one task compares with each other.
BLOCK = 512
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            up = np.full(n, _MUL)
            down = np.full(n, np.uint64(pow(int(_MUL), -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in UTF-8 bytes: the sum of byte values times powers, as differences of one running sum."""
    space = _SPACE[data]
    word = ~space
    starts = np.flatnonzero(word & np.r_[True, space[:-1]])
    ends = np.flatnonzero(word & np.r_[space[1:], True]) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[data]] * up[: len(data)], out=total[1:])
    return starts, _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashed shingles of a sequence of word hashes."""
    n = len(words) - size + 1
    if not len(words):
        return words
    count = size if n > 0 else len(words)
    h = np.full(max(n, 1), np.uint64(count), np.uint64)
    for i in range(count):
        h = _mix(h * np.uint64(3) + words[i : i + max(n, 1)])
    return np.unique(h)


def batch_sets(texts: pa.Array, size: int = SHINGLE):
    """Yield the set of every text of an Arrow column, in order."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at, none = 0, np.empty(0, np.uint64)
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        if to == at + 1 and offsets[to] - offsets[at] > PIECE:  # one very long text, in pieces that end at a space
            parts, lo, hi = [], int(offsets[at]), int(offsets[to])
            while lo < hi:
                cut_at = min(hi, lo + PIECE)
                while cut_at < hi and not _SPACE[buffer[cut_at]]:
                    cut_at += 1
                parts.append(word_hashes(buffer[lo:cut_at])[1])
                lo = cut_at
            yield shingle_set(np.concatenate(parts), size)
        else:
            lo, hi = int(offsets[at]), int(offsets[to])
            data = np.empty(hi - lo + to - at, np.uint8)  # a space after each text, so that no word crosses
            ends = offsets[at + 1 : to + 1] - lo + np.arange(to - at)
            keep = np.ones(len(data), bool)
            keep[ends] = False
            data[ends] = 32
            data[keep] = buffer[lo:hi]
            starts, words = word_hashes(data) if len(data) else (none, none)
            bounds = np.searchsorted(starts, np.r_[0, ends + 1])
            for i in range(to - at):
                yield shingle_set(words[bounds[i] : bounds[i + 1]], size)
        at = to


def signature(tokens: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    a = np.add.reduce(_mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    b = np.add.reduce(_mix(tokens * np.uint64(0xD6E8FEB86659FD93)))
    return np.array([a, b], np.uint64).tobytes()


def overlap_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least T with 100 T >= percent (n + m - T)."""
    return -(-percent * (n + m) // (100 + percent))


def short_lists(n: int, percent: int = PERCENT, merged: int = MERGED) -> int:
    """How many of a set's n lists are short: all but T - m, T being the least overlap with a set of any size."""
    return min(n, n - -(-percent * n // 100) + merged)


def heap_merge(lists: list[list], least: int) -> list:
    """The ids that occur in at least ``least`` of the sorted lists."""
    out, last, count = [], None, 0
    for x in heapq.merge(*lists):
        if x == last:
            count += 1
        else:
            last, count = x, 1
        if count == least:
            out.append(x)
    return out


def probe(query: np.ndarray, partner: np.ndarray) -> int:
    """How many of the query's tokens a binary search finds in the partner's sorted set."""
    at = np.searchsorted(partner, query)
    at[at == len(partner)] = 0
    return int((partner[at] == query).sum())


def _binary(rows: np.ndarray) -> pa.Array:
    """An Arrow column of the rows of a uint8 matrix."""
    n, w = rows.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def set_signatures(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> DataFrame:
    """i, n, sig of every document, and beside them rows (part, sketch): counts of hashed tokens, ``part`` telling which."""
    kind = docs.schema["i"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["i"].dataType)

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            sets, n = [], []
            for tokens in batch_sets(b.column(1), size):
                np.add.at(counts, (tokens >> np.uint64(64 - bits)).astype(np.int64), 1)
                n.append(len(tokens))
                sets.append(signature(tokens) if len(tokens) else None)
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], ["i", "n", "sig", "part", "sketch"])
        parts = len(counts) // SKETCH_ROW
        packed = [zlib.compress(counts[k * SKETCH_ROW : (k + 1) * SKETCH_ROW].tobytes(), 1) for k in range(parts)]
        none = [None] * parts
        yield pa.RecordBatch.from_arrays([pa.array(none, id_type), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())], ["i", "n", "sig", "part", "sketch"])

    return docs.mapInArrow(run, f"i {kind}, n long, sig binary, part int, sketch binary")


def _sum_sketch(parts: DataFrame, bits: int = SKETCH_BITS) -> tuple[np.ndarray, int]:
    """The counts of all tasks, summed by part, as levels of an eighth of a doubling (a byte each): a table of fixed size; and
    the level from which a token is very frequent."""

    def add(pdf):
        total = np.sum([np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in pdf["sketch"]], 0)
        return pdf.iloc[:1].assign(sketch=[zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)])

    level = F.floor(F.rand(11) * 16)  # sums in two steps, so that no task gets the counts of all others
    once = parts.select("part", "sketch", level.alias("l")).groupBy("part", "l").applyInPandas(lambda pdf: add(pdf[["part", "sketch"]]), "part int, sketch binary")
    rows = once.groupBy("part").applyInPandas(add, "part int, sketch binary").collect()
    if not rows:
        return np.zeros(1 << bits, np.uint8), 255
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["sketch"]), np.uint32) for r in sorted(rows, key=lambda r: r["part"])])
    levels = lambda c: np.minimum(255, np.round(8 * np.log2(1.0 + c))).astype(np.uint8)
    return levels(counts), int(levels(np.array([4 * counts.mean() + 4096]))[0])


def emit_short_lists(docs: DataFrame, levels: np.ndarray, frequent: int, size: int, percent: int, merged: int) -> DataFrame:
    """k, token, sig, n, n_long, is_long: the entries of every document's short lists. Tokens that are very frequent by the
    counts are told apart here already, and k spreads them."""
    shift = np.uint64(64 - int(np.log2(len(levels))))
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 4 MB, whatever the corpus

    def run(batches):
        counts = shared.value
        for b in batches:
            tokens, sigs, n, n_long, per = [], [], [], [], []
            for s in batch_sets(b.column(0), size):
                if not len(s):
                    continue
                df = counts[(s >> shift).astype(np.int64)]
                first = np.argsort(df, kind="stable")[: short_lists(len(s), percent, merged)]
                tokens.append(s[first])
                sigs.append(signature(s))
                n.append(len(s))
                per.append(len(first))
                n_long.append(int((df[first] >= frequent).sum()))
            if not tokens:
                continue
            t = np.concatenate(tokens)
            per = np.array(per)
            sig = np.repeat(np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 16), per, axis=0)
            is_long = counts[(t >> shift).astype(np.int64)] >= frequent
            k = np.where(is_long, _mix(t ^ np.ascontiguousarray(sig).view(np.uint64)[:, 0]), t).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t.view(np.int64)), _binary(sig), pa.array(np.repeat(n, per)), pa.array(np.repeat(n_long, per)), pa.array(is_long)], ["k", "token", "sig", "n", "n_long", "is_long"])

    return docs.select("t").mapInArrow(run, "k long, token long, sig binary, n long, n_long long, is_long boolean")


def stream_lists(entries: DataFrame, percent: int, longest: int) -> DataFrame:
    """From entries, each token's together: q, need, rs (a query, the occurrences it needs, a list of partners), or g, v (a member of a long list)."""

    def run(batches):
        held: list[tuple] = []  # entries of the token that is being read, until they are too many to merge
        token, last, overflow = None, None, False
        out: list[tuple] = []

        def flush():
            if len(held) < 2:
                return
            for i in range(1, len(held)):
                q, n, n_long = held[i]
                rs = [r for r, m, _ in held[:i] if 100 * min(n, m) >= percent * max(n, m)]
                if rs:
                    out.append((q, n_long, rs, None, None))

        def batch():
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["q", "n_long", "rs", "g", "v"])

        for b in batches:
            tokens = b.column(0).to_numpy()
            is_long = b.column(4).to_numpy(zero_copy_only=False)
            # entries alone with their token are most of all; they are passed over at once
            alone = np.r_[True, tokens[1:] != tokens[:-1]] & np.r_[tokens[1:] != tokens[:-1], False] & ~is_long
            if len(alone) and tokens[0] == token:
                alone[0] = False
            rows = np.flatnonzero(~alone)
            sub = b.take(pa.array(rows)) if len(rows) < len(tokens) else b
            for t, sig, n, n_long, long_ in zip(*(c.to_pylist() for c in sub.columns), strict=True):
                if long_:
                    out.append((None, None, None, t, sig))
                    continue
                if t != token:
                    flush()
                    held, token, last, overflow = [], t, None, False
                if sig == last:
                    continue  # another document with the same set
                last = sig
                if overflow:
                    out.append((None, None, None, t, sig))
                    continue
                held.append((sig, n, n_long))
                if len(held) > longest:
                    out.extend((None, None, None, t, x) for x, _, _ in held)
                    held, overflow = [], True
            if out:
                yield batch()
        flush()
        yield batch()

    ordered = entries.repartition("k").sortWithinPartitions("k", "token", "sig").select("token", "sig", "n", "n_long", "is_long")
    return ordered.mapInArrow(run, "q binary, n_long long, rs array<binary>, g long, v binary")


def merge_lists(lists: DataFrame, merged: int) -> DataFrame:
    """a, b: each query and the partners that occur often enough in its lists, by heap-merge."""

    def run(batches):
        query, own, n_long = None, [], 0

        def found():
            return [(query, r) for r in heap_merge(own, max(1, merged - n_long))] if own else []

        for b in batches:
            out = []
            for q, nl, rs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if q != query:
                    out += found()
                    query, own, n_long = q, [], nl
                own.append(rs)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])
        out = found()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])

    ordered = lists.where("q is not null").select("q", "n_long", "rs").repartition("q").sortWithinPartitions("q")
    return ordered.mapInArrow(run, "a binary, b binary")


def sets_of(docs: DataFrame, active: DataFrame, size: int) -> DataFrame:
    """sig, tokens (sorted hashes as bytes) of the documents whose ids are given; each is the representative of its set."""

    def run(batches):
        for b in batches:
            sets = list(batch_sets(b.column(0), size))
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "tokens"])

    own = docs.join(active.hint("shuffle_hash"), docs["i"] == active["rep"], "left_semi").select("t")
    return own.mapInArrow(run, "sig binary, tokens binary")


def block_links(pdf, percent: int) -> list[tuple[bytes, bytes]]:
    """Links among sets (v, c, tokens), enough to unite what they unite; overlaps of all pairs are products of 0/1 matrices."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
    n = np.array([len(x) for x in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = often > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(code, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], code[lo:hi] - at] = 1
        overlap += m @ m.T
    a, b = np.nonzero(np.triu((100 + percent) * overlap.astype(np.int64) >= percent * (n[:, None] + n[None, :]), 1))
    root = list(pdf["c"])
    ids, out = list(pdf["v"]), []
    first = {c: k for k, c in reversed(list(enumerate(root)))}
    up = [first[c] for c in root]

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    return out


def rest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within long lists between nodes whose labels differ (g, v, c): every block of a list's members meets every other."""
    import pandas as pd

    size = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("g", "blocks")
    own = members.join(size, "g").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    keyed = own.select("g", "v", "c", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = keyed.select("g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "v", "c")
    full = keyed.join(sets.select(F.col("sig").alias("v"), "tokens"), "v")

    def run(pdf):
        return pd.DataFrame(block_links(pdf, percent), columns=["a", "b"])

    return full.groupBy("g", "x", "y").applyInPandas(run, "a binary, b binary").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact overlap is large enough."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) and probe(p, q) >= overlap_needed(len(p), len(q), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta")), "a")
    with_b = with_a.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, merged: int = MERGED, longest: int = MERGE_LIST) -> DataFrame:
    """Per document: its id, n_shingles and component_id, the smallest id that links reach."""
    own = in_batches(docs).select(F.col(id_col).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    first = cut(set_signatures(own, size), "signatures")
    rows = first.where("part is null").select("i", "n", "sig")
    levels, frequent = _sum_sketch(first.where("part is not null").select("part", "sketch"))
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("i").alias("rep"))
    lists = cut(stream_lists(emit_short_lists(own, levels, frequent, size, percent, merged), percent, longest), "lists")
    members = lists.where("v is not null").select("g", "v").distinct()
    pairs = cut(merge_lists(lists, merged), "pairs")
    nodes = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).unionByName(members.select(F.col("v").alias("sig"))).distinct()
    active = classes.join(nodes, "sig", "left_semi").select("rep")
    sets = cut(sets_of(own, active, size).dropDuplicates(["sig"]), "sets")
    verify = lambda p: verified(p, sets, percent)
    _, comp = link_large_groups(members, cut(verify(pairs), "links"), verify, rest=lambda m: rest_links(m, sets, percent))
    named = comp.join(classes, comp["node"] == classes["sig"]).select("node", "component", "rep")
    least = named.groupBy("component").agg(F.min("rep").alias("c"))
    of = named.join(least, "component").select("node", "c")
    whole = classes.join(of, classes["sig"] == of["node"], "left").select(F.col("sig").alias("s"), F.coalesce("c", "rep").alias("c"))
    out = rows.join(whole, rows["sig"] == whole["s"], "left")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "i").alias("component_id"))
