"""SimHash near-duplicates by anchor points: covering codes as meeting places of fingerprints.

A document's fingerprint has a bit for each of 64 bits of its shingles' hashes: 1 if over half of the hashes have it. Two
fingerprints that differ in at most ``DISTANCE`` bits link, and documents that links reach share a component.

The 64 bits are cut into segments; of k differing bits one segment has at most floor(k / segments) = d. For each segment the
codewords of a covering code are the anchors: a Hamming code on some bits of the segment and all words on the others, so that
every word is within R = 1 of an anchor. A fingerprint lives at its nearest anchor, and visits every anchor within R + d. Of
two that differ in at most d bits of a segment, each visits the anchor at which the other lives, by the triangle inequality;
so all pairs meet, and are compared in full at the anchor. No link is missed whatever the code, which only sets the balance
between copies and comparisons: ``choose_layout`` takes the cheaper of two by the number of distinct fingerprints.

Equal fingerprints are one node from the start, made with a combine before the shuffle. What meets at an anchor streams
through a task in order of anchor: those who live there first, then visitors in batches, so that memory holds residents only,
and of an anchor with more than ``RESIDENTS`` these in parts of their own tasks. A task gives only links that unite what its
anchor had apart. Residents search among those that no search has reached yet, and visitors whom a resident's search centre
links are compared with the other groups only, so that a group of near copies costs about as many comparisons as members.

Defined results: a null text, like one without words, has fingerprint zero, and links like any other; fewer words than a
shingle has make one shingle; equal fingerprints link; null ids take part, and a component holding only such rows has a null
component_id; rows that repeat an id are rows of their own with the id's smallest component; an empty table gives no rows; texts of
any length are hashed in pieces; columns other than the id and the text are ignored, and may have any name.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import arrow_batches, cut, word_pieces
from quadrat.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
#: Bits of each segment: (bits of the Hamming code, bits that anchors have as they are).
LAYOUTS = {"thirds": ((15, 7), (15, 6), (15, 6)), "halves": ((31, 1), (31, 1))}
#: Residents of one anchor that a task holds at most.
RESIDENTS = 1 << 17
#: A fingerprint that more than one in so many rows have meets its component in a broadcast.
HOT = 1000
#: Seconds that a copy takes to shuffle and a comparison takes, of which only the ratio counts.
COPY_COST, COMPARE_COST = 2e-6, 4e-9
#: A-Z become lower-case and the six characters that part words a space.
_PLAIN = bytes(32 if 0x09 <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text."""
    votes, n, last = np.zeros(BITS, np.int64), 0, []
    for words, _ in word_pieces((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN), SHINGLE - 1):
        parts = [b" ".join(x) for x in zip(*(words[k:] for k in range(SHINGLE)), strict=False)]
        last = words
        if parts:
            n += len(parts)
            votes += _votes(parts)
    if not n and last:
        n, votes = 1, _votes([b" ".join(last)])
    return sum(1 << k for k in np.flatnonzero(2 * votes > n).tolist())


def _votes(parts: list[bytes]) -> np.ndarray:
    """How many hashes have each bit."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """i, f (the fingerprint, as a signed long) of every row. docs: i, t."""
    kind = docs.schema["i"].dataType.simpleString()

    def run(batches):
        for b in batches:
            f = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["i", "f"])

    return docs.select("i", "t").mapInArrow(run, f"i {kind}, f long")


def parity_rows(code: int) -> list[int]:
    """The parity checks of the Hamming code of ``code`` = 2^r - 1 bits: check j holds the bits whose number, from 1, has bit j."""
    return [sum(1 << k for k in range(code) if (k + 1) >> j & 1) for j in range(code.bit_length())]


@cache
def visits(code: int, free: int, d: int) -> list[list[int]]:
    """By syndrome: the words to add to a segment of that syndrome for all anchors within 1 + d, the home first.

    A word leads to an anchor if it has the same syndrome. The home is the anchor at a distance of 0 or 1 of the code's bits.
    """
    out: list[list[int]] = [[] for _ in range(code + 1)]
    for weight in range(d + 2):
        for places in combinations(range(code + free), weight):
            syndrome = 0
            for k in places:
                syndrome ^= k + 1 if k < code else 0
            out[syndrome].append(sum(1 << k for k in places))
    home = [0, *(1 << k for k in range(code))]
    return [[home[s], *(w for w in words if w != home[s])] for s, words in enumerate(out)]


def choose_layout(n: int, distance: int = DISTANCE) -> str:
    """The layout of least cost for ``n`` distinct fingerprints that are spread evenly."""

    def cost(layout) -> float:
        d = distance // len(layout)
        per = [(np.mean([len(w) for w in visits(code, free, d)]), 2.0 ** (code + free) / (code + 1)) for code, free in layout]
        return sum(n * copies * COPY_COST + n * (n / anchors) * copies * COMPARE_COST for copies, anchors in per)

    return min(LAYOUTS, key=lambda name: cost(LAYOUTS[name]))


def meetings(nodes: DataFrame, layout: str, distance: int = DISTANCE) -> DataFrame:
    """anchor, f, lives: every fingerprint (f) at the anchors that it visits. The anchor's number holds its segment."""
    parts, low = [], 0
    for s, (code, free) in enumerate(LAYOUTS[layout]):
        segment = F.shiftrightunsigned("f", low).bitwiseAND(F.lit((1 << (code + free)) - 1))
        checks = [(F.bit_count(segment.bitwiseAND(F.lit(mask))) % 2) * (1 << j) for j, mask in enumerate(parity_rows(code))]
        syndrome = sum(checks, F.lit(0)).cast("int")
        table = F.array(*(F.array(*(F.lit(w).cast("long") for w in words)) for words in visits(code, free, distance // len(LAYOUTS[layout]))))
        parts.append((segment, syndrome, table, s))
        low += code + free

    def at(part) -> DataFrame:
        segment, syndrome, table, s = part
        words = nodes.select("f", segment.alias("w"), F.posexplode(F.get(table, syndrome)).alias("k", "e"))
        return words.select((F.col("w").bitwiseXOR(F.col("e")) * len(parts) + s).alias("anchor"), "f", (F.col("k") == 0).alias("lives"))

    out = at(parts[0])
    for part in parts[1:]:
        out = out.unionByName(at(part))
    return out


def united(points: np.ndarray, distance: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Components of points: a label each (the place of its first search centre), links that unite them, and whether a point is
    linked with the centre that its label names. Each search looks among points that no search has reached."""
    n = len(points)
    label, direct, links = np.full(n, -1), np.zeros(n, bool), []
    open_ = np.arange(n)
    while len(open_):
        centre = int(open_[0])
        label[centre], direct[centre] = centre, True
        open_, queue, first = open_[1:], [centre], True
        while queue and len(open_):
            x = queue.pop()
            near = np.bitwise_count(points[open_] ^ points[x]) <= distance
            if near.any():
                found = open_[near]
                label[found] = centre
                direct[found] = first
                links += [(x, y) for y in found.tolist()]
                queue += found.tolist()
                open_ = open_[~near]
            first = False
    return label, links, direct


class Anchor:
    """The residents of one anchor, and the links that visitors bring."""

    def __init__(self, residents: np.ndarray, distance: int):
        self.points, self.distance = residents, distance
        self.label, links, _ = united(residents, distance)
        self.links = [(int(residents[x]), int(residents[y])) for x, y in links]
        _, size = np.unique(self.label, return_counts=True)
        labels = np.unique(self.label)
        self.large = int(labels[size.argmax()])  # the group of most residents, known by its centre
        self.others = np.flatnonzero(self.label != self.large)
        self.alone = len(self.points) == 1

    def visit(self, visitors: np.ndarray) -> list[tuple[int, int]]:
        """Links of visitors, one with each group of residents that they reach."""
        centre = self.points[self.large]
        near = np.bitwise_count(visitors ^ centre) <= self.distance
        out = [(int(v), int(centre)) for v in visitors[near]]
        if self.alone:
            return out
        for own, against in ((visitors[near], self.others), (visitors[~near], np.arange(len(self.points)))):
            step = max(1, (1 << 22) // max(1, len(against)))
            for k in range(0, len(own) if len(against) else 0, step):
                part = own[k : k + step]
                v, r = np.nonzero(np.bitwise_count(part[:, None] ^ self.points[against][None, :]) <= self.distance)
                if len(v):
                    keys = np.stack([v, self.label[against[r]]])
                    _, first = np.unique(keys, axis=1, return_index=True)
                    out += [(int(part[v[x]]), int(self.points[against[r[x]]])) for x in first]
        return [(a, b) for a, b in out if a != b]


def compared(meeting: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links of what meets at each anchor, its rows being together in a task, residents first."""

    def run(batches):
        held: list[np.ndarray] = []
        current, anchor = None, None
        links: list[tuple[int, int]] = []

        def batch():
            a = np.array(links, np.uint64).reshape(-1, 2)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy().view(np.int64)), pa.array(a[:, 1].copy().view(np.int64))], ["a", "b"])

        def settle():
            nonlocal anchor
            if anchor is None and held:
                anchor = Anchor(np.concatenate(held), distance)
                links.extend(anchor.links)

        for b in batches:
            key = b.column(0).to_numpy() * 2**20 + b.column(1).to_numpy()
            f, lives = b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lives[1:] != lives[:-1])])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                if key[lo] != current:
                    settle()
                    current, held, anchor = key[lo], [], None
                if lives[lo]:
                    held.append(f[lo:hi])
                elif held:  # an anchor without residents has nothing to compare
                    settle()
                    links.extend(anchor.visit(f[lo:hi]))
            if links:
                yield batch()
        settle()
        yield batch()

    return meeting.select("anchor", "part", "f", "lives").mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, layout: str | None = None, distance: int = DISTANCE, most: int = RESIDENTS) -> DataFrame:
    """a, b: links among distinct fingerprints (f), enough to unite whatever all links unite."""
    layout = layout or choose_layout(nodes.count(), distance)
    meeting = meetings(nodes, layout, distance)
    size = meeting.where("lives").groupBy("anchor").count().where(F.col("count") > most)
    size = cut(size.select("anchor", F.ceil(F.col("count") / most).cast("int").alias("parts")), "anchors")
    if size.isEmpty():
        dealt = meeting.withColumn("part", F.lit(0))
    else:  # residents are dealt to parts by their hash; every visitor and every resident visits the parts
        many = meeting.join(size, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = many.where("lives").withColumn("part", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
        all_ = many.where("not lives or parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lives", F.lit(False))
        dealt = own.unionByName(all_).drop("parts")
    rows = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("lives"))
    with arrow_batches(nodes.sparkSession, records=1 << 16):
        return cut(compared(rows, distance).distinct(), "links")


def hex_of(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, layout: str | None = None, most: int = RESIDENTS) -> DataFrame:
    """Per row: its id, fingerprint (16 hexadecimal digits) and component_id, the smallest id that links reach."""
    own = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    with arrow_batches(docs.sparkSession):
        rows = cut(fingerprints(own), "fingerprints")
    nodes = cut(rows.groupBy("f").agg(F.min("i").alias("least"), F.count("*").alias("n")), "nodes")
    links = near_links(nodes.select("f"), layout, distance, most)
    comp = components(links).select(F.col("node").alias("f"), F.col("component").alias("c"))
    named = nodes.join(comp, "f").select("f", "c", "least")
    least = named.groupBy("c").agg(F.min("least").alias("first"))
    moved = named.join(least, "c").select(F.col("f").alias("g"), "first")
    known = nodes.join(moved, nodes["f"] == moved["g"], "left").select(F.col("f").alias("g"), "n", F.coalesce("first", "least").alias("component_id"))
    known = cut(known, "known")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = known.where(F.col("n") * HOT > total)  # fewer than HOT rows
    both = rows.join(F.broadcast(hot.select("g", F.lit(True).alias("is_hot"), "component_id")), rows["f"] == F.col("g"), "left").drop("g")
    cold = both.where("is_hot is null").drop("component_id").join(known.select("g", "component_id"), F.col("f") == F.col("g"))
    out = both.where("is_hot").select("i", "f", "component_id").unionByName(cold.select("i", "f", "component_id"))
    return out.select(F.col("i").alias(id_col), hex_of(F.col("f")).alias("fingerprint"), "component_id")
