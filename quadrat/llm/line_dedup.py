"""Line dedup: fuzzy lines by MinHash, exact Jaccard verification and distributed union-find. DataFrame functions only.

A line is a part of a text between line feeds that has a visible character; it is compared in lower case, without space at
its ends. Its set holds the ``SHINGLE`` characters that begin at each of its places; a shorter line is its own and only
shingle. The ``KEEP`` smallest hashes of the set are its bottom-k MinHash signature, and each ``ROWS`` neighbours in it make a
band. Lines that share a band and ``COMMON`` of their signature are candidates, which misses about one in forty of the
pairs at the threshold and one in a thousand at 0.9. Sets of up to ``SHORT`` shingles are also known by each of their
smallest hashes, as many as a similar set cannot all lack, so that no pair of two short lines is missed; a similar pair of a
short and a longer line has bands. The exact Jaccard similarity of whole sets decides, and one line of every component stays,
that of the smallest (document, place).

Equal lines are one node from the start, told apart by 128 bits and counted with a combine before the shuffle. A band's pivot
is its line of most copies. Each node is first compared with the pivot whose signature is most like its own: one comparison a
node, however large the bands are. In bands that then still hold several components, nodes of different ones are compared by
their signatures and by 2,048 bits of their sets, which bound the similarity, in blocks that emit the few pairs whose sets are to be
compared: all of them, or where they are many first a node's likeliest in each other component, then those that are still apart. No
such pair is left out. Only documents that hold a candidate, and later those that may lose a line, are shuffled: a bit map of fixed
size tells which.

Defined results: a null text stays null; lines without a visible character are kept and never compared; a document whose
lines all go has an empty text; very long texts and lines are read whole; of lines that tie, that of the smallest (id, hash of
the text, place) stays; rows that repeat an id with the same text lose and keep the same lines, and with another text are
documents of their own; an empty table gives no rows; columns other than the id and the text stay as they are, and may
have any name that doesn't begin with ``quadrat_``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import conf, cut, forget
from quadrat.llm.components import components

SHINGLE = 10
SIMILARITY_PERCENT = 80
#: Shingles in a signature, and in a band.
KEEP = 12
ROWS = 3
#: Sets of up to so many shingles stand in their signature whole; a set beyond is similar to none below KEEP.
SHORT = 13
#: Shingles that two whole signatures must have in common; of two hundred pairs at the threshold one may have fewer.
COMMON = 6
#: Of more hashes than the first number, those below a share of all values are looked at first.
SHARES = ((8192, 2.0**-8), (1024, 2.0**-5), (128, 2.0**-2))
#: Partners of a line in one comparison of sets.
PARTNERS = 16
#: Members of a divided band that one task compares with all others.
BLOCK = 2048
#: Longs of bits that stand for a line's set, and shingles that they take.
WORDS = 32
SAMPLED = 1024
#: So many pairs a line of divided bands are many.
MANY = 8
#: Bits of the map of documents that may hold a candidate: 8 MB.
MAP_BITS = 1 << 26
_PER_ROW = 32768
#: Bytes of a task's shuffled input: sets are found of few bytes in much time.
TASK_INPUT = "1m"


def shingle_hashes(s: Column) -> Column:
    """The hashes of the ``SHINGLE`` characters (4 bytes each) from each place of a comparable line on, with repeats."""
    last = 4 * F.greatest(F.char_length(s) - SHINGLE, F.lit(0)) + 1
    windows = lambda u: F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda k: F.xxhash64(F.substring(u, k, F.lit(4 * SHINGLE))))
    return F.transform(F.array(F.encode(s, "UTF-32")), windows)[0]  # a lambda's argument, so that a line is encoded once


def shingle_set(s: Column) -> Column:
    return F.array_distinct(shingle_hashes(s))


def signature(s: Column) -> Column:
    """The upper halves of the ``SHORT + 1`` smallest of a line's distinct shingle hashes, sorted: of a short line all, and its size with them."""

    def below(hashes: Column, share: float) -> Column:
        return F.filter(hashes, lambda x: x < int(-(2**63) + share * 2**64))  # a second argument would be the place

    def least(hashes: Column) -> Column:
        few = hashes
        for size, share in reversed(SHARES):
            few = F.when(F.size(hashes) > size, below(hashes, share)).otherwise(few)
        enough_few = F.transform(F.array(F.array_distinct(few)), lambda f: F.when(F.size(f) > SHORT, f).otherwise(F.array_distinct(hashes)))[0]
        return F.transform(F.slice(F.sort_array(enough_few), 1, SHORT + 1), lambda h: F.call_function("shiftright", h, F.lit(32)).cast("int"))

    return F.transform(F.array(shingle_hashes(s)), least)[0]


def band_keys(sig: Column, percent: int = SIMILARITY_PERCENT) -> Column:
    """A key for each ``ROWS`` neighbours of a set's ``KEEP`` smallest hashes; of a short set a key for each of the smallest
    n - ceil(n * percent / 100) + 1, one of which every similar set has among its own as many."""
    n = F.size(sig)
    bands = F.array(*(F.xxhash64(*(F.get(sig, k + j) for j in range(ROWS))) for k in range(KEEP - ROWS + 1)))
    prefix = F.transform(F.slice(sig, 1, n - F.ceil(n * percent / 100).cast("int") + 1), lambda h: F.xxhash64(h, F.lit(-1)))
    return F.when(n < KEEP, prefix).when(n <= SHORT, F.array_union(bands, prefix)).otherwise(bands)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """v (128 bits of the line), n (its copies), i, p (its first document and place) and sig (its signature). docs: i, t."""
    lines = docs.select("i", F.posexplode(F.split(F.lower("t"), "\n", -1)).alias("p", "line")).where(F.col("line").rlike(r"\S"))
    signed = lines.select("i", "p", F.trim("line").alias("s")).select("i", "p", signature(F.col("s")).alias("sig"), F.unhex(F.md5(F.col("s").cast("binary"))).alias("v"))
    return signed.groupBy("v").agg(F.min(F.struct("i", "p", "sig")).alias("x"), F.count("*").alias("n")).select("v", "n", "x.i", "x.p", "x.sig")


def id_map(ids: DataFrame) -> DataFrame:
    """row, bits: a bit map of ``MAP_BITS`` bits of the hashed ids (i), in rows of 4 KB."""
    k = F.pmod(F.xxhash64("i"), F.lit(MAP_BITS))
    return ids.select(k.alias("k")).groupBy(F.floor(F.col("k") / _PER_ROW).alias("row")).agg(F.bitmap_construct_agg((F.col("k") % _PER_ROW).cast("long")).alias("bits"))


def marked(docs: DataFrame, rows: DataFrame, id_col: str, mark: str) -> DataFrame:
    """The documents with ``mark``: whether their id may be among those of the map, which is broadcast for its fixed size."""
    own = docs.withColumn("quadrat_k", F.pmod(F.xxhash64(id_col), F.lit(MAP_BITS)))
    both = own.join(F.broadcast(rows.select(F.col("row").alias("quadrat_row"), F.col("bits").alias("quadrat_bits"))), F.floor(F.col("quadrat_k") / _PER_ROW) == F.col("quadrat_row"), "left")
    place = (F.col("quadrat_k") % _PER_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("quadrat_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1
    return both.withColumn(mark, F.coalesce(bit, F.lit(False))).drop("quadrat_k", "quadrat_row", "quadrat_bits")


def node_code() -> Column:
    """The magnitude of a line's copies, then bits of its hash."""
    return F.shiftleft(F.least(F.floor(F.log2("n")), F.lit(31)).cast("long"), 58) + F.shiftrightunsigned(F.xxhash64("v"), 6)


def band_members(lines: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """g, v, code, top: the nodes of every band that has several, and the code of its pivot, that of the largest.

    Should two nodes have one code, both are taken for it.
    """
    keys = lines.select(F.explode(band_keys(F.col("sig"), percent)).alias("g"), node_code().alias("code")).repartition("g")  # one shuffle for both uses
    tops = keys.groupBy("g").agg(F.max("code").alias("top"), F.min("code").alias("low")).where("top != low").select("g", "top")
    shared = keys.join(tops.hint("shuffle_hash"), "g")  # most keys are one line's: only codes are shuffled with them
    return shared.join(lines.select("v", node_code().alias("code")), "code").select("g", "v", "code", "top")


def candidate_lines(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """v, s: the comparable lines that ``nodes`` (v, i, p) names."""
    places = nodes.groupBy(F.col("i").alias("j")).agg(F.collect_list(F.struct("p", "v")).alias("ps"))
    some = marked(docs, id_map(nodes.select("i").distinct()), "i", "may").where("may")
    own = some.join(places.hint("shuffle_hash"), F.col("i") == F.col("j")).select("ps", F.split(F.lower("t"), "\n", -1).alias("lines"))
    return own.select("lines", F.explode("ps").alias("x")).select("x.v", F.trim(F.get("lines", F.col("x.p"))).alias("s")).dropDuplicates(["v"])


def enough(inter: Column, sizes: Column, percent: int) -> Column:
    return 100 * inter >= percent * (sizes - inter)


def common(sig: Column, other: Column) -> Column:
    return F.size(F.array_intersect(F.slice(sig, 1, KEEP), F.slice(other, 1, KEEP)))


def likely(sig: Column, other: Column, percent: int) -> Column:
    """Whether signatures leave a similarity of ``percent`` possible: by all of whole sets, by ``COMMON`` for parts of sets.

    Hashes of one set may have the same upper half, so those of a whole set that the other has are counted each. The lambda also
    keeps a join's condition out of whole-stage code: one method of it would be too long for the JVM to compile.
    """
    n, m = F.size(sig), F.size(other)
    whole = (n <= SHORT) & (m <= SHORT)
    shared = F.size(F.filter(sig, lambda h: F.array_contains(other, h)))
    return F.when(whole, enough(shared, n + m, percent)).otherwise(common(sig, other) >= COMMON * percent // 80)


def similar(pairs: DataFrame, texts: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """a, b: the pairs of nodes whose exact Jaccard similarity reaches ``percent``.

    Up to about ``PARTNERS`` partners of a node are compared with it in one row, so that its set is found once for them.
    """
    of = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(of, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    with_b = dealt.join(texts.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
    rows = with_b.groupBy("a", "part").agg(F.collect_list(F.struct("b", "sb")).alias("bs")).join(texts.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a")

    def alike(ha: Column, x: Column) -> Column:
        return F.transform(F.array(shingle_set(x["sb"])), lambda hb: enough(F.size(F.array_intersect(ha, hb)), F.size(ha) + F.size(hb), percent))[0]

    found = F.transform(F.array(shingle_set(F.col("sa"))), lambda ha: F.transform(F.filter("bs", lambda x: alike(ha, x)), lambda x: x["b"]))[0]
    return rows.select("a", F.explode(found).alias("b"))


def pivot_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: each node with the pivot of one of its bands whose signature is most like its own."""
    pairs = members.where("code != top").select("v", "top").distinct()
    own = pairs.join(nodes.select("v", "sig"), "v")
    both = own.join(nodes.select(F.col("v").alias("w"), F.col("code").alias("top"), F.col("sig").alias("other")), "top")
    good = both.where((F.col("v") != F.col("w")) & likely(F.col("sig"), F.col("other"), percent))
    best = good.groupBy("v").agg(F.max(F.struct(common(F.col("sig"), F.col("other")).alias("n"), "w")).alias("x"))
    return best.select(F.col("v").alias("a"), F.col("x.w").alias("b"))


def set_bits(texts: DataFrame) -> DataFrame:
    """v, n, k and the longs b0, b1, ...: the size of each line's set, and ``WORDS`` x 64 bits of which every shingle sets one.

    Of a set of more than ``SAMPLED`` shingles those of the smallest 2^-k of all hash values count, about as many. texts: a row for each v.
    """
    n = F.size("hs")
    k = F.greatest(F.ceil(F.log2(n / SAMPLED)), F.lit(0)).cast("int")
    some = F.when(F.col("k") == 0, F.col("hs")).otherwise(F.filter("hs", lambda h: F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 32) < F.pow(F.lit(2.0), 32 - F.col("k"))))
    rows = texts.select("v", shingle_set(F.col("s")).alias("hs")).withColumn("n", n).withColumn("k", k).select("v", "n", "k", F.explode_outer(some).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.call_function("shiftright", "h", F.lit(6)).bitwiseAND(F.lit(WORDS - 1))
    words = rows.select("v", "n", "k", word.alias("word"), bit.alias("bit")).groupBy("v", "n", "k", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("v", "n", "k").agg(*(F.coalesce(F.max(F.when(F.col("word") == j, F.col("bits"))), F.lit(0)).alias(f"b{j}") for j in range(WORDS)))


def may_reach(percent: int) -> Column:
    """Whether bits leave a similarity of ``percent`` possible between a line and the line of the columns other_n, other_k, other_b0, ...

    A shingle whose bit the other set hasn't is not in it, and similar sets lack few of each other's shingles: certain for whole
    sets; of samples four standard deviations more are left. Samples of different shares aren't compared.
    """
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("other_n")) / (100 + percent))

    def lacks(own: str, other: str, size: Column) -> Column:
        missing = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{own}b{j}").bitwiseAND(F.bitwise_not(F.col(f"{other}b{j}")))) for j in range(WORDS)))
        most = (size - need) / F.pow(F.lit(2.0), F.col("k"))
        return missing <= most + F.when(F.col("k") == 0, 0.0).otherwise(4 * F.sqrt(F.greatest(most, F.lit(0.0))) + 4)

    return (F.least("n", "other_n") >= need) & ((F.col("k") != F.col("other_k")) | lacks("", "other_", F.col("n")) & lacks("other_", "", F.col("other_n")))


def mixed_members(members: DataFrame) -> DataFrame:
    """g, v, c, blocks: the nodes (g, v, c) of bands that hold several components."""
    mixed = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("g", "blocks")
    return members.join(mixed, "g")


def open_pairs(mixed: DataFrame, nodes: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """a, ca, b, cb, n: the pairs of a band's nodes (g, v, c, blocks) that are in different components and have like signatures and bits.

    Blocks of a band's nodes meet all its others within the join, which emits the few pairs that its condition leaves, each in the
    first band that it shares. n tells how much of the signatures is in common.
    """
    mark = F.aggregate("sig", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))
    known = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731  never null, so that code needs no tests for it
    own = mixed.join(nodes.select("v", "sig", mark.alias("mark"), band_keys(F.col("sig"), percent).alias("keys")), "v").join(bits, "v")
    own = own.select("g", "v", "c", "sig", "keys", *(known(x) for x in ("blocks", "mark", *(x for x in bits.columns if x != "v"))))
    left = own.select("*", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"))
    names = {"v": "w", "c": "d", "sig": "other", "mark": "mark_w", "keys": "keys_w"} | {x: f"other_{x}" for x in ("n", "k", *(f"b{j}" for j in range(WORDS)))}
    right = own.select(F.col("g").alias("h"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), *(F.col(x).alias(y) for x, y in names.items()))
    n = F.size("sig")
    fewest = F.least(F.lit(COMMON * percent // 80 - 2), F.bit_count("mark") - (n - F.ceil(n * percent / 100)))  # also where hashes share a bit
    some = F.bit_count(F.col("mark").bitwiseAND(F.col("mark_w"))) >= fewest  # cheap
    apart = (F.col("v") > F.col("w")) & (F.col("c") != F.col("d")) & some & may_reach(percent) & likely(F.col("sig"), F.col("other"), percent)
    once = F.array_min(F.array_intersect("keys", "keys_w")) == F.col("g")
    both = left.join(right, (F.col("g") == F.col("h")) & (F.col("block") == F.col("at")) & apart & once)
    return both.select(F.col("v").alias("a"), F.col("c").alias("ca"), F.col("w").alias("b"), F.col("d").alias("cb"), common(F.col("sig"), F.col("other")).alias("n"))


def _labelled(rows: DataFrame, comp: DataFrame, node: str = "v", label: str = "c") -> DataFrame:
    return rows.join(comp.select(F.col("node").alias(node), F.col("component").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))


def line_components(docs: DataFrame, lines: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """node, component of all nodes that have a similar one in a band; and v, i, p of the nodes of all bands."""
    members = cut(band_members(lines, percent), "bands")
    nodes = cut(members.select("v", "code").distinct().join(lines.select("v", "i", "p", "sig"), "v"), "nodes")
    texts = cut(candidate_lines(docs, nodes), "texts")  # once, for all comparisons

    def links(pairs: DataFrame) -> DataFrame:
        return cut(similar(pairs, texts, percent), "links")

    found = links(cut(pivot_pairs(members, nodes, percent), "pairs"))
    comp = cut(components(found), "components")
    mixed = cut(mixed_members(_labelled(members.select("g", "v"), comp)), "mixed")
    forget(members)
    if mixed.isEmpty():
        forget(texts)
        return comp, nodes
    bits = cut(set_bits(texts.join(mixed.select("v").distinct().hint("shuffle_hash"), "v")), "bits")  # dealt by v, as set_bits groups it
    pairs = cut(open_pairs(mixed, nodes, bits, percent), "pairs")
    n_pairs, n_lines = pairs.count(), bits.count()
    forget(mixed)
    forget(bits)
    if not n_pairs:
        forget(texts)
        return comp, nodes
    united = lambda found: _labelled(_labelled(found, comp, "a", "ca"), comp, "b", "cb").select("ca", "cb").where("ca != cb").distinct()
    if n_pairs <= MANY * n_lines:
        more = cut(united(links(pairs.select("a", "b"))), "united")
    else:  # a node's likeliest partner in each other component first; what that unites needs no more comparisons
        best = cut(pairs.groupBy("a", "cb").agg(F.max_by("b", F.struct("n", "b")).alias("b")).select("a", "b"), "best")
        more = cut(united(links(best)), "united")
        now = cut(components(more, "ca", "cb"), "components")
        rest = _labelled(_labelled(pairs, now, "ca", "la"), now, "cb", "lb").where("la != lb").select("a", "b").join(best, ["a", "b"], "left_anti")
        more = more.unionByName(united(links(cut(rest, "pairs")))).distinct()
    forget(texts)
    over = cut(components(more, "ca", "cb"), "components").select(F.col("node").alias("component"), F.col("component").alias("c"))
    known = comp.unionByName(over.select(F.col("component").alias("node"), "component"))  # nodes that had no link are their own component
    return known.join(over, "component", "left").select("node", F.coalesce("c", "component").alias("component")).distinct(), nodes


def kept_lines(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """i, p, stays: the first place of every distinct line, with 1, and again, with 0, if another line of its component stays instead. docs: i, t."""
    lines = cut(distinct_lines(docs), "lines")
    comp, nodes = line_components(docs, lines, percent)
    placed = comp.join(nodes.select(F.col("v").alias("node"), "i", "p"), "node")
    first = placed.groupBy("component").agg(F.min(F.struct("i", "p")).alias("x"))
    gone = placed.join(first, "component").where(F.struct("i", "p") != F.col("x")).select("i", "p", F.lit(0).alias("stays"))
    return lines.select("i", "p", F.lit(1).alias("stays")).unionByName(gone)


def _restored(both: DataFrame, text: str) -> DataFrame:
    """quadrat_places, the lines kept by number, become the text, quadrat_lines and quadrat_kept."""
    split = both.withColumn("quadrat_split", F.split(F.col(text), "\n", -1))
    blank = F.filter(F.transform("quadrat_split", lambda s, k: F.when(~s.rlike(r"\S"), k)), lambda k: k.isNotNull())
    done = split.withColumn("quadrat_places", F.array_sort(F.array_union(blank, "quadrat_places")))
    left = F.array_join(F.transform("quadrat_places", lambda k: F.get("quadrat_split", k)), "\n")
    done = done.withColumn("quadrat_lines", F.size("quadrat_split").cast("long")).withColumn("quadrat_kept", F.size("quadrat_places").cast("long"))
    return done.withColumn(text, F.when(left.rlike(r"\S"), left).otherwise(""))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = SIMILARITY_PERCENT, counts: bool = False) -> DataFrame:
    """The documents with the lines that stay; with ``counts`` also quadrat_lines and quadrat_kept, lines before and after."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    own = docs.select(row.alias("i"), F.col(text).alias("t"))
    before = own.select("i", F.size(F.filter(F.split("t", "\n", -1), lambda s: s.rlike(r"\S"))).alias("n")).where("n > 0")
    nothing = F.lit(None).cast("int")
    with conf(docs.sparkSession, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_INPUT}):
        kept = kept_lines(own, percent)
    rows = kept.select("i", "p", "stays", nothing.alias("n")).unionByName(before.select("i", nothing.alias("p"), nothing.alias("stays"), "n"))
    of = rows.groupBy("i").agg(F.max("n").alias("n"), *(F.collect_list(F.when(F.col("stays") == k, F.col("p"))).alias(f"p{k}") for k in (0, 1)))
    changed = cut(of.where(F.size("p1") - F.size("p0") < F.col("n")).select("i", F.array_except("p1", "p0").alias("places")), "changed")
    both = marked(docs.withColumn("quadrat_i", row), id_map(changed.select("i")), "quadrat_i", "quadrat_may")
    places = changed.select(F.col("i").alias("quadrat_id"), F.col("places").alias("quadrat_places"))
    some = both.where("quadrat_may").join(places.hint("shuffle_hash"), F.col("quadrat_i") == F.col("quadrat_id"), "left")
    same = both.where("not quadrat_may").withColumn("quadrat_places", F.lit(None).cast("array<int>")).unionByName(some.where("quadrat_places is null").drop("quadrat_id"))
    n = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    same = same.withColumn("quadrat_lines", n).withColumn("quadrat_kept", n)
    out = [*docs.columns, *(["quadrat_lines", "quadrat_kept"] if counts else [])]
    return same.select(out).unionByName(_restored(some.where("quadrat_places is not null"), text).select(out))
