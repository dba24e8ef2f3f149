"""Distributed union-find, and the search for links within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import cut, forget


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (x, y) with y < x."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy(F.col("x").alias("u")).agg(F.min("y").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = edges.select(F.col("y").alias("u"), F.col("x").alias("v")).join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    low = up.groupBy("x").agg(F.min("y").alias("m"))
    rest = up.join(low, "x").where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y"))
    return rest.unionByName(low.select("x", F.col("m").alias("y"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links reach, for every node that has a link.

    Large-star and small-star steps alternate until nothing changes; after each the edges go to a table, so that neither
    lineage nor memory grows. Ids may be of any type that has an order.
    """
    own = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()
    edges = cut(own, "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
    before = sign(edges)
    while before[0]:
        nxt = cut(_stars(edges), "edges")
        forget(edges)
        edges, after = nxt, sign(nxt)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("y").alias("node")).distinct()
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (g, v) with c: a node that v is linked to by a path, or v itself."""
    return members.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))


def _hop(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """v, c: every linked node takes the least label of itself and its neighbours, which stays a node that a path reaches."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
    if labels is None:
        return both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("c"))
    near = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u", "left").select("v", F.coalesce("cu", "u").alias("c"))
    return near.unionByName(labels).unionByName(near.select("v", F.col("v").alias("c"))).groupBy("v").agg(F.min("c").alias("c"))


def pivot_pairs(members: DataFrame, round_: int) -> DataFrame:
    """a, b: in every group of members (g, v, c), each with one of them (another one each round), unless their labels agree."""
    pivot = members.groupBy("g").agg(F.min_by(F.struct("v", "c"), F.xxhash64("v", F.lit(round_))).alias("p"))
    pairs = members.join(pivot, "g").where((F.col("v") != F.col("p.v")) & (F.col("c") != F.col("p.c")))
    return pairs.select(F.greatest("v", "p.v").alias("a"), F.least("v", "p.v").alias("b")).distinct()


def rest_pairs(members: DataFrame) -> DataFrame:
    """a, b: all pairs of a group whose labels differ."""
    mixed = members.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("g")
    left = members.join(mixed, "g", "left_semi")
    right = left.select("g", F.col("v").alias("w"), F.col("c").alias("d"))
    return left.join(right, "g").where((F.col("v") > F.col("w")) & (F.col("c") != F.col("d"))).select(F.col("v").alias("a"), F.col("w").alias("b")).distinct()


def link_large_groups(members: DataFrame, links: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int = 3, rest: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """All links that matter within large groups, and the components of all links.

    members: g, v; links: a, b, those known before; verify: pairs (a, b) to the links among them. Within a component no
    further link can change the result, so pairs that are known to be in one are skipped: nodes carry a label, a node that
    a path reaches, and equal labels mean one component. Some rounds compare each member with one pivot of its group, which
    unites most of a group of copies with as many comparisons as members; then all pairs whose labels still differ are
    compared, by ``rest`` if it is given (g, v, c to links). No pair is left out.
    """
    if members.isEmpty():
        return links, components(links)
    labels = cut(_hop(None, links), "labels")
    for r in range(rounds):
        found = cut(verify(pivot_pairs(_labelled(members, labels), r)), "links")
        links = links.unionByName(found)
        labels = cut(_hop(labels, found), "labels")
    last = _labelled(members, labels)
    links = links.unionByName(cut(rest(last) if rest else verify(rest_pairs(last)), "links"))
    return links, components(links)
