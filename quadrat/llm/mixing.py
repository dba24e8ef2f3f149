"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

The documents of a source are dealt into blocks. With integer target units u_i and D = sum of u_i, the k-th block of a source
(from 0) is released at slot floor(k D / u_i) and due before slot ceil((k + 1) D / u_i); in every slot the released block
of the earliest deadline runs. Each source then never deviates from its share of the slots so far by a whole block. The
schedule repeats after D slots, so one cycle of it is folded, by a higher-order aggregate over D slots, and joined to the
blocks. When sources are used up, the schedule goes on for the rest with their units (a phase); a phase begins with the
first cycle that a source enters without blocks. Sources with equal units and equal phases need nothing of each other: the
work is a count by source, a fold a phase, and joins on (phase, source, place).

Ranks within a source are counted in two steps, by (source, bucket) and then within a bucket, so that a source with a third
of all rows is spread over many tasks.

Defined results: a null source is a source of its own; sources without a target weight get ``default_units``; documents with
equal ids and texts are rows of their own; an empty table gives no rows; no row is dropped or repeated; extra columns stay
as they are, columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a block.
BLOCK = 32
#: Units that default weights are rounded to.
UNITS = 400
#: Rows of a source that are ranked in one task.
BUCKET_ROWS = 500
#: Rows up to which the template of all phases is broadcast; a larger one is joined by a shuffle.
MAX_TEMPLATE = 200_000


def square_root_units(counts: DataFrame, units: int = UNITS) -> DataFrame:
    """source, units: weights in proportion to the square root of a source's documents, rounded, at least one unit."""
    whole = counts.agg(F.sum(F.sqrt("n")).alias("whole"))
    share = F.sqrt("n") / F.col("whole") * units
    return counts.join(F.broadcast(whole)).select("source", F.greatest(F.round(share), F.lit(1)).cast("int").alias("units"))  # one row of one number


def edf_cycle(own: Column) -> Column:
    """One cycle of the schedule of ``own`` (array of source, units): array of slot, source, k, release, deadline."""
    d = F.aggregate(own, F.lit(0), lambda a, x: a + x["units"])

    def step(acc: Column, slot: Column) -> Column:
        def offer(x: Column, i: Column) -> Column:
            k = F.get(acc["done"], i)
            total = acc["d"]
            release = F.floor(k * total / x["units"]).cast("int")
            deadline = F.ceil((k + 1) * total / x["units"]).cast("int")
            return F.when((release <= slot) & (k < x["units"]), F.struct(deadline.alias("deadline"), i.alias("i"), k.alias("k"), release.alias("release")))

        best = F.array_min(F.transform(acc["own"], offer))
        done = F.transform(acc["done"], lambda n, i: F.when(i == best["i"], n + 1).otherwise(n))
        row = F.struct(slot.alias("slot"), F.get(acc["own"], best["i"])["source"].alias("source"), best["k"].alias("k"), best["release"].alias("release"), best["deadline"].alias("deadline"))
        return F.struct(acc["d"].alias("d"), acc["own"].alias("own"), done.alias("done"), F.concat(acc["out"], F.array(row)).alias("out"))

    nothing = F.array().cast("array<struct<slot:int,source:string,k:int,release:int,deadline:int>>")
    start = F.struct(d.alias("d"), own.alias("own"), F.transform(own, lambda _: F.lit(0)).alias("done"), nothing.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), d - 1), start, step, lambda acc: acc["out"])


def phases(blocks: DataFrame) -> DataFrame:
    """phase, cycle (its first), d (slots a cycle), base (its first slot), own (sources and units), from source, units, blocks.

    A source is used up after ceil(blocks / units) cycles; every distinct such number ends a phase.
    """
    ends = blocks.where("blocks > 0").withColumn("last", F.ceil(F.col("blocks") / F.col("units")).cast("long"))
    steps = ends.select(F.col("last").alias("until")).distinct()
    active = steps.join(ends, ends["last"] >= steps["until"]).groupBy("until").agg(F.array_sort(F.collect_list(F.struct("source", "units"))).alias("own"), F.sum("units").cast("long").alias("d"))
    order = Window.orderBy("until")  # a row for each source at most
    timed = active.withColumn("cycle", F.coalesce(F.lag("until").over(order), F.lit(0).cast("long"))).withColumn("phase", F.row_number().over(order))
    return timed.withColumn("base", F.sum((F.col("until") - F.col("cycle")) * F.col("d")).over(order) - (F.col("until") - F.col("cycle")) * F.col("d")).select("phase", "cycle", "until", "d", "base", "own")


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source: str = "source", block: int = BLOCK, default_units: int = 1) -> DataFrame:
    """The documents with mix_block (number within the source), mix_slot, mix_release, mix_deadline (slots) and mix_rank (place within the block).

    weights: source, units (integers above 0); without them weights follow ``square_root_units``.
    """
    src = F.coalesce(F.col(source), F.lit("\0null"))
    rows = docs.drop("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_rank")
    n_rows = docs.select(source).count()
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    keyed = rows.withColumn("quadrat_source", src).withColumn("quadrat_bucket", F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)))
    small = docs.select(src.alias("source"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).alias("bucket")).groupBy("source", "bucket").count()
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small.select(F.col("source").alias("quadrat_source"), F.col("bucket").alias("quadrat_bucket"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("quadrat_offset"))
    counts = small.groupBy("source").agg(F.sum("count").alias("n"))
    units = square_root_units(counts) if weights is None else counts.join(weights.select("source", F.col("units").cast("int")), "source", "left").select("source", F.coalesce("units", F.lit(default_units)).alias("units"))
    blocks = counts.join(units, "source").select("source", "units", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    plan = phases(blocks)
    cycle = plan.select("phase", "cycle", "until", "d", "base", F.explode(edf_cycle(F.col("own"))).alias("x"))
    names = {"cycle": "cycle", "until": "until", "d": "d", "base": "base", "x.source": "source", "x.k": "k", "x.slot": "slot", "x.release": "release", "x.deadline": "deadline"}
    template = cycle.select(*(F.col(c).alias(f"quadrat_t_{n}") for c, n in names.items()))
    size = blocks.agg(F.count("*") * F.sum("units")).first()[0] or 0  # sources x units: rows that the template has at most
    if size <= MAX_TEMPLATE:
        template = F.broadcast(template)
    within = Window.partitionBy("quadrat_source", "quadrat_bucket").orderBy(F.xxhash64(id_col, F.lit(1)), id_col)
    known = offsets.join(units.select(F.col("source").alias("quadrat_source"), F.col("units").alias("quadrat_units")), "quadrat_source")
    ranked = keyed.withColumn("quadrat_row", F.row_number().over(within)).join(known, ["quadrat_source", "quadrat_bucket"])
    place = F.col("quadrat_offset") + F.col("quadrat_row") - 1
    out = ranked.withColumn("mix_block", F.floor(place / block)).withColumn("mix_rank", (place % block).cast("int"))
    out = out.withColumn("quadrat_k", (F.col("mix_block") % F.col("quadrat_units")).cast("int")).withColumn("quadrat_cycle", F.floor(F.col("mix_block") / F.col("quadrat_units")))
    t = {n: F.col(f"quadrat_t_{n}") for n in names.values()}
    in_phase = (F.col("quadrat_source") == t["source"]) & (F.col("quadrat_k") == t["k"]) & (F.col("quadrat_cycle") >= t["cycle"]) & (F.col("quadrat_cycle") < t["until"])
    at = t["base"] + (F.col("quadrat_cycle") - t["cycle"]) * t["d"]
    return out.join(template, in_phase).select(*rows.columns, "mix_block", (at + t["slot"]).alias("mix_slot"), (at + t["release"]).alias("mix_release"), (at + t["deadline"]).alias("mix_deadline"), "mix_rank")


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of the mix: ranges of slots to partitions, sorted within."""
    return mixed.repartitionByRange("mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank")
