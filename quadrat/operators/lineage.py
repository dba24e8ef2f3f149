"""Experiment records as tables: staleness over a graph of stages, and planned against analysed documents, path by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A stage's inputs are the results of the one before it.
STAGE_EDGES = (("match", "validation"), ("validation", "power"), ("power", "delivery"), ("delivery", "effect"), ("effect", "recommendation"))
#: States that are never marked.
UNTOUCHED = ("planned", "not_started", "not_applicable")
#: What a leaf of two documents can be.
STATES = ("same", "changed", "only_planned", "only_analysed")


def stage_edges(spark) -> DataFrame:
    """parent, child."""
    return spark.createDataFrame(STAGE_EDGES, "parent string, child string")


def staleness(stages: DataFrame, edges: DataFrame, cut=lambda df: df) -> DataFrame:
    """stages with own_change, stale, new_status and changed.

    stages: experiment, stage, status, stored, current (fingerprints). A stage with a result has changed if its inputs' current
    fingerprint is known and isn't the stored one. It is stale if it has, or if a stage that it rests on is stale, directly or
    through others: marks pass along the edges until none is new, at most as often as the graph is deep. A stale stage whose
    inputs, and all that it rests on, are as stored again is completed again.
    """
    done = ~F.col("status").isin(*UNTOUCHED)
    known = F.col("stored").isNotNull() & (F.coalesce("current", F.lit("")) != "")
    own = stages.withColumn("own_change", done & F.coalesce(known & (F.col("stored") != F.col("current")), F.lit(False)))
    marked = cut(own.where("own_change").select("experiment", "stage").distinct())
    fresh = marked
    while not fresh.isEmpty():
        reached = fresh.join(edges, F.col("stage") == F.col("parent")).select("experiment", F.col("child").alias("stage")).distinct()
        fresh = cut(reached.join(marked, ["experiment", "stage"], "left_anti"))
        marked = cut(marked.unionByName(fresh))
    x = own.join(marked.withColumn("is_marked", F.lit(True)), ["experiment", "stage"], "left")
    x = x.withColumn("stale", done & F.col("stored").isNotNull() & F.coalesce("is_marked", F.lit(False))).drop("is_marked")
    status = F.when(F.col("stale"), "stale").when((F.col("status") == "stale") & F.col("stored").isNotNull(), "completed").otherwise(F.col("status"))
    return x.withColumn("new_status", status).withColumn("changed", F.col("new_status") != F.col("status"))


def nesting(doc: Column) -> Column:
    """How many levels of objects and arrays that hold something a JSON text has: strings and empty ones are put aside, then brackets counted."""
    bare = F.regexp_replace(F.regexp_replace(doc, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "s"), r"\s", "")
    marks = F.split(F.regexp_replace(F.regexp_replace(bare, r"\{\}|\[\]", "s"), r"[^\[\]{}]", ""), "")
    at = lambda acc, x: acc["now"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.coalesce(F.aggregate(marks, start, lambda acc, x: F.struct(at(acc, x).alias("now"), F.greatest(acc["most"], at(acc, x)).alias("most")), lambda acc: acc["most"]), F.lit(0))


def deepest_level(docs: DataFrame, doc: str, deepest: int) -> int:
    """No less than the largest nesting of the documents, which mustn't reach ``deepest``; text that is no JSON has none beyond it.

    Brackets outside of strings are counted once for each arrangement of them, empty pairs too, which are a level at most.
    """
    shape = F.regexp_replace(doc, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\[\]{}]++', "")
    shapes = docs.select(shape.alias("shape")).where("shape is not null").distinct().select(F.replace(F.replace("shape", F.lit("{"), F.lit("[s")), F.lit("}"), F.lit("]")).alias("shape"))
    most = shapes.agg(F.max(nesting(F.replace("shape", F.lit("[]"), F.lit("[s]"))))).first()[0] or 0
    if most >= deepest:
        exact = docs.where((nesting(F.col(doc)) >= deepest) & F.try_parse_json(doc).isNotNull())
        if not exact.isEmpty():
            raise ValueError(f"a document is deeper than {deepest} levels")
    return min(most, deepest - 1)


def leaves(doc: Column, levels: int) -> Column:
    """An array of path, type, value: the leaves of a JSON document of up to so many levels, taken apart within its row."""
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  (a lambda's argument is found once)

    def opened(n: Column) -> Column:
        node = lambda step, v: F.struct(F.concat(n["path"], step).alias("path"), v.alias("v"))
        fields = once(F.try_variant_get(n["v"], "$", "map<string,variant>"), lambda m: F.when(F.size(m) > 0, F.transform(F.map_entries(m), lambda e: node(F.concat(F.lit("."), e["key"]), e["value"]))))
        items = once(F.try_variant_get(n["v"], "$", "array<variant>"), lambda a: F.when(F.size(a) > 0, F.transform(a, lambda x, k: node(F.concat(F.lit("["), k.cast("string"), F.lit("]")), x))))
        return F.coalesce(fields, items, F.array(n))

    def leaf(n: Column, kind: Column) -> Column:
        known = F.when(n["v"].isNull(), "invalid").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
        value = F.when(kind == "STRING", F.try_variant_get(n["v"], "$", "string")).when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID")), F.to_json(n["v"]))
        return F.struct(n["path"].alias("path"), known.alias("type"), value.alias("value"))

    nodes = F.array(F.struct(F.lit("$").alias("path"), F.try_parse_json(doc).alias("v")))
    for _ in range(levels):
        nodes = F.flatten(F.transform(nodes, opened))
    return F.transform(nodes, lambda n: once(F.schema_of_variant(n["v"]), lambda kind: leaf(n, kind)))


def flattened(docs: DataFrame, key: str = "key", doc: str = "doc", deepest: int = 32) -> DataFrame:
    """key, path, type, value: a row for every leaf of a JSON document, an empty object or array being a leaf.

    Paths are $.name and $.name[0]; types string, number, boolean, null, object and array. A first pass finds the largest
    depth, a second takes each document apart within its row. A document that is no JSON gives a leaf of type invalid.
    """
    levels = deepest_level(docs, doc, deepest)
    return docs.select(F.col(key).alias("key"), F.explode(leaves(F.col(doc), levels)).alias("x")).select("key", "x.path", "x.type", "x.value")


def record_comparison(planned: DataFrame, analysed: DataFrame, key: str = "key", doc: str = "doc", deepest: int = 32) -> DataFrame:
    """``comparison_summary`` of the documents' leaves, found record by record: documents are shuffled once, and no leaf is.

    Leaves of a side whose paths are all different are compared as sets; where a path repeats (a record that has several documents,
    names with dots) each leaf meets each of its path. Records without a key agree with none.
    """
    levels = max(deepest_level(x, doc, deepest) for x in (planned, analysed))
    none = F.lit(None).cast("struct<doc:string>")
    side = lambda df, p: df.select(F.col(key).alias("key"), *((F.struct(F.col(doc).alias("doc")) if p == x else none).alias(x) for x in "pa"))
    docs = side(planned, "p").unionByName(side(analysed, "a")).groupBy("key").agg(F.collect_list("p").alias("p"), F.collect_list("a").alias("a"))
    rows = docs.select("key", *(F.flatten(F.transform(x, lambda d: leaves(d["doc"], levels))).alias(x) for x in "pa"))
    rows = rows.select("*", *(F.transform(x, lambda n: n["path"]).alias(f"{x}_paths") for x in "pa"))

    # sets of text: a leaf is its path's length, path, type and value
    whole = lambda x: F.transform(x, lambda n: F.concat(F.char_length(n["path"]).cast("string"), F.lit(":"), n["path"], n["type"], F.lit(":"), F.coalesce(n["value"], F.lit(""))))
    path_of = lambda s: F.substring(s, F.instr(s, ":") + 1, F.substring_index(s, ":", 1).cast("int"))
    differ = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    some = rows.select("*", (F.col("key").isNotNull() & differ("p_paths") & differ("a_paths")).alias("sets"))
    some = some.withColumn("same", F.when(F.col("sets"), F.array_intersect(whole("p"), whole("a"))))
    some = some.withColumn("n_both", F.when(F.col("sets"), F.size(F.array_intersect("p_paths", "a_paths")))).withColumn("n_same", F.size("same"))
    n, m = F.col("n_both"), F.col("n_same")
    other = F.when((m == F.size("p")) & (m == F.size("a")), F.array().cast("array<string>")).otherwise(F.array_except(F.array_union("p_paths", "a_paths"), F.transform("same", path_of)))
    sets = F.struct(m.alias("same"), (n - m).alias("changed"), (F.size("p") - n).alias("only_planned"), (F.size("a") - n).alias("only_analysed"), other.alias("paths"))

    def met(n: Column) -> Column:
        with_n = F.filter("a", lambda m: F.col("key").isNotNull() & (m["path"] == n["path"]))
        state = lambda m: F.when((n["type"] == m["type"]) & n["value"].eqNullSafe(m["value"]), "same").otherwise("changed")
        named = F.transform(with_n, lambda m: F.struct(n["path"].alias("path"), state(m).alias("state")))
        return F.when(F.size(named) > 0, named).otherwise(F.array(F.struct(n["path"].alias("path"), F.lit("only_planned").alias("state"))))

    alone = F.filter("a_paths", lambda x: F.col("key").isNull() | ~F.exists("p_paths", lambda y: x == y))
    states = F.concat(F.flatten(F.transform("p", met)), F.transform(alone, lambda x: F.struct(x.alias("path"), F.lit("only_analysed").alias("state"))))
    some = some.withColumn("states", F.when(~F.col("sets"), states))
    count = lambda s: F.size(F.filter("states", lambda x: x["state"] == s))
    each = F.struct(*(count(s).alias(s) for s in STATES), F.transform(F.filter("states", lambda x: x["state"] != "same"), lambda x: x["path"]).alias("paths"))
    done = some.select("key", F.when(F.col("sets"), sets).otherwise(each).alias("n"))
    matches = (F.col("n.changed") + F.col("n.only_planned") + F.col("n.only_analysed") == 0).alias("matches")
    return done.select("key", matches, *(F.col(f"n.{s}").cast("long").alias(f"n_{s}") for s in STATES), F.array_join(F.array_sort("n.paths"), ",").alias("differences"))


def compared(planned: DataFrame, analysed: DataFrame) -> DataFrame:
    """key, path, planned, analysed, state: same, changed (value or type), only_planned or only_analysed, of two flattened tables."""
    a = planned.select("key", "path", F.col("type").alias("planned_type"), F.col("value").alias("planned"))
    b = analysed.select("key", "path", F.col("type").alias("analysed_type"), F.col("value").alias("analysed"))
    same = (F.col("planned_type") == F.col("analysed_type")) & F.col("planned").eqNullSafe(F.col("analysed"))
    state = F.when(F.col("planned_type").isNull(), "only_analysed").when(F.col("analysed_type").isNull(), "only_planned").when(same, "same").otherwise("changed")
    return a.join(b, ["key", "path"], "full").select("key", "path", "planned", "analysed", state.alias("state"))


def comparison_summary(rows: DataFrame) -> DataFrame:
    """key, matches, n_same, n_changed, n_only_planned, n_only_analysed, differences (paths in order): a row for each key."""
    n = lambda s: F.count_if(F.col("state") == s)
    paths = F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") != "same", F.col("path")))), ",")
    return rows.groupBy("key").agg((n("same") == F.count("*")).alias("matches"), *(n(s).alias(f"n_{s}") for s in STATES), paths.alias("differences"))
