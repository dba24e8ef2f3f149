"""Small rules around the panel: empty axes, metric views, feature columns, checks of dates, messages, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.schemas import NoPopulationColumn

#: Words in names of columns that hold no measure.
CATEGORICAL_WORDS = ("area", "region", "county", "city", "district", "borough", "territory", "province", "state", "country", "name", "code")
#: Spellings of the population column, the standard one last; columns of markets and of another tool's regions.
POPULATION_NAMES = ("Total Population", "Population")
MARKET, OTHER_TOOL = "Market", "adobe"
#: Labels of how a validation was cross-validated.
VALIDATION_LABELS = ("🟢 Rolling-origin validation", "🟡 Partial rolling-origin validation", "⚪ Insufficient validation history")


def drop_empty_axes(df: DataFrame) -> DataFrame:
    """Without columns that are null throughout, then without rows that are. One aggregate finds the columns.

    A table without rows keeps its columns, as nothing says that they are empty; if all cells are null, no row is left.
    """
    n = df.agg(F.count("*").alias("quadrat_rows"), *(F.count(F.col(f"`{c}`")).alias(f"quadrat_{k}") for k, c in enumerate(df.columns))).first()
    kept = [c for k, c in enumerate(df.columns) if n[f"quadrat_{k}"]]
    if not n["quadrat_rows"]:
        return df
    cells = [F.col(f"`{c}`") for c in kept]
    return df.select(*cells).where(F.coalesce(*(F.when(c.isNotNull(), True) for c in cells))) if kept else df.limit(0)


def metric_view(df: DataFrame, metric: str, value: str) -> DataFrame:
    return df.where(F.col(metric) == value)


def without_blank_level(df: DataFrame, level: str) -> DataFrame:
    """The rows whose aggregation level is neither null nor blank."""
    return df.where(F.trim(F.col(level).cast("string")) != "")


def blank_level_counts(df: DataFrame, metric: str, level: str) -> DataFrame:
    """metric, kept, dropped: rows by metric, and those that a blank level takes out."""
    blank = F.coalesce(F.trim(F.col(level).cast("string")), F.lit("")) == ""
    return df.groupBy(metric).agg(F.count_if(~blank).alias("kept"), F.count_if(blank).alias("dropped"))


def population_column(columns: list[str]) -> str:
    """The population column by its stated spellings, else in any case and with outer blanks."""
    found = [c for c in POPULATION_NAMES if c in columns] or [c for c in columns if c.strip().lower() in {x.lower() for x in POPULATION_NAMES}]
    if not found:
        raise NoPopulationColumn(f"none of the columns is called {' or '.join(POPULATION_NAMES)}: {', '.join(columns)}")
    return found[0]


def grouping_columns(columns: list[str]) -> list[str]:
    """The columns before the population that tell regions apart; without any, the first column that isn't the market."""
    before = columns[: columns.index(population_column(columns))]
    own = [c for c in before if c != MARKET and not c.lower().startswith(OTHER_TOOL)]
    return own or [c for c in columns if c != MARKET][:1]


def numeric_features(df: DataFrame, grouping: list[str] = ()) -> DataFrame:
    """feature, numeric_share: columns without a categorical word in the name that are numeric by type or in over half their cells.

    Groupings, market and population are no features. A table without rows has the features that are numeric by type, with a null share.
    """
    barred = {*grouping, MARKET, *POPULATION_NAMES}
    own = [c for c in df.columns if c not in barred and not c.lower().startswith(OTHER_TOOL) and not any(w in c.lower() for w in CATEGORICAL_WORDS)]
    if not own:
        return df.sparkSession.createDataFrame([], "feature string, numeric_share double")
    typed = [c for c in own if isinstance(df.schema[c].dataType, T.NumericType)]
    share = df.agg(*(F.try_divide(F.count(F.col(f"`{c}`").try_cast("double")), F.count("*")).alias(c) for c in own))
    return share.unpivot([], [F.col(f"`{c}`") for c in own], "feature", "numeric_share").where(F.col("feature").isin(*typed) | (F.col("numeric_share") > 0.5))


def column_roles(df: DataFrame) -> DataFrame:
    """column, role (population, grouping, feature) of a table of regions; columns of no role are left out."""
    population, grouping = population_column(df.columns), grouping_columns(df.columns)
    fixed = df.sparkSession.createDataFrame([(population, "population"), *((c, "grouping") for c in grouping)], "column string, role string")
    return fixed.unionByName(numeric_features(df.drop(population), grouping).select(F.col("feature").alias("column"), F.lit("feature").alias("role")))


def standard_population(df: DataFrame) -> DataFrame:
    """The population column, however it is spelt, becomes Population."""
    return df.withColumnRenamed(population_column(df.columns), POPULATION_NAMES[-1])


def proportions(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, is_proportion: whether all values lie between 0 and 1."""
    ok = df.agg(*(F.coalesce((F.min(c) >= 0) & (F.max(c) <= 1), F.lit(False)).alias(c) for c in columns))
    return ok.unpivot([], columns, "feature", "is_proportion")


def missing_dates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """The dates asked for that no row of the panel has."""
    return dates.select("date").distinct().join(panel.select("date").distinct(), "date", "left_anti")


def dates_after(panel: DataFrame, end: Column) -> DataFrame:
    return panel.where(F.col("date") > end).select("date").distinct()


def date_matrix(panel: DataFrame, spine: DataFrame, regions: list[str]) -> DataFrame:
    """A row for every date of the spine and a column for each of the stated regions; what is missing stays null.

    Two rows of a region and date have no place in it: the job fails and says so.
    """
    twice = F.raise_error(F.concat(F.lit("several rows on "), F.first("date").cast("string"), F.lit(" of region "), F.first("region")))
    cells = panel.where(F.col("region").isin(regions)).groupBy("date", "region").agg(F.when(F.count("*") > 1, twice).otherwise(F.first("kpi")).alias("kpi"))
    wide = cells.groupBy("date").pivot("region", regions).agg(F.first("kpi"))
    return spine.select("date").distinct().join(wide, "date", "left")


def gap_steps(last: Column, following: Column, days: int) -> Column:
    """Steps of a series between two dates, at least one; a missing date counts as one step."""
    return F.coalesce(F.greatest(F.round(F.datediff(following, last) / days).cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))


def contiguity_blockers(panel: DataFrame, days: int) -> DataFrame:
    """region, gaps: regions whose consecutive dates lie apart by something else than the period, which an AR(1) model forbids."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("region").orderBy("date")))
    return panel.select("region", "date").distinct().select("region", gap.alias("gap")).groupBy("region").agg(F.count_if(F.col("gap") != days).alias("gaps")).where("gaps > 0")


def number_list(text: Column) -> Column:
    """The numbers of a comma-separated list; what isn't one is null, blanks are left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("double"))


def key_values(text: Column) -> Column:
    """name=number pairs, separated by commas, as a map; of a name that comes again the last number holds."""
    pairs = F.filter(F.transform(F.split(text, ","), lambda x: F.split(x, "=")), lambda x: F.size(x) == 2)
    last_first = F.reverse(F.transform(pairs, lambda x: F.struct(F.trim(x[0]).alias("name"), F.trim(x[1]).try_cast("double").alias("number"))))
    own = F.filter(last_first, lambda x, i: F.array_position(F.transform(last_first, lambda y: y["name"]), x["name"]) == i + 1)
    return F.map_from_entries(F.reverse(own))


def validation_label(folds: DataFrame) -> DataFrame:
    """method, label of folds (method, fallback, main_fallback): every fold cross-validated, some, or none."""
    n = folds.groupBy("method").agg(F.count("*").alias("n"), F.count_if("fallback").alias("k"), F.max("main_fallback").alias("main"))
    full, partial, none = map(F.lit, VALIDATION_LABELS)
    return n.select("method", F.when(F.col("main") | (F.col("k") == F.col("n")), none).when(F.col("k") == 0, full).otherwise(partial).alias("label"))


def row_loss(dropped: Column, before: Column) -> Column:
    """error over 20 % of rows lost, warning over 10 %."""
    pct = 100 * dropped / F.nullif(before, F.lit(0))
    return F.when(pct > 20, "error").when(pct > 10, "warning")


def excluded_share(planned: DataFrame, excluded: DataFrame, limit: float = 0.20) -> DataFrame:
    """n_planned, n_excluded, share, triggered: how much of the planned test period is excluded."""
    own = planned.select("date").distinct().join(excluded.select("date", F.lit(1).alias("out")).distinct(), "date", "left")
    n = own.agg(F.count("*").alias("n_planned"), F.count("out").alias("n_excluded"))
    return n.withColumn("share", F.coalesce(F.try_divide("n_excluded", "n_planned"), F.lit(0.0))).withColumn("triggered", F.col("share") > limit)


def impact_completed(results: DataFrame) -> DataFrame:
    """run, completed: in Evaluate mode, a method without blockers has a finite uplift. results: run, mode, uplift_pct, blockers."""
    x = F.col("uplift_pct").try_cast("double")
    ok = (F.col("mode") == "Evaluate") & (F.col("blockers") == 0) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return results.groupBy("run").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("completed"))


def meets_mde(expected: Column, direction: Column, mde: Column) -> Column:
    """Whether the expected effect, in the tested direction, is as large as what the design can detect."""
    return F.when(direction == "one_sided_positive", expected).when(direction == "one_sided_negative", -expected).otherwise(F.abs(expected)) >= mde


def balance_status(smd: Column) -> Column:
    """pass up to 0.20, supported up to 0.50, else fail, as is a difference that isn't finite."""
    finite = smd.isNotNull() & ~F.isnan(smd) & (F.abs(smd) != float("inf"))
    return F.when(finite & (smd <= 0.20), "pass").when(finite & (smd <= 0.50), "supported").otherwise("fail")


def blocking_errors(parse_errors: DataFrame, required: DataFrame, covered: DataFrame) -> DataFrame:
    """error: blockers of the parse report (error), and one of required regions (region) that nothing covers."""
    gap = required.select("region").distinct().join(covered.select("region").distinct(), "region", "left_anti")
    said = gap.agg(F.array_sort(F.collect_set("region")).alias("r")).where(F.size("r") > 0)  # the regions of one experiment
    message = F.concat(F.lit("Test regions that no row of the KPI table covers: "), F.array_join("r", ", "))
    return parse_errors.select("error").unionByName(said.select(message.alias("error")))
