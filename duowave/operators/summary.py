"""Counts, descriptive tables and column profiles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.functions.categories import GROUPS, TIMES
from duowave.functions.text import to_numeric
from duowave.plans.scratch import Scratch, materialize
from duowave.plans.skew import join_small, range_buckets

# Header pattern of age columns, plausible median range and least spread.
AGE_PATTERN = r"(alter|geburtsjahr|geburtsdatum|age|birth)"
AGE_RANGE = (10, 110)
AGE_MIN_SD = 0.5

# Pattern of texts that state a sex.
SEX_PATTERN = r"\b(w|f|m|weiblich|männlich|maennlich|female|male|divers|non[- ]binary|nb)\b"

# Relative rank error asked of approximate percentiles when bracketing an exact median.
MEDIAN_ACCURACY = 10_000
# Distinct values per range when the values around a median are ordered.
MEDIAN_BUCKET = 500_000


def missing_summary(df: DataFrame, raw: str, imputed: str, used: str) -> DataFrame:
    """Row count and missing counts of the raw, imputed and preferred score."""
    missing = {name: F.col(c).isNull() for name, c in (("raw", raw), ("imp", imputed), ("use", used))}
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(missing["raw"]).alias("na_raw"),
        F.count_if(missing["imp"]).alias("na_imp"),
        F.count_if(missing["use"]).alias("na_use"),
        F.count_if(missing["raw"] & ~missing["imp"]).alias("na_raw_imp_ok"),
        F.count_if(missing["imp"]).alias("too_many_missing"),
    )


def missing_table(df: DataFrame, value: str) -> DataFrame:
    """Frequency of missing and known values."""
    return df.groupBy(F.col(value).isNull().alias("is_missing")).agg(F.count("*").alias("n"))


def complete_pairs(df: DataFrame, keys: Sequence[str], time: str = "time", min_rows: int = 2,
                   distinct_times: bool = False) -> DataFrame:
    """Keys with at least ``min_rows`` rows, or with both visit labels."""
    if distinct_times:
        both = F.bool_or(F.col(time) == TIMES[0]) & F.bool_or(F.col(time) == TIMES[1])
        return df.groupBy(*keys).agg(both.alias("_both")).where("_both").select(*keys)
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select(*keys)


def contingency(df: DataFrame, by: Sequence[str] = ("instrument",), row: str = "group",
                column: str = "time") -> DataFrame:
    """Counts by group and visit label, unknown group included as a row and unknown label as a column."""
    label = F.col(column)
    return df.groupBy(*by, row).agg(
        *[F.count_if(label == t).alias(t) for t in TIMES],
        F.count_if(label.isNull()).alias("unknown_time"),
    )


def design_gate(df: DataFrame, by: Sequence[str] = ("instrument",), group: str = "group", time: str = "time",
                min_rows: int = 3) -> DataFrame:
    """Per instrument: whether rows, groups and cells suffice for a group x time comparison."""
    def cell(g: str, t: str):
        return (F.col(group) == g) & (F.col(time) == t)

    counts = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(cell(g, t)).alias(f"n_{g.lower()}_{t}") for g in GROUPS for t in TIMES],
    )
    groups = [sum((F.col(f"n_{g.lower()}_{t}") for t in TIMES), F.lit(0)) > 0 for g in GROUPS]
    full = F.least(*[F.col(f"n_{g.lower()}_{t}") for g in GROUPS for t in TIMES]) > 0
    valid = sum((g.cast("int") for g in groups), F.lit(0)).cast("long")
    return counts.withColumns({
        "valid_groups": valid,
        "passes": (F.col("n_rows") >= min_rows) & (valid >= 2) & full,
    })


def mean_se(df: DataFrame, by: Sequence[str] = ("instrument", "group", "time"), value: str = "score") -> DataFrame:
    """Mean and its standard error per cell over known values."""
    known = df.where(F.col(value).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"),
    ).withColumns({"lower": F.col("mean") - F.col("se"), "upper": F.col("mean") + F.col("se")})


def baseline_table(df: DataFrame, numeric: Sequence[str], categorical: Mapping[str, Sequence[str]],
                   group: str = "group", groups: Sequence[str] = GROUPS) -> DataFrame:
    """Characteristics by group: mean and sd of numbers; count and share of declared levels.

    One pass over the rows counts every variable; the rest works on that small count table. Shares
    are of the rows with a known level; ``n_overall`` counts known values over all groups. Rows
    without a group are left out, levels that do not occur are listed with 0.
    """
    def cell(variable: str, level, value):
        return F.struct(F.lit(variable).alias("variable"), level.cast("string").alias("level"),
                        value.cast("double").alias("value"), (level.isNull() & value.isNull()).alias("gap"))

    none = F.lit(None)
    cells = [cell(c, none, F.col(c)) for c in numeric]
    for c, levels in categorical.items():
        cells.append(cell(c, F.when(F.col(c).isin(*levels), F.col(c)), none))
    long = df.where(F.col(group).isin(*groups)).select(F.col(group).alias("group"), F.explode(F.array(*cells)).alias("c"))
    # Written because it is read three times below.
    counted = materialize(long.groupBy("group", "c.variable", "c.level").agg(
        F.count("*").alias("rows"),
        F.count_if("c.gap").alias("gaps"),
        F.avg("c.value").alias("mean"),
        F.stddev_samp("c.value").alias("sd"),
    ), "counts")
    # The full list of report lines, so that empty levels appear too.
    lines = [F.struct(F.lit(c).alias("variable"), none.cast("string").alias("level"), F.lit(0).alias("level_order"))
             for c in numeric]
    for c, levels in categorical.items():
        lines += [F.struct(F.lit(c).alias("variable"), F.lit(level).alias("level"), F.lit(i).alias("level_order"))
                  for i, level in enumerate(levels, 1)]
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(F.array(*lines)).alias("line"))
        .select("line.*", F.explode(F.array(*map(F.lit, groups))).alias("group"))
    )
    totals = counted.groupBy("variable", "group").agg(
        (F.sum("rows") - F.sum("gaps")).alias("n_known"), F.sum("gaps").alias("n_missing")
    )
    overall = counted.groupBy("variable").agg((F.sum("rows") - F.sum("gaps")).alias("n_overall"))
    numbers = F.col("level").isNull()
    zero = F.lit(0).cast("long")
    return (
        grid.join(
            counted.select("variable", F.col("level").alias("_level"), "group", "rows", "mean", "sd")
            .withColumnsRenamed({"variable": "_variable", "group": "_group"}),
            (F.col("variable") == F.col("_variable")) & (F.col("group") == F.col("_group"))
            & F.col("level").eqNullSafe(F.col("_level")),
            "left",
        )
        .join(totals, ["variable", "group"], "left")
        .join(overall, ["variable"], "left")
        .select(
            "variable", "level", "level_order", "group",
            F.coalesce(F.when(numbers, F.col("n_known")).otherwise(F.col("rows")), zero).alias("n"),
            F.when(~numbers, F.try_divide(100.0 * F.coalesce("rows", zero), "n_known")).alias("pct"),
            "mean", "sd",
            F.coalesce("n_missing", zero).alias("n_missing"),
            F.coalesce("n_overall", zero).alias("n_overall"),
        )
    )


def value_range(df: DataFrame, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value over two columns."""
    return df.groupBy(*by).agg(
        F.least(F.min(low), F.min(high)).alias("range_low"),
        F.greatest(F.max(low), F.max(high)).alias("range_high"),
    )


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column without bringing a column's values together.

    Approximate percentiles bracket the middle ranks, counts verify the bracket, and only the distinct
    values inside it are put in order, cut into ranges of which the ones holding the middle are read.
    """
    result: dict[str, float | None] = dict.fromkeys(columns)
    margin = 4.0 / MEDIAN_ACCURACY
    probe = df.agg(
        *[F.count(c).alias(f"{c}_n") for c in columns],
        *[F.percentile_approx(c, [0.5 - margin, 0.5 + margin], MEDIAN_ACCURACY).alias(f"{c}_cut") for c in columns],
    ).first()
    counts = {c: probe[f"{c}_n"] for c in columns if probe[f"{c}_n"]}
    columns, cuts = list(counts), {c: probe[f"{c}_cut"] for c in counts}
    if not columns:
        return result
    # Ranks of the middle value or values.
    middle = {c: ((counts[c] + 1) // 2, counts[c] // 2 + 1) for c in columns}
    tallies = df.agg(
        *[F.count_if(F.col(c) < cuts[c][0]).alias(f"{c}_below") for c in columns],
        *[F.count_if(F.col(c) <= cuts[c][1]).alias(f"{c}_upto") for c in columns],
    ).first()
    cells = []
    for c in columns:
        (first, last), (low, high) = middle[c], cuts[c]
        below = tallies[f"{c}_below"]
        if below < first and last <= tallies[f"{c}_upto"]:
            value, first, last = F.when(F.col(c).between(low, high), F.col(c)), first - below, last - below
        else:
            value = F.col(c)
        cells.append(F.struct(F.lit(c).alias("name"), F.lit(first).cast("long").alias("first"),
                              F.lit(last).cast("long").alias("last"), value.cast("double").alias("x")))
    scratch = Scratch(df.sparkSession, "median")
    values = scratch.write(
        df.select(F.explode(F.array(*cells)).alias("c")).where("c.x is not null")
        .groupBy("c.name", "c.first", "c.last", "c.x").agg(F.count("*").alias("n")), "values"
    )
    n_values = values.count()
    if n_values <= MEDIAN_BUCKET:
        ranked = values.withColumn("upto", F.sum("n").over(Window.partitionBy("name").orderBy("x")))
    else:
        ranked = _middle_ranges(range_buckets(values, ["name", "x"], n_values, scratch, "ranges", MEDIAN_BUCKET))
    for row in ranked.groupBy("name").agg(
        F.min(F.when(F.col("upto") >= F.col("first"), F.col("x"))).alias("a"),
        F.min(F.when(F.col("upto") >= F.col("last"), F.col("x"))).alias("b"),
    ).collect():
        result[row["name"]] = (row["a"] + row["b"]) / 2
    return result


def _middle_ranges(cut: DataFrame) -> DataFrame:
    """The value ranges that hold the ranks ``first`` to ``last``, with running counts."""
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    holding = (
        cut.groupBy("name", "first", "last", "bucket").agg(F.sum("n").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .where((F.col("before") < F.col("last")) & (F.col("before") + F.col("size") >= F.col("first")))
        .select("name", "bucket", "before")
    )
    within = Window.partitionBy("name", "bucket").orderBy("x")
    return join_small(cut, holding, ["name", "bucket"], "inner").withColumn(
        "upto", F.col("before") + F.sum("n").over(within)
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, numeric values, numeric share, median and standard deviation, in column order."""
    kinds = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in columns}
    not_a_number = F.lit(float("nan"))
    numeric = df.select(*[
        (F.nullif(F.col(c).cast("double"), not_a_number) if kinds[c] else to_numeric(c)).alias(c) for c in columns
    ])
    stats = numeric.agg(
        F.count("*").alias("_rows"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns],
    ).first()
    medians = exact_medians(numeric, columns)
    schema = T.StructType([
        T.StructField("column_name", T.StringType()), T.StructField("position", T.IntegerType()),
        T.StructField("is_number", T.BooleanType()), T.StructField("n_rows", T.LongType()),
        T.StructField("n_numeric", T.LongType()), T.StructField("numeric_share", T.DoubleType()),
        T.StructField("median", T.DoubleType()), T.StructField("sd", T.DoubleType()),
    ])
    rows = []
    for i, c in enumerate(columns, 1):
        n = stats[f"n_{c}"]
        share = n / stats["_rows"] if stats["_rows"] else None
        rows.append((c, i, kinds[c], stats["_rows"], n, share,
                     medians[c], stats[f"sd_{c}"]))
    return df.sparkSession.createDataFrame(rows, schema)


def plausibility(profile: DataFrame) -> DataFrame:
    """Score each profiled column: plausible median plus real spread; text with any non-number is out."""
    usable = F.col("is_number") | (F.col("n_numeric") == F.col("n_rows"))
    points = (
        F.coalesce(F.col("median").between(*AGE_RANGE).cast("int"), F.lit(0))
        + F.coalesce((F.col("sd") > AGE_MIN_SD).cast("int"), F.lit(0))
    )
    return profile.withColumn("points", F.when(usable & (F.col("n_numeric") > 0), points))


def pick_plausible_column(df: DataFrame, pattern: str = AGE_PATTERN) -> str | None:
    """The matching column that looks most like an age; the first one wins ties."""
    candidates = [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
    if not candidates:
        return None
    scored = plausibility(column_profile(df, candidates))
    best = scored.where(F.col("points") > 0).orderBy(F.desc("points"), "position").first()
    return best["column_name"] if best else None


def token_columns(df: DataFrame, pattern: str = SEX_PATTERN) -> DataFrame:
    """For each text column, whether any value matches the pattern; one pass over all columns."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    hits = df.agg(*[
        F.coalesce(F.max(F.lower(F.trim(c)).rlike(f"(?U){pattern}")), F.lit(False)).alias(c) for c in texts
    ])
    lines = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(c).alias("has_token"))
        for i, c in enumerate(texts, 1)
    ])
    return hits.select(F.explode(lines).alias("line")).select("line.*")


def find_column_by_token(df: DataFrame, pattern: str = SEX_PATTERN) -> str | None:
    """First text column holding a value that matches the pattern."""
    if not any(kind == "string" for _, kind in df.dtypes):
        return None
    hit = token_columns(df, pattern).where("has_token").orderBy("position").first()
    return hit["column_name"] if hit else None
