"""Price indices: raw, pooled and chained hedonic, unit effects, repeat sales; for every area and level in one pass."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrain.functions.exprs import divided
from landgrain.operators import selection
from landgrain.operators.components import checkpointed, kept
from landgrain.operators.fixed_effects import comparable, fe_ols, grouped_ols, level_effects, moments, solved
from landgrain.operators.relational import next_row, rebased, with_size


def deflated(df: DataFrame, value: str, month: str, prices: DataFrame, base: str, out: str) -> DataFrame:
    """ln of ``value`` over the price index (month, value) of its month, rebased to the mean of the base year."""
    mean = prices.where(F.col("month").startswith(base)).agg(F.avg("value").alias("_base"))
    index = prices.crossJoin(F.broadcast(mean)).select(F.col("month").alias(month), divided("value", "_base").alias("_cpi"))
    return df.join(index, month, "left").withColumn(out, F.ln(divided(value, "_cpi"))).drop("_cpi")


def filled_prices(prices: DataFrame, months: DataFrame) -> DataFrame:
    """The price index on a dense calendar (month), carried forward. The calendar is some hundred months."""
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.join(prices, "month", "left").select("month", F.last("value", True).over(w).alias("value"))


def as_index(effects: DataFrame, keys: list[str], period: str, base: Column) -> DataFrame:
    """100 exp(effect less its mean over the base periods), per key; over all periods where the base has none. NULL for
    periods that no unit links with the base."""
    out = comparable(effects, keys, base)
    return out.select(*keys, period, (100 * F.exp("effect")).alias("index"))


def raw_index(df: DataFrame, value: str, period: str, base: Column) -> DataFrame:
    """Median per period, base-year mean 100."""
    return rebased(selection.medians(df, [period], value, "value"), [], "value", base, "index").select(period, "index")


def fe_index(
    df: DataFrame, y: str, unit: str, period: str, controls: list[str], base: Column, group: list[str] = ()
) -> DataFrame:
    """Unit effect + period effect + control effects on y; the period effects as an index per group."""
    effects = level_effects(df, y, [unit, period, *controls], group=group)
    out = effects.where(F.col("dim") == period).withColumnRenamed("level", period).drop("dim")
    return as_index(out, list(group), period, base)


def repeat_sales_index(
    df: DataFrame, y: str, unit: str, period: str, controls: list[str], base: Column, group: list[str] = ()
) -> DataFrame:
    """``fe_index`` over units with two or more sales."""
    return fe_index(with_size(df, [*group, unit], 2), y, unit, period, controls, base, group)


def pooled_index(df: DataFrame, y: str, xs: list[str], area: str, period: str, base: Column) -> DataFrame:
    """Log price on attributes, area effects and period effects."""
    fit = fe_ols(df, y, xs, [area, period])
    less = F.col(y).cast("double")
    for term, beta in zip(fit.terms, fit.beta):
        less = less - float(beta) * F.col(term)
    rest = df.dropna(subset=[y, *xs, area, period]).withColumn("_rest", less)
    return fe_index(rest, "_rest", area, period, [], base)


def chained_index(
    df: DataFrame, y: str, xs: list[str], area: str, period: str, group: list[str] = (), least: int = 30
) -> DataFrame:
    """(group..., period number, change, index): for each pair of adjacent periods (numbers), a regression of y on the
    attributes and a dummy for the later one with area effects; the changes are chained from 100. A window of fewer
    than ``least`` rows carries the index on. Every row goes to its two windows, and all windows are solved together.
    """
    group = list(group)
    rows = df.withColumn("_w", F.explode(F.array(F.col(period), F.col(period) + 1)))
    rows = rows.withColumn("_late", (F.col(period) == F.col("_w")).cast("double"))
    rows = with_size(rows, [*group, "_w", area], 2)
    fit = grouped_ols(rows, [*group, "_w"], y, ["_late", *xs], area).where("term = '_late'")
    change = fit.select(*group, F.col("_w").alias(period), F.when(F.col("n") >= least, F.col("beta")).alias("change"))
    every = df.select(*group, period).distinct()
    w = Window.partitionBy(*group).orderBy(period)
    first = F.row_number().over(w) == 1
    out = every.join(change, [*group, period], "left")
    out = out.withColumn("change", F.when(first, 0.0).otherwise(F.coalesce("change", F.lit(0.0))))
    return out.withColumn("index", 100 * F.exp(F.sum("change").over(w)))


def with_levels(df: DataFrame, levels: list[str]) -> DataFrame:
    """Every row once per level of the hierarchy, with (tier, area)."""
    each = [F.struct(F.lit("all").alias("tier"), F.lit("all").alias("area"))]
    each += [F.struct(F.lit(x).alias("tier"), F.col(x).cast("string").alias("area")) for x in levels]
    return df.withColumn("_l", F.explode(F.array(*each))).select("*", "_l.*").drop("_l").where("area is not null")


def area_indices(
    df: DataFrame, y: str, unit: str, month: str, quarter: str, controls: list[str], levels: list[str], base: str,
    least: int = 3_000, monthly: int = 20_000,
) -> DataFrame:
    """(tier, area, period, index) for every area with ``least`` deals: monthly for large ones, quarterly below."""
    rows = with_size(with_levels(df, levels), ["tier", "area"], least)
    sizes = rows.groupBy("tier", "area").agg(F.count("*").alias("_n"))
    rows = rows.join(sizes, ["tier", "area"]).withColumn(
        "period", F.when(F.col("_n") >= monthly, F.col(month)).otherwise(F.col(quarter))
    )
    return fe_index(rows, y, unit, "period", controls, F.col("period").startswith(base), ["tier", "area"])


def pooled_indices(df: DataFrame, y: str, xs: list[str], unit: str, period: str, base: Column, group: list[str]) -> DataFrame:
    """(group..., period, index): ``pooled_index`` per group, all in one set of cross products. The period effects on y are
    less the attributes' coefficients times the period effects on them."""
    fit = checkpointed(solved(df, [y, *xs], [unit, period], group=group))
    pairs = fit.where("kind = 'moment'").groupBy(*group).agg(F.collect_list(F.struct("a", "b", "value")).alias("m"))  # (xs + 1)^2 numbers

    @F.pandas_udf("array<double>")
    def slopes(m: pd.Series) -> pd.Series:
        at = {c: k for k, c in enumerate([y, *xs])}

        def one(cells):
            s = np.zeros((len(at), len(at)))
            for c in cells:
                s[at[c["a"]], at[c["b"]]] = c["value"]
            return np.linalg.pinv(s[1:, 1:], rcond=1e-10, hermitian=True) @ s[1:, 0]

        return m.map(one)

    wide = fit.where("kind = 'proj'").groupBy(*group, F.substr("a", F.lit(3)).alias(period)).agg(
        F.first("component").alias("component"), *(F.max(F.when(F.col("b") == c, F.col("value"))).alias(f"_p{k}") for k, c in enumerate([y, *xs]))
    )
    less = sum((F.get("_b", F.lit(k)) * F.col(f"_p{k + 1}") for k in range(len(xs))), F.lit(0.0))
    effects = wide.join(pairs.select(*group, slopes("m").alias("_b")), group).withColumn("effect", F.col("_p0") - less)
    return as_index(effects, group, period, base)


def area_indices_all_kinds(
    df: DataFrame, y: str, ly: str, xs: list[str], unit: str, flat: str, block: str, month: str, quarter: str, year: str, controls: list[str],
    levels: list[str], base: str, least: int = 3_000, monthly: int = 20_000, repeats: int = 300,
) -> DataFrame:
    """(kind, tier, area, period, index) for every area with ``least`` rows: ``building`` (unit effects), ``repeat`` (flats
    sold again, at least ``repeats`` such sales), ``pooled`` (``ly`` on ``xs`` with block effects), ``chained`` (adjacent years); monthly
    for large areas and quarterly below, chained yearly. Rows are dealt to their areas once; each kind solves all areas
    together."""
    keys = ["tier", "area"]
    rows = with_size(with_levels(df, levels), keys, least)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    period = F.when(F.col("_n") >= monthly, F.col(month)).otherwise(F.col(quarter)).alias("period")
    needed = dict.fromkeys([*keys, unit, flat, block, year, y, ly, *xs, *controls])
    rows = kept(rows.join(sizes, keys).select(*needed, period), "areas")
    start = F.col("period").startswith(base)
    again = with_size(with_size(rows, [*keys, flat], 2), keys, repeats)
    chained = chained_index(rows, ly, xs, block, year, keys).select(*keys, F.col(year).cast("string").alias("period"), "index")
    kinds = {
        "building": fe_index(rows, y, unit, "period", controls, start, keys),
        "repeat": fe_index(again, y, flat, "period", controls, start, keys),
        "pooled": pooled_indices(rows, ly, xs, block, "period", start, keys),
        "chained": chained,
    }
    return reduce(DataFrame.unionByName, (v.withColumn("kind", F.lit(k)) for k, v in kinds.items()))


def compared(indices: DataFrame, keys: list[str], period: str, value: str, lags: tuple[int, ...] = (1, 12)) -> DataFrame:
    """Adds ln differences over dense periods."""
    w = Window.partitionBy(*keys).orderBy(period)
    for k in lags:
        indices = indices.withColumn(f"d{k}", F.ln(value) - F.ln(F.lag(value, k).over(w)))
    return indices


def comparison(indices: DataFrame, kind: str, period: str, value: str, first: str, second: str) -> DataFrame:
    """One row on two indices (rows of ``kind``): correlation of their changes over 1 and 12 periods, the spread of changes
    and of the gap, and each one's change from the first to the last period; all in logs."""
    both = compared(indices.withColumn("_ln", F.ln(value)), [kind], period, value)
    kinds, of = [first, second], ["_ln", "d1", "d12"]
    wide = both.groupBy(period).pivot(kind, kinds).agg(*(F.first(c).alias(c) for c in of))
    at = lambda k, c: F.col(f"{k}_{c}")
    change = lambda k: F.max_by(at(k, "_ln"), period) - F.min_by(at(k, "_ln"), period)
    return wide.agg(
        F.corr(at(first, "d1"), at(second, "d1")).alias("corr1"), F.corr(at(first, "d12"), at(second, "d12")).alias("corr12"),
        *(F.stddev(at(k, "d1")).alias(f"sd_{k}") for k in kinds), F.stddev(at(first, "_ln") - at(second, "_ln")).alias("sd_gap"),
        *(change(k).alias(f"change_{k}") for k in kinds),
    )


def drift(df: DataFrame, y: str, unit: str, period: str, group: list[str]) -> DataFrame:
    """(group..., period, drift): the period effects on y of the same unit, less the first period's; NULL for periods that
    no unit links with it."""
    e = level_effects(df, y, [unit, period], group=group).withColumnRenamed("level", period)
    first = e.groupBy(*group).agg(F.min_by(F.struct("effect", "component"), period).alias("_first"))
    drifted = F.when(F.col("component") == F.col("_first.component"), F.col("effect") - F.col("_first.effect"))
    out = e.join(first, group) if group else e.crossJoin(F.broadcast(first))
    return out.select(*group, period, drifted.alias("drift"))


def partialled_premium(df: DataFrame, y: str, binary: str, absorb: list[str]) -> DataFrame:
    """(slope, premium): what ``binary`` adds to y when the absorbed effects are taken off both sides."""
    m = moments(solved(df, [y, binary], absorb), [y, binary])
    slope = float(m[0, 1] / m[1, 1]) if m[1, 1] > 0 else None
    row = df.sparkSession.createDataFrame([(slope,)], "slope double")
    return row.withColumn("premium", F.exp("slope") - 1)


def returns(df: DataFrame, unit: str, date: str, order: list, real: str, area: str, tolerance: float = 0.05, least_years: float = 0.5) -> DataFrame:
    """Consecutive sales of a unit: years held, ln real change, annualised; area within ``tolerance``."""
    pairs = next_row(df, [unit], order, [date, real, area]).where(F.col(f"next_{date}").isNotNull())
    years = F.datediff(f"next_{date}", date) / 365.25
    out = pairs.where(F.abs(divided(f"next_{area}", area) - 1) <= tolerance)
    out = out.select("*", years.alias("years"), F.ln(divided(f"next_{real}", real)).alias("gain"))
    return out.where(F.col("years") >= least_years).withColumn("annual", F.exp(F.col("gain") / F.col("years")) - 1)


def returns_by_start(pairs: DataFrame, date: str, least: int = 500) -> DataFrame:
    """(start, n, annual, losses): of the pairs of ``returns``, per year of the first sale with at least ``least`` of them, the
    median annual return and the share that lost."""
    rows = pairs.withColumn("start", F.year(date))
    out = rows.groupBy("start").agg(F.count("*").alias("n"), F.avg((F.col("gain") < 0).cast("double")).alias("losses")).where(F.col("n") >= least)
    return out.join(selection.medians(rows, ["start"], "annual", "annual"), "start").select("start", "n", "annual", "losses")


def premiums(
    df: DataFrame, y: str, kind: str, base: str, unit: str, controls: list[str], group: list[str] = (), least: int = 1
) -> DataFrame:
    """(group..., kind, n, premium): exp(effect less the base level's) - 1 with unit and control effects; levels with
    fewer than ``least`` rows are left out."""
    group = list(group)
    e = level_effects(df, y, [unit, kind, *controls], group=group).where(F.col("dim") == kind)
    ref = e.where(F.col("level") == base).select(*group, F.col("effect").alias("_base"), F.col("component").alias("_c"))
    e = e.join(ref, group) if group else e.crossJoin(F.broadcast(ref))
    e = e.withColumn("_base", F.when(F.col("component") == F.col("_c"), F.col("_base")))  # else not comparable
    n = df.groupBy(*group, F.col(kind).cast("string").alias("level")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = e.join(n, [*group, "level"])
    return out.select(*group, F.col("level").alias(kind), "n", (F.exp(F.col("effect") - F.col("_base")) - 1).alias("premium"))
