"""Joins, aggregates, windows and set operations that go beyond one built-in call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrain.functions.exprs import binned, divided
from landgrain.operators import selection


# --- deduplication, modes and majorities -------------------------------------------------------------------------
def one_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def modal_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The most frequent combination of ``columns`` per key; ties go to the lowest. Counts come first, so that a hot
    key is one row per combination when it is compared."""
    counted = df.groupBy(key, *columns).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(*columns, "n"), F.struct((-F.col("n")).alias("m"), *columns))
    return counted.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def majority(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The value with the greatest total weight per key; ties go to the highest value."""
    sums = df.groupBy(key, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(key).agg(F.max_by(value, F.struct("w", value)).alias(value), F.max("w").alias("w"))


def largest(df: DataFrame, keys: list[str], k: int, least: int = 1) -> DataFrame:
    """(keys..., n): the k groups with the most rows, of those with at least ``least``; ties go to the lower key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), *keys).limit(k)


# --- joins -------------------------------------------------------------------------------------------------------
def match_one(left: DataFrame, right: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Left join with at most one match per key."""
    return left.join(one_per_key(right, keys, order), keys, "left")


def cascade(df: DataFrame, levels: list[tuple[DataFrame, list[str], str]], out: str, default=None) -> DataFrame:
    """The value of the first level that has one, and the level used (1, 2, ...; 0: the default).

    Each level is (table, keys, value column); without keys the table is one row, of several the one with the least value.
    """
    values = []
    for k, (table, keys, value) in enumerate(levels):
        name = f"_v{k}"
        values.append(name)
        part = table.select(*keys, F.col(value).alias(name))
        df = df.join(part, keys, "left") if keys else df.crossJoin(F.broadcast(part.agg(F.min(name).alias(name))))
    level = reduce(lambda w, kv: w.when(F.col(kv[1]).isNotNull(), kv[0] + 1), enumerate(values), F.when(F.lit(False), 0))
    df = df.withColumn(out, F.coalesce(*values, F.lit(default))).withColumn(f"{out}_level", level.otherwise(0))
    return df.drop(*values)


def lagged(left: DataFrame, right: DataFrame, keys: list[str], time: str, lag: int = 1) -> DataFrame:
    """``right`` as of ``lag`` periods before the rows of ``left``."""
    return left.join(right.withColumn(time, F.col(time) + lag), [*keys, time])


def in_period(df: DataFrame, periods: DataFrame, value: str) -> DataFrame:
    """Rows with the period (low, high, both inside) that holds the value. Spark broadcasts the periods if they are small."""
    return df.join(periods, F.col(value).between(F.col("low"), F.col("high")))


def contains_match(left: DataFrame, right: DataFrame, place: str, name: str, least: int = 3) -> DataFrame:
    """Names of a place matched exactly, and names without an exact match by containment either way.

    Both sides hold distinct (place, name); ``right`` brings its name as ``match``. What is left over on the left meets
    the names that share the first ``least`` letters of one somewhere inside the other, as contained names must.
    """
    right = right.select(place, F.col(name).alias("match"))
    exact = left.join(right.withColumn(name, F.col("match")), [place, name]).withColumn("how", F.lit("exact"))
    rest = left.join(right.withColumnRenamed("match", name), [place, name], "left_anti").where(F.char_length(name) >= least)
    right = right.where(F.char_length("match") >= least)
    first = lambda c: F.substring(c, 1, least)
    every = lambda c: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.char_length(c) - least + 1), lambda i: F.substr(F.col(c), i, F.lit(least)))
    )
    inner = rest.withColumn("_g", first(name)).join(right.select("*", F.explode(every("match")).alias("_g")), [place, "_g"])
    outer = rest.select("*", F.explode(every(name)).alias("_g")).join(right.withColumn("_g", first("match")), [place, "_g"])
    columns = [*left.columns, "match", "how"]
    inner = inner.where(F.contains(F.col("match"), F.col(name))).withColumn("how", F.lit("part"))
    outer = outer.where(F.contains(F.col(name), F.col("match"))).withColumn("how", F.lit("part"))
    return exact.select(columns).union(inner.select(columns).union(outer.select(columns)).distinct())


def ratio_match(left: DataFrame, right: DataFrame, keys: list[str], size: str, gate: float = 1.5) -> DataFrame:
    """Entities of two rounds on equal keys whose sizes are within the gate."""
    both = left.join(right.withColumnRenamed(size, f"{size}_b"), keys)
    return both.where((F.col(size) <= gate * F.col(f"{size}_b")) & (F.col(f"{size}_b") <= gate * F.col(size)))


def scenarios(df: DataFrame, **axes: list) -> DataFrame:
    """Every row under every combination of a few constants: exploded, not joined."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return df


# --- aggregates --------------------------------------------------------------------------------------------------
def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return divided(F.sum(F.when(v.isNotNull(), w * v)), F.sum(F.when(v.isNotNull(), w)))


def weighted_variance(value: str, weight: str) -> Column:
    """Analytic-weight variance: sum w (x - m)^2 / (sum w - sum w^2 / sum w), from sums."""
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight))
    s, sx, sxx, s2 = F.sum(w), F.sum(w * v), F.sum(w * v * v), F.sum(w * w)
    return divided(sxx - sx * sx / s, s - s2 / s)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which the cumulative weight reaches half. Equal values are summed first."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    upto = F.sum("w").over(w.orderBy(value))
    return sums.withColumn("u", upto).withColumn("all", F.sum("w").over(w)).where("2 * u >= all").groupBy(*keys).agg(
        F.min(value).alias(value)
    )


def levels_sum(df: DataFrame, levels: list[str], **sums: Column) -> DataFrame:
    """Sums for every level of a hierarchy and in total from one pass: (level, area, ...); ratios come last."""
    cells = df.groupBy(*levels).agg(*(c.alias(n) for n, c in sums.items()))
    each = [F.struct(F.lit("all").alias("level"), F.lit("all").alias("area"))]
    each += [F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("area")) for x in levels]
    long = cells.withColumn("_l", F.explode(F.array(*each))).where("_l.area is not null")
    return long.groupBy("_l.level", "_l.area").agg(*(F.sum(n).alias(n) for n in sums))


def histogram(df: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Counts per fixed bin, zero filled; values beyond the ends count in the end bins."""
    bins = len(edges) - 1
    inside = F.greatest(F.least(F.col(value), F.lit(edges[-1])), F.lit(edges[0]))
    at = F.coalesce(binned(inside, edges, list(range(bins)), "left"), F.lit(bins - 1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    return completed(counts, keys, "bin", list(range(bins)), n=0)


def completed(df: DataFrame, keys: list[str], axis: str, values: list, **fill) -> DataFrame:
    """Every key with every value of a fixed axis; missing measures are filled."""
    grid = df.select(*keys).distinct().withColumn(axis, F.explode(F.array(*(F.lit(v) for v in values))))
    out = grid.join(df, [*keys, axis], "left")
    return out.select(*(F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in df.columns))


def shares(df: DataFrame, keys: list[str], kind: str, kinds: list) -> DataFrame:
    """The share of each class of a fixed list in a key's rows, zero filled."""
    counts = df.where(F.col(kind).isin(kinds)).groupBy(*keys, kind).agg(F.count("*").alias("n"))
    out = completed(counts, keys, kind, kinds, n=0)
    return out.withColumn("share", divided("n", F.sum("n").over(Window.partitionBy(*keys))))


def entropy(df: DataFrame, keys: list[str], kind: str, kinds: int) -> DataFrame:
    """Normalised entropy of a key's classes: -sum p ln p / ln K."""
    counts = df.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    return weighted_entropy(counts, keys, "n", kinds)


def weighted_entropy(df: DataFrame, keys: list[str], weight: str, kinds: int) -> DataFrame:
    """-sum p ln p / ln K from one row per key and class: ln S - sum w ln w / S."""
    w = F.when(F.col(weight) > 0, F.col(weight))
    h = F.ln(F.sum(w)) - F.sum(w * F.ln(w)) / F.sum(w)
    return df.groupBy(*keys).agg((h / F.ln(F.lit(float(kinds)))).alias("entropy"))


def slope(x: str, y: str, weight: str) -> Column:
    """Weighted least-squares slope from sums."""
    a, b, w = F.col(x), F.col(y), F.col(weight)
    s, sx, sy = F.sum(w), F.sum(w * a), F.sum(w * b)
    return divided(s * F.sum(w * a * b) - sx * sy, s * F.sum(w * a * a) - sx * sx)


def agreement(df: DataFrame, keys: list[str], measure: str, truth: str) -> DataFrame:
    ratio = divided(measure, truth)
    return df.groupBy(*keys).agg(
        F.avg(ratio).alias("ratio"), F.avg(F.abs(ratio - 1)).alias("mape"), F.corr(measure, truth).alias("corr")
    )


def undocumented(published: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """Published variables without a dictionary entry: must be empty."""
    return published.select(name).distinct().join(dictionary.select(name), name, "left_anti")


def suppressed(count: str | Column, least: int, value: Column) -> Column:
    return F.when((F.col(count) if isinstance(count, str) else count) >= least, value)


# --- sets, orders and matrices -----------------------------------------------------------------------------------
def key_union(*tables: DataFrame) -> DataFrame:
    """The keys that any of the tables has."""
    return reduce(DataFrame.union, tables).distinct()


def key_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct keys of ``left`` that ``right`` lacks."""
    return left.subtract(right)


def in_all_classes(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(key): the keys that occur with every class of the table: an intersection over all classes."""
    kinds = df.agg(F.count_distinct(kind).alias("_k"))
    own = df.groupBy(key).agg(F.count_distinct(kind).alias("_n"))
    return own.join(F.broadcast(kinds), F.col("_n") == F.col("_k")).select(key)


def ordered_report(df: DataFrame, keys: list[str], least: int, *order) -> DataFrame:
    """(keys..., n): groups of at least ``least`` rows, in order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(*order)


def matrix(df: DataFrame, key: str, axis: str, values: list, cell: Column) -> DataFrame:
    """One row per key with a column per value of a fixed axis: the level by year matrix, complete."""
    return df.groupBy(key).pivot(axis, values).agg(cell)


def stacked(wide: DataFrame, key: str, axis: str, value: str) -> DataFrame:
    """The matrix as (key, axis, value), empty cells included."""
    return wide.unpivot(key, [c for c in wide.columns if c != key], axis, value)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for every pair of columns in one pass, each over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def stability(df: DataFrame, key: str, period: str, value: Column, lag: int = 1) -> DataFrame:
    """(period, corr): how a measure of the keys correlates with itself ``lag`` periods before."""
    cells = df.groupBy(key, period).agg(value.alias("_v"))
    before = cells.select(key, (F.col(period) + lag).alias(period), F.col("_v").alias("_u"))
    return cells.join(before, [key, period]).groupBy(period).agg(F.corr("_v", "_u").alias("corr"))


def labelled(df: DataFrame, name: str, override: dict[str, str], labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``label``: a fixed override, else the label table's, else the dictionary's (both: name, text)."""
    fixed = F.create_map(*(F.lit(x) for kv in override.items() for x in kv))
    out = df.join(labels.select(name, F.col("text").alias("_l")), name, "left").join(dictionary.select(name, F.col("text").alias("_d")), name, "left")
    return out.withColumn("label", F.coalesce(F.try_element_at(fixed, F.col(name)), "_l", "_d")).drop("_l", "_d")


def standardised(df: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """A weighted z-score over all rows: (x - mean) / sd with analytic weights."""
    m = df.agg(weighted_mean(value, weight).alias("_m"), F.sqrt(weighted_variance(value, weight)).alias("_s"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, divided(F.col(value) - F.col("_m"), "_s")).drop("_m", "_s")


def rank_bins(df: DataFrame, value: str, key: list[str], bins: int, out: str = "bin") -> DataFrame:
    """Rows in order of (value, key) split into ``bins`` parts whose sizes differ by one at most, as ``ntile`` does, but
    without one task for all rows or for one heaped value: ranges of the whole order are numbered by their counts."""
    rows, total = selection.ranked(df, [value, *key], "_at")
    short, extra = F.floor(total / bins), total % bins  # the first ``extra`` parts have one more
    large = extra * (short + 1)
    part = F.when(F.col("_at") < large, F.floor(F.col("_at") / (short + 1))).otherwise(extra + F.floor((F.col("_at") - large) / F.greatest(short, F.lit(1))))
    return rows.withColumn(out, part.cast("int")).drop("_all", "_at")


def rolled_up(df: DataFrame, keys: list[str], height: str, year: str, low: int, high: int, new: int) -> DataFrame:
    """Register rows per key: units, greatest height, median of the plausible years, share built from ``new`` on."""
    plausible = F.when(F.col(year).between(low, high), F.col(year))
    fresh = F.coalesce(F.col(year) >= new, F.lit(False)).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("units"), F.max(height).alias(height), F.median(plausible).alias(year), F.avg(fresh).alias("new_share"))


def places_of_boxes(df: DataFrame, keys: list[str], party: str, parties: dict[str, list], location: list[str]) -> DataFrame:
    """Boxes per place: valid votes, the votes of each list of parties, and the boxes' median location."""
    votes = [F.count_if(F.col(party).isin(names)).alias(c) for c, names in parties.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("valid"), *votes, *(F.median(c).alias(c) for c in location))


# --- windows -----------------------------------------------------------------------------------------------------
def with_size(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows: the sizes are aggregated and joined, so no group is one task."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(sizes, keys, "left_semi")


def next_row(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Each row with the next one of its key, as next_<column>."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))


def carried(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Carry-forward fill."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, True).over(w))


def calendar(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """(month): every month from the first to the last of the table, dense."""
    ends = df.agg(F.trunc(low, "month").alias("a"), F.trunc(high, "month").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d"))
    return days.select(F.date_format("d", "yyyy-MM").alias("month"))


def moving_mean(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Centred mean of three rows; the first and last row keep their own value."""
    w = Window.partitionBy(*keys).orderBy(order)
    full = F.count(value).over(w.rowsBetween(-1, 1)) == 3
    return df.withColumn(out, F.when(full, F.avg(value).over(w.rowsBetween(-1, 1))).otherwise(F.col(value)))


def rebased(df: DataFrame, keys: list[str], value: str, base: Column, out: str, scale: float = 100.0) -> DataFrame:
    """``value`` relative to its mean over the base rows of its key."""
    means = df.where(base).groupBy(*keys).agg(F.avg(value).alias("_base"))
    joined = df.join(means, keys, "left") if keys else df.crossJoin(F.broadcast(means))
    return joined.withColumn(out, scale * divided(value, "_base")).drop("_base")


def trimmed(df: DataFrame, keys: list[str], value: str, below: float = 0.2) -> DataFrame:
    """Rows that are not more than ``below`` under the median of their key (``value`` is a log): the median is an aggregate
    that is joined back."""
    medians = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    return df.join(medians, keys).where(F.col(value) > F.col("_m") + F.log1p(F.lit(-below))).drop("_m")


def relative_to_classes(df: DataFrame, time: str, kind: str, value: str, out: str) -> DataFrame:
    """Adds ``value`` less its mean over all classes at the time, rebased to 0 at each class's first time."""
    gap = F.col(value) - F.avg(value).over(Window.partitionBy(time))
    rows = df.withColumn("_g", gap)
    first = F.first("_g").over(Window.partitionBy(kind).orderBy(time))
    return rows.withColumn(out, F.col("_g") - first).drop("_g")


def balanced(df: DataFrame, keys: list[str], time: str, periods: int) -> DataFrame:
    """Keys that have all periods."""
    full = df.groupBy(*keys).agg(F.count_distinct(time).alias("_n")).where(F.col("_n") == periods).drop("_n")
    return df.join(full, keys, "left_semi")


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Value quantiles: ties stay together and equal edges are one; the edges are a fixed few numbers."""
    edges = selection.quantiles(df, [], value, [k / bins for k in range(bins + 1)], "e").first()
    if edges is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    inner = sorted(set(edges["e"]))[1:-1]
    at = reduce(lambda a, e: a + (F.col(value) > e).cast("int"), inner, F.lit(0))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), at))


def binned_scatter(df: DataFrame, x: str, y: str, weight: str, bins: int = 20, within: str | None = None) -> DataFrame:
    """(bin, n, x, y): weighted means by equal-count bins of x; with ``within``, of x and y less their weighted means in
    each of its groups."""
    if within:
        w = F.col(weight)
        rows = df.dropna(subset=[x, y, weight, within])
        means = rows.groupBy(within).agg(*((F.sum(w * F.col(c)) / F.sum(w)).alias(f"_m{k}") for k, c in enumerate((x, y))))
        df = rows.join(means, within).withColumns({c: F.col(c) - F.col(f"_m{k}") for k, c in enumerate((x, y))})
    return quantile_bins(df, x, bins).groupBy("bin").agg(
        F.count("*").alias("n"), weighted_mean(x, weight).alias("x"), weighted_mean(y, weight).alias("y")
    )


def between_share(df: DataFrame, group: str, y: str, weight: str) -> DataFrame:
    """R2 of group dummies alone: the weighted variance between groups by that of all, from grouped sums."""
    w, v = F.col(weight), F.col(y)
    cells = df.where(v.isNotNull()).groupBy(group).agg(
        F.sum(w).alias("s"), F.sum(w * v).alias("sy"), F.sum(w * v * v).alias("syy")
    )
    all_ = F.sum("sy") * F.sum("sy") / F.sum("s")
    return cells.agg(divided(F.sum(F.col("sy") * F.col("sy") / F.col("s")) - all_, F.sum("syy") - all_).alias("r2"))
