"""Fixed-effects regression from distributed sufficient statistics.

A model absorbs one large dimension (building, apartment, block by year) and some small ones (months, sizes, floors).
The large one is partialled out of the normal equations by sums per large group; what is left is a Gram matrix over
the levels of the small dimensions and the numeric columns, which partial aggregation keeps small. It is solved by
pseudo-inverse in one small group per model, so thousands of models (areas, windows) run in one job. Effects are
comparable within a connected component: report them relative to a base level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrain.functions.exprs import divided
from landgrain.operators.components import checkpointed, kept
from landgrain.operators.large_effects import solved_large

MOST = 5_000  # levels of all small dimensions together
PART = 100_000  # rows of a part that a task multiplies at once
SENT = 200_000  # numbers of a fit, and models, up to which they are sent to all rows, which then stay where they are


def labels(smalls: list[str]) -> list[Column]:
    """The level of each small dimension with the dimension's number in front."""
    return [F.concat(F.lit(f"{k}:"), F.col(d).cast("string")).alias(f"_d{k}") for k, d in enumerate(smalls)]


class Products:
    """The cross products of one model's features over rows that come in order of the large dimension, less what its means
    take off. Rows may come in any number of parts: of the unit that a part ends with, only the sums are held."""

    def __init__(self, columns: list[str], slopes: bool, most: int = MOST):
        self.names, self.slopes, self.most = [f"c:{c}" for c in columns], slopes, most
        self.codes = {x: k for k, x in enumerate(self.names)}
        self.total, self.held = np.zeros((len(self.names),) * 2), None

    def coded(self, levels: np.ndarray) -> np.ndarray:
        code, found = pd.factorize(levels)
        for x in found:
            if x not in self.codes:
                self.codes[x] = len(self.names)
                self.names.append(x)
        return np.array([self.codes[x] for x in found], int)[code]

    def add(self, unit: np.ndarray, w: np.ndarray, levels: list, values: list, t: np.ndarray | None, goes_on: bool) -> bool:
        """``unit``: numbers from 0, ascending; ``goes_on``: the first unit is the one that is held. False, and nothing is
        multiplied, where there are more levels than ``most``."""
        codes = [self.coded(x) for x in levels]
        n, m = len(self.names), len(values)
        if n - m > self.most:
            return False
        self.total = np.pad(self.total, (0, n - len(self.total)))
        if self.held is not None and not goes_on:
            self.take(*self.held)
            self.held = None
        at = np.arange(n)
        for a, i in enumerate(codes):
            self.total[at, at] += np.bincount(i, w, n)
            for j in codes[a + 1 :]:
                key, place = np.unique(i * n + j, return_inverse=True)
                v, i_, j_ = np.bincount(place, w), key // n, key % n
                self.total[i_, j_] += v
                self.total[j_, i_] += v
            for k, c in enumerate(values):
                v = np.bincount(i, w * c, n)
                self.total[k] += v
                self.total[:, k] += v
        for a, c in enumerate(values):
            for b in range(a, m):
                v = (w * c) @ values[b]
                self.total[a, b] += v
                self.total[b, a] += v * (a != b)
        units, step = int(unit[-1]) + 1, max(1, 4_000_000 // n)
        for lo in range(0, units, step):
            some = slice(*np.searchsorted(unit, (lo, lo + step)))
            u, size = unit[some] - lo, min(step, units - lo)
            sums = lambda w, u=u, size=size, some=some: np.column_stack([
                *(np.bincount(u, w * c[some], size) for c in values),
                sum((np.bincount(u * n + i[some], w, size * n) for i in codes), np.zeros(size * n)).reshape(size, n)[:, m:],
            ])
            one = lambda x, u=u, size=size: np.bincount(u, x, size)
            v = w[some]
            part = [sums(v), one(v)]
            part += [sums(v * t[some]), one(v * t[some]), one(v * t[some] ** 2)] if self.slopes else []
            if lo == 0 and self.held is not None:
                for x, y in zip(part, self.held):
                    x[0] += np.pad(y[0], (0, n - len(y[0]))) if x.ndim == 2 else y[0]
                self.held = None
            if lo + step >= units:
                self.held, part = [x[-1:].copy() for x in part], [x[:-1] for x in part]
            self.take(*part)
        return True

    def take(self, sums, weight, moved=None, time=None, squares=None) -> None:
        """Takes off what the means of whole units (rows of ``sums``) do and, with slopes, their own trends."""
        sums = np.pad(sums, ((0, 0), (0, len(self.names) - sums.shape[1])))
        there = weight > 0
        self.total -= sums[there].T @ (sums[there] / weight[there, None])
        if moved is None:
            return
        moved, sums = np.pad(moved, ((0, 0), (0, len(self.names) - moved.shape[1])))[there], sums[there]
        weight, time, squares = weight[there], time[there], squares[there]
        centred, spread = moved - sums * (time / weight)[:, None], squares - time * time / weight
        moves = spread > 1e-9 * np.abs(squares)
        self.total -= centred[moves].T @ (centred[moves] / spread[moves, None])

    def rows(self) -> pd.DataFrame:
        if self.held is not None:
            self.take(*self.held)
        order = np.argsort(np.array(self.names, object))
        total, names = self.total[np.ix_(order, order)], np.array(self.names, object)[order]
        i, j = np.nonzero(np.triu(total != 0) | np.eye(len(total), dtype=bool))  # every level once, whatever is left of it
        return pd.DataFrame({"i": names[i], "j": names[j], "v": total[i, j]})


def products(rows: DataFrame, group: list[str], n_dims: int, columns: list[str], most: int) -> DataFrame:
    """(group..., i, j, v) of ``gram``, to be added up: the rows lie together by unit and are gone through once. A part that finds
    more than ``most`` levels in a model gives it up with a row (NULL, NULL, levels)."""
    slopes, keys = "_t" in rows.columns, [*group, "_big"]
    names = ["_w", *(f"_d{k}" for k in range(n_dims)), *(f"_c{k}" for k in range(len(columns))), *(["_t"] if slopes else [])]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= PART:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if size:
            yield pd.concat(held, ignore_index=True)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model, last, given_up = None, None, None, False

        def done() -> pd.DataFrame:
            out = pd.DataFrame({"i": [None], "j": [None], "v": [float(len(model.names))]}) if given_up else model.rows()
            return out.assign(**dict(zip(group, now)))[[*group, "i", "j", "v"]]

        for part in parts(batches):
            if not len(part):
                continue
            code = np.column_stack([pd.factorize(part[k], use_na_sentinel=False)[0] for k in keys])
            new = np.r_[True, (code[1:] != code[:-1]).any(axis=1)]
            other = np.r_[True, (code[1:, :-1] != code[:-1, :-1]).any(axis=1)] if group else np.arange(len(part)) == 0
            ends = np.r_[np.flatnonzero(other), len(part)]
            columns_ = {c: part[c].to_numpy() for c in [*keys, *names]}
            for lo, hi in zip(ends[:-1], ends[1:]):
                tell = lambda r, c=columns_: tuple(None if pd.isna(c[k][r]) else c[k][r] for k in keys)
                first = tell(lo)
                if model is None or first[:-1] != now:
                    if model is not None:
                        yield done()
                    now, model, last, given_up = first[:-1], Products(columns, slopes, most), None, False
                if given_up:
                    continue
                of = lambda c, lo=lo, hi=hi, x=columns_: x[c][lo:hi]
                unit = np.cumsum(new[lo:hi]) - new[lo]
                values = [of(f"_c{k}") for k in range(len(columns))]
                given_up = not model.add(unit, of("_w"), [of(f"_d{k}") for k in range(n_dims)], values, of("_t") if slopes else None, first == last)
                last = tell(hi - 1)
        if model is not None:
            yield done()

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "i string, j string, v double"])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(multiply, schema)


def complete(df: DataFrame, columns: list[str], absorb: list[str], weight: str | None, group: list[str], slope: str | None = None) -> DataFrame:
    """The complete rows: group..., _big, _w, labels _d<k>, columns _c<k>, and _t where the large dimension has slopes."""
    big, *smalls = absorb
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    values = [F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(columns)]
    values += [F.col(slope).cast("double").alias("_t")] if slope else []
    rows = df.dropna(subset=[x for x in (*columns, *absorb, weight, slope) if x])
    return rows.select(*group, F.col(big).alias("_big"), w.alias("_w"), *labels(smalls), *values)


def gram(
    df: DataFrame, columns: list[str], absorb: list[str], weight: str | None = None, group: list[str] = (), slope: str | None = None, most: int = MOST
) -> DataFrame:
    """(group..., i, j, v), i before j: weighted cross products of all features, less those of the means of the large groups.

    ``absorb`` names the large dimension first. Rows that lack a column, level or weight are left out. The rows are made,
    shuffled and read once. Models of more than ``most`` levels have a row without i and j.
    """
    rows = products(complete(df, columns, absorb, weight, list(group), slope), list(group), len(absorb) - 1, columns, most)
    return rows.groupBy(*group, "i", "j").agg(F.sum("v").alias("v"))


def plain_moments(df: DataFrame, columns: list[str], big: str, weight: str | None, group: list[str], slope: str | None = None) -> DataFrame:
    """The moments of ``solved`` where one dimension alone is absorbed: sums per level, then per model, nothing to solve."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    value = lambda c: F.col(c).cast("double")
    rows = df.dropna(subset=[x for x in (*columns, big, weight, slope) if x])
    t = value(slope) if slope else F.lit(0.0)
    cells = [(a, b) for a in range(len(columns)) for b in range(a, len(columns))]
    per = rows.groupBy(*group, big).agg(
        F.sum(w).alias("_w"),
        *(F.sum(w * value(c)).alias(f"_s{k}") for k, c in enumerate(columns)),
        *(F.sum(w * value(columns[a]) * value(columns[b])).alias(f"_p{a}_{b}") for a, b in cells),
        F.sum(w * t).alias("_t"),
        F.sum(w * t * t).alias("_tt"),
        *(F.sum(w * t * value(c)).alias(f"_u{k}") for k, c in enumerate(columns)),
    )
    centred = lambda k: F.col(f"_u{k}") - F.col("_t") * F.col(f"_s{k}") / F.col("_w")
    spread = F.col("_tt") - F.col("_t") * F.col("_t") / F.col("_w")
    by_slope = lambda a, b: F.when(spread > 1e-9 * F.col("_tt"), centred(a) * centred(b) / spread).otherwise(0.0)
    within = lambda a, b: F.sum(F.col(f"_p{a}_{b}") - F.col(f"_s{a}") * F.col(f"_s{b}") / F.col("_w") - by_slope(a, b))
    sums = per.where("_w > 0").groupBy(*group).agg(*(within(a, b).alias(f"m{a}_{b}") for a, b in cells))
    cell = lambda a, b: F.struct(
        F.lit("moment").alias("kind"), F.lit(columns[a]).alias("a"), F.lit(columns[b]).alias("b"), F.col(f"m{min(a, b)}_{max(a, b)}").alias("value")
    )
    every = F.array(*(cell(a, b) for a in range(len(columns)) for b in range(len(columns))))
    out = sums.select(*group, F.explode(every).alias("m")).select(*group, "m.*").where("value is not null")
    return out.withColumn("component", F.lit(None).cast("string"))


def linked(near: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of truth values, the first row that it is linked with."""
    label = np.arange(len(near))
    while True:
        new = np.array([label[x].min() if x.any() else label[k] for k, x in enumerate(near)], int)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def too_many(products: DataFrame, group: list[str], most: int) -> bool:
    """Whether a model of ``gram`` was given up, or has more than ``most`` levels."""
    level = F.col("i").isNull() | ((F.col("i") == F.col("j")) & ~F.col("i").startswith("c:"))
    n = products.where(level).groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("i").isNull()).alias("gone"))
    return not n.where((F.col("n") > most) | (F.col("gone") > 0)).isEmpty()


def solved(
    df: DataFrame, columns: list[str], absorb: list[str], weight: str | None = None, group: list[str] = (), most: int = MOST,
    slope: str | None = None,
) -> DataFrame:
    """(group..., kind, a, b, value, component) per model: kind ``proj``: the effect of level a (``dimension:level``) on
    column b; kind ``moment``: the cross product of columns a and b with everything absorbed.

    Effects compare within a component alone: the levels of one dimension that units of the large one link. It is named
    by its first level. ``slope`` names a column whose coefficient is each large group's own (as a trend), absorbed jointly
    with the effects. With more than ``most`` levels in a model, all are solved by conjugate gradients.
    """
    group = list(group)
    if len(absorb) == 1:
        return plain_moments(df, columns, absorb[0], weight, group, slope)
    names = [f"c:{c}" for c in columns]
    rows = kept(gram(df, columns, absorb, weight, group, slope, most), "products")  # pairs of levels, read by all that asks for the fit
    if too_many(rows, group, most):
        if slope:
            raise ValueError(f"slopes need at most {most} levels")
        rows = kept(complete(df, columns, absorb, weight, group), "complete")
        return solved_large(rows, columns, len(absorb) - 1, group, plain_moments(df.dropna(subset=absorb), columns, absorb[0], weight, group))
    keys = group or ["_one"]
    rows = rows if group else rows.withColumn("_one", F.lit(1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = sorted({*pdf["i"], *pdf["j"], *names})
        at = {x: k for k, x in enumerate(labels)}
        small = [x for x in labels if not x.startswith("c:")]
        if len(small) > MOST:
            raise ValueError(f"{len(small)} levels of small dimensions; lower ``most``")
        g = np.zeros((len(labels), len(labels)))
        i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
        g[i, j] = g[j, i] = pdf["v"]
        s, c = [at[x] for x in small], [at[x] for x in names]
        proj = np.linalg.pinv(g[np.ix_(s, s)], rcond=1e-10, hermitian=True) @ g[np.ix_(s, c)] if s else np.zeros((0, len(c)))
        moment = g[np.ix_(c, c)] - g[np.ix_(c, s)] @ proj
        dims = np.array([x.split(":", 1)[0] for x in small])
        # Two levels of one dimension share no row, so only a common unit leaves something between them.
        comp = linked((g[np.ix_(s, s)] != 0) & (dims[:, None] == dims)) if s else []
        out = [("proj", x, n, proj[a, b], small[comp[a]]) for a, x in enumerate(small) for b, n in enumerate(columns)]
        out += [("moment", p, q, moment[a, b], None) for a, p in enumerate(columns) for b, q in enumerate(columns)]
        out = pd.DataFrame(out, columns=["kind", "a", "b", "value", "component"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "kind", "a", "b", "value", "component"]]

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kind string, a string, b string, value double, component string"
    out = rows.groupBy(*keys).applyInPandas(solve, schema)
    return out if group else out.drop("_one")


def level_effects(
    df: DataFrame, y: str, absorb: list[str], weight: str | None = None, group: list[str] = ()
) -> DataFrame:
    """(group..., dim, level, effect, component) of the small dimensions of ``absorb`` (the first one is the large one).
    Effects of one dimension compare within a component, which is named by one of its levels."""
    if len(absorb) == 2 and not group:
        n = df.agg(*(F.approx_count_distinct(d, 0.02).alias(f"n{k}") for k, d in enumerate(absorb))).first()
        if n["n1"] > max(MOST, n["n0"]):
            return turned_effects(df, y, absorb, weight)
    out = solved(df, [y], absorb, weight, group).where("kind = 'proj'")
    at = F.substring_index("a", ":", 1).cast("int")
    dims = F.array(*(F.lit(d) for d in absorb[1:]))
    level = lambda c: F.substr(c, F.length(F.substring_index("a", ":", 1)) + 2)
    return out.select(
        *group, F.get(dims, at).alias("dim"), level("a").alias("level"), F.col("value").alias("effect"), level("component").alias("component")
    )


def turned_effects(df: DataFrame, y: str, absorb: list[str], weight: str | None = None) -> DataFrame:
    """``level_effects`` of two dimensions where the small one has more levels than the large one: it is the one that is
    partialled out, and its effects are the means of what the other's leave. Neither side is broadcast."""
    big, small = absorb
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.dropna(subset=[x for x in (y, *absorb, weight) if x]).select(
        F.col(big).cast("string").alias("_big"), F.col(small).cast("string").alias("level"), F.col(y).cast("double").alias("_y"), w.alias("_w")
    )
    rows = kept(rows, "turned")  # gone through for the other dimension's effects and for these
    found = solved(rows, ["_y"], ["level", "_big"], "_w").where("kind = 'proj'")
    found = found.select(F.substr("a", F.lit(3)).alias("_big"), F.col("value").alias("_e"), F.col("component").alias("_c"))
    out = rows.join(found.hint("merge"), "_big").groupBy("level").agg(
        divided(F.sum(F.col("_w") * (F.col("_y") - F.col("_e"))), F.sum("_w")).alias("effect"), F.min("_c").alias("_c")
    )
    out = checkpointed(out.where("effect is not null"))
    named = out.groupBy("_c").agg(F.min("level").alias("component"))
    return out.join(named.hint("merge"), "_c").select(F.lit(small).alias("dim"), "level", "effect", "component")


def comparable(effects: DataFrame, keys: list[str], base: Column, out: str = "effect") -> DataFrame:
    """``effects`` of one dimension less their mean over the levels for which ``base`` holds, per key; NULL for levels
    that no unit links with those. Where the base lies in several components, the one with most of it counts, then the
    first; where no level is in the base, all levels are."""
    sizes = effects.groupBy(*keys, "component").agg(
        F.count_if(base).alias("_n"), F.count("*").alias("_all"), F.avg(F.when(base, F.col("effect"))).alias("_base"), F.avg("effect").alias("_mean")
    )
    order = F.struct(-F.col("_n"), -F.col("_all"), "component")
    pick = sizes.groupBy(*keys).agg(F.min_by(F.struct("component", F.coalesce("_base", "_mean").alias("_base")), order).alias("_pick"))
    pick = pick.select(*keys, F.col("_pick.component").alias("_component"), F.col("_pick._base").alias("_base"))
    joined = effects.join(pick, keys) if keys else effects.crossJoin(F.broadcast(pick))
    inside = F.col("component") == F.col("_component")
    return joined.withColumn(out, F.when(inside, F.col("effect") - F.col("_base"))).drop("_component", "_base")


def residualised(
    df: DataFrame, columns: list[str], absorb: list[str], weight: str | None = None, fit: DataFrame | None = None, group: list[str] = (),
    slope: str | None = None,
) -> DataFrame:
    """``df`` (complete rows) with r_<column>: each column less its projection on all absorbed dimensions, per ``group``."""
    (big, *smalls), group = absorb, list(group)
    fit = checkpointed(solved(df, columns, absorb, weight, group, slope=slope)) if fit is None else fit
    few = bool(smalls) and fit.count() <= SENT
    rows = df.dropna(subset=[x for x in (*columns, *absorb, weight, slope) if x])
    for c in columns:
        rows = rows.withColumn(f"r_{c}", F.col(c).cast("double"))
    for k, d in enumerate(smalls):
        part = fit.where((F.col("kind") == "proj") & F.col("a").startswith(f"{k}:"))
        part = part.groupBy(*group, F.substr("a", F.lit(len(str(k)) + 2)).alias("_level"))
        part = part.agg(*(F.sum(F.when(F.col("b") == c, F.col("value"))).alias(f"_p_{c}") for c in columns))
        rows = rows.withColumn("_level", F.col(d).cast("string")).join(F.broadcast(part) if few else part, [*group, "_level"]).drop("_level")
        for c in columns:
            rows = rows.withColumn(f"r_{c}", F.col(f"r_{c}") - F.col(f"_p_{c}")).drop(f"_p_{c}")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = lambda x: F.sum(w * x) / F.sum(w)
    t = F.col(slope).cast("double") if slope else F.lit(0.0)
    means = rows.groupBy(*group, big).agg(
        *(mean(F.col(f"r_{c}")).alias(f"_m_{c}") for c in columns),
        *(mean(F.col(f"r_{c}") * t).alias(f"_k_{c}") for c in columns),
        mean(t).alias("_t"),
        mean(t * t).alias("_tt"),
    )
    spread = F.col("_tt") - F.col("_t") * F.col("_t")
    by_slope = lambda c: F.when(spread > 1e-9 * F.col("_tt"), (F.col(f"_k_{c}") - F.col("_t") * F.col(f"_m_{c}")) / spread).otherwise(0.0)
    rows = rows.join(means, [*group, big])
    for c in columns:
        rows = rows.withColumn(f"r_{c}", F.col(f"r_{c}") - F.col(f"_m_{c}") - by_slope(c) * (t - F.col("_t")))
    return rows.drop("_t", "_tt", *(f"_{x}_{c}" for x in "mk" for c in columns))


def big_effects(df: DataFrame, y: str, absorb: list[str], weight: str | None = None) -> DataFrame:
    """(large dimension, effect, n): the effects of the large dimension, centred on their n-weighted mean."""
    big, *smalls = absorb
    rows = df.dropna(subset=[y, *absorb]).withColumn("_e", F.col(y).cast("double"))
    fit = level_effects(df, y, absorb, weight) if smalls else None
    for d in smalls:
        part = fit.where(F.col("dim") == d).select(F.col("level").alias("_level"), F.col("effect").alias("_x"))
        rows = rows.join(part, F.col(d).cast("string") == F.col("_level")).withColumn("_e", F.col("_e") - F.col("_x"))
        rows = rows.drop("_level", "_x")
    w = F.col(weight) if weight else F.lit(1.0)
    out = rows.groupBy(big).agg((F.sum(w * F.col("_e")) / F.sum(w)).alias("effect"), F.count("*").alias("n"))
    mean = out.agg((F.sum(F.col("effect") * F.col("n")) / F.sum("n")).alias("_mean"))
    return out.crossJoin(F.broadcast(mean)).select(big, (F.col("effect") - F.col("_mean")).alias("effect"), "n")


@dataclass
class Fit:
    """A regression: estimates, standard errors, sizes, R2; of each endogenous regressor the first stage's Wald F and the
    instruments' partial R2."""

    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    clusters: int
    r2_within: float
    first_stage_f: dict[str, float]
    partial_r2: dict[str, float]

    def table(self, df: DataFrame) -> DataFrame:
        rows = [
            (t, float(b), float(s), self.n, self.clusters, float(self.r2_within), self.first_stage_f.get(t))
            for t, b, s in zip(self.terms, self.beta, self.se)
        ]
        schema = "term string, beta double, se double, n long, clusters long, r2_within double, first_stage_f double"
        return df.sparkSession.createDataFrame(rows, schema)


def moments(fit: DataFrame, columns: list[str]) -> np.ndarray:
    """At most (columns)^2 numbers come to the driver."""
    at = {c: k for k, c in enumerate(columns)}
    out = np.zeros((len(columns), len(columns)))
    for r in fit.where("kind = 'moment'").collect():
        out[at[r["a"]], at[r["b"]]] = r["value"]
    return out


def meat(rows: DataFrame, scores: list[Column], cluster: str | None) -> tuple[np.ndarray, int, int]:
    """(sum over clusters of the outer products of summed scores, clusters, rows); without cluster, over rows."""
    named = [s.alias(f"s{k}") for k, s in enumerate(scores)]
    if cluster:
        sums = rows.groupBy(cluster).agg(*(F.sum(s).alias(f"s{k}") for k, s in enumerate(scores)), F.count("*").alias("n"))
    else:
        sums = rows.select(*named, F.lit(1).alias("n"))
    k = len(scores)
    cells = [F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)]
    got = sums.agg(F.count("*").alias("g"), F.sum("n").alias("n"), *cells).first()
    out = np.zeros((k, k))
    for a in range(k):
        for b in range(a, k):
            out[a, b] = out[b, a] = got[f"m{a}_{b}"] or 0.0
    return out, int(got["g"]), int(got["n"] or 0)


def fe_2sls(
    df: DataFrame,
    y: str,
    endogenous: list[str],
    instruments: list[str],
    exogenous: list[str],
    absorb: list[str],
    cluster: str | None = None,
    weight: str | None = None,
    small_sample: bool = False,
    slope: str | None = None,
) -> Fit:
    """2SLS with absorbed effects: residuals with the actual regressors, the sandwich with the fitted ones.

    Without ``endogenous`` this is OLS. ``small_sample`` adds (N - 1) / (N - K). ``slope``: as in ``solved``.
    """
    columns = list(dict.fromkeys([y, *endogenous, *exogenous, *instruments]))
    at = {c: k for k, c in enumerate(columns)}
    fit = checkpointed(solved(df, columns, absorb, weight, slope=slope))  # a few numbers, read again and again
    s = moments(fit, columns)
    x, z = [at[c] for c in [*endogenous, *exogenous]], [at[c] for c in [*instruments, *exogenous]]
    szz = np.linalg.pinv(s[np.ix_(z, z)], hermitian=True)
    first = szz @ s[np.ix_(z, x)]
    bread = np.linalg.pinv(s[np.ix_(x, z)] @ first, hermitian=True)
    beta = bread @ first.T @ s[z, 0]
    rows = residualised(df, columns, absorb, weight, fit, slope=slope)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    combo = lambda names, c: sum((F.lit(float(v)) * F.col(f"r_{n}") for n, v in zip(names, c)), F.lit(0.0))
    terms, zs = [*endogenous, *exogenous], [*instruments, *exogenous]
    error = F.col(f"r_{y}") - combo(terms, beta)
    fitted = [combo(zs, first[:, k]) for k in range(len(terms))]
    middle, clusters, n = meat(rows, [w * f * error for f in fitted], cluster)
    scale = clusters / max(clusters - 1, 1) if cluster else 1.0
    scale *= (n - 1) / max(n - len(terms), 1) if small_sample else 1.0
    covariance = bread @ middle @ bread * scale
    rss = s[0, 0] - 2 * beta @ s[x, 0] + beta @ s[np.ix_(x, x)] @ beta
    f, partial = {}, {}
    zx = [at[c] for c in exogenous]
    for k, e in enumerate(endogenous):
        without = s[at[e], zx] @ np.linalg.pinv(s[np.ix_(zx, zx)], hermitian=True) @ s[zx, at[e]] if zx else 0.0
        room = s[at[e], at[e]] - without
        partial[e] = float((s[at[e], z] @ szz @ s[z, at[e]] - without) / room) if room > 0 else 0.0
        pi = first[: len(instruments), k]
        left = F.col(f"r_{e}") - combo(zs, first[:, k])
        inner, g, _ = meat(rows, [w * F.col(f"r_{c}") * left for c in zs], cluster)
        v = szz @ inner @ szz * (g / max(g - 1, 1) if cluster else 1.0)
        q = len(instruments)
        f[e] = float(pi @ np.linalg.pinv(v[:q, :q]) @ pi / max(q, 1))
    return Fit(terms, beta, np.sqrt(np.maximum(np.diag(covariance), 0)), n, clusters, 1 - rss / s[0, 0] if s[0, 0] else 0.0, f, partial)


def fe_ols(
    df: DataFrame, y: str, xs: list[str], absorb: list[str], cluster: str | None = None, weight: str | None = None, **kw
) -> Fit:
    """OLS or WLS with absorbed effects; cluster-robust, or HC robust without ``cluster``."""
    return fe_2sls(df, y, [], [], xs, absorb, cluster, weight, **kw)


@dataclass(frozen=True)
class Model:
    """One regression of a batch: log price on ``endogenous`` (with ``instruments``) and ``exogenous``, with the levels of
    ``absorb`` (the large dimension first) and, with ``slope``, that column's own coefficient per level of the first.
    Without ``cluster`` errors are robust by row. ``where``: its rows."""

    name: str
    y: str
    exogenous: tuple[str, ...]
    absorb: tuple[str, ...]
    cluster: str | None = None
    weight: str | None = None
    endogenous: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    slope: str | None = None
    where: str | None = None

    @property
    def terms(self) -> list[str]:
        return [*self.endogenous, *self.exogenous]


def stacked(df: DataFrame, models: list[Model], keys: list[str] = ()) -> DataFrame:
    """Every row once per model that it belongs to, in columns that all models share: keys..., model, y, x<k>, z<k>, d<k>
    (levels), cl (cluster), w, t, q (number of instruments). What a model lacks is constant."""
    n_x, n_z, n_d = (max(f(m) for m in models) for f in (lambda m: len(m.terms), lambda m: len(m.instruments + m.exogenous), lambda m: len(m.absorb)))
    number = lambda c: F.col(c).cast("double") if c else F.lit(0.0)
    level = lambda c: F.col(c).cast("string") if c else F.lit("")
    pad = lambda names, n: [*names, *[None] * (n - len(names))]
    each = []
    for m in models:
        one = F.struct(
            F.lit(m.name).alias("model"), number(m.y).alias("y"),
            *(number(c).alias(f"x{k}") for k, c in enumerate(pad(m.terms, n_x))),
            *(number(c).alias(f"z{k}") for k, c in enumerate(pad(m.instruments + m.exogenous, n_z))),
            *(level(c).alias(f"d{k}") for k, c in enumerate(pad(m.absorb, n_d))),
            level(m.cluster).alias("cl"), (number(m.weight) if m.weight else F.lit(1.0)).alias("w"), number(m.slope).alias("t"), F.lit(len(m.instruments)).alias("q"),
        )
        each.append(F.when(F.expr(m.where), one) if m.where else one)
    return df.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("_m")).select(*keys, "_m.*")


def first_steps(moments: DataFrame, key: list[str], n_x: int, n_z: int) -> DataFrame:
    """Per model beta, the first stage and what the errors need, from its cross products: a few numbers each."""
    names = ["y", *(f"x{k}" for k in range(n_x)), *(f"z{k}" for k in range(n_z))]
    at = {c: k for k, c in enumerate(names)}
    x, z = range(1, 1 + n_x), range(1 + n_x, 1 + n_x + n_z)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros((len(names), len(names)))
        s[pdf["a"].map(at), pdf["b"].map(at)] = pdf["value"]
        szz = np.linalg.pinv(s[np.ix_(z, z)], rcond=1e-10, hermitian=True)
        first = szz @ s[np.ix_(z, x)]
        bread = np.linalg.pinv(s[np.ix_(x, z)] @ first, rcond=1e-10, hermitian=True)
        beta = bread @ first.T @ s[z, 0]
        rss = s[0, 0] - 2 * beta @ s[x, 0] + beta @ s[np.ix_(x, x)] @ beta
        out = {"beta": beta, "first": first.ravel(), "bread": bread.ravel(), "szz": szz.ravel(), "szx": s[list(z), 1], "xx": s[1, 1]}
        out["r2"] = 1 - rss / s[0, 0] if s[0, 0] > 0 else 0.0
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in key}, **out}])

    kinds = dict(moments.dtypes)
    arrays = ", ".join(f"{c} array<double>" for c in ("beta", "first", "bread", "szz", "szx"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", {arrays}, xx double, r2 double"
    return moments.where("kind = 'moment'").select(*key, "a", "b", "value").groupBy(*key).applyInPandas(solve, schema)


def centred(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """``rows`` with each column less its mean per model. Absorbed effects take up any constant, so no estimate changes, but
    cross products of columns that lie far from 0 would lose the digits that their residuals are told apart by."""
    means = checkpointed(rows.groupBy(*key).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns)))
    means = F.broadcast(means) if means.count() <= SENT else means
    less = {c: F.col(c) - F.col(f"_m_{c}") for c in columns}
    return rows.join(means, key).withColumns(less).drop(*(f"_m_{c}" for c in columns))


def fit_models(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys..., model, term, beta, se, se_hc, n, clusters, r2_within, first_stage_f, partial_r2) of all models in ``rows``
    (as ``stacked`` makes them); ``term`` is the place of the regressor. The number of jobs does not depend on the number
    of models: one set of cross products, one small solution per model, and one pass for the scores of all.

    ``se`` is by cluster, or by row where there is one cluster; ``se_hc`` is by row. The first stage is that of the first
    regressor, NULL without instruments.
    """
    key = [*keys, "model"]
    of = lambda p: sorted((c for c in rows.columns if c[0] == p and c[1:].isdigit()), key=lambda c: int(c[1:]))
    xs, zs, dims = of("x"), of("z"), of("d")
    n_x, n_z, columns = len(xs), len(zs), ["y", *xs, *zs]
    rows = centred(kept(rows.dropna(subset=[*columns, *dims, "w", "t"]).where("w > 0"), "stacked"), columns, key)
    fit = checkpointed(solved(rows, columns, dims, "w", key, slope="t"))
    steps = checkpointed(first_steps(fit, key, n_x, n_z))
    left = residualised(rows, columns, dims, "w", fit, key, "t").join(steps, key)
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    fitted = [sum((F.col(f"r_{z}") * at("first", j * n_x + k) for j, z in enumerate(zs)), F.lit(0.0)) for k in range(n_x)]
    error = F.col("r_y") - sum((at("beta", k) * F.col(f"r_{x}") for k, x in enumerate(xs)), F.lit(0.0))
    scores = [F.col("w") * f * error for f in fitted] + [F.col("w") * F.col(f"r_{z}") * (F.col("r_x0") - fitted[0]) for z in zs]
    m = n_x + n_z
    cells = [(a, b) for a in range(m) for b in range(a, m) if (a < n_x) == (b < n_x)]
    rows_too = [(a, b) for a, b in cells if a < n_x]
    named = left.select(*key, "cl", "q", *(s.alias(f"s{k}") for k, s in enumerate(scores)))
    by_cluster = named.groupBy(*key, "cl").agg(
        F.count("*").alias("n"), F.max("q").alias("q"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(m)),
        *(F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"h{a}_{b}") for a, b in rows_too),
    )
    sums = by_cluster.groupBy(*key).agg(
        F.sum("n").alias("n"), F.count("*").alias("clusters"), F.max("q").alias("q"),
        *(F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"m{a}_{b}") for a, b in cells),
        *(F.sum(f"h{a}_{b}").alias(f"h{a}_{b}") for a, b in rows_too),
    ).join(steps, key)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                def matrix(p, lo, hi, r=r):
                    v = np.zeros((hi - lo, hi - lo))
                    for a, b in cells:
                        if lo <= a and b < hi:
                            v[a - lo, b - lo] = v[b - lo, a - lo] = r[f"{p}{a}_{b}"]
                    return v

                bread, g, q = np.reshape(r["bread"], (n_x, n_x)), r["clusters"], int(r["q"])
                scale = g / (g - 1) if g > 1 else 1.0
                hc = np.sqrt(np.maximum(np.diag(bread @ matrix("h", 0, n_x) @ bread), 0))
                se = np.sqrt(np.maximum(np.diag(bread @ matrix("m", 0, n_x) @ bread) * scale, 0)) if g > 1 else hc
                f = partial = None
                if q:
                    szz, first = np.reshape(r["szz"], (n_z, n_z)), np.reshape(r["first"], (n_z, n_x))[:, 0]
                    v = (szz @ matrix("m", n_x, m) @ szz * scale)[:q, :q]
                    f = float(first[:q] @ np.linalg.pinv(v, hermitian=True) @ first[:q] / q) if g > 1 else None
                    rest, szx = np.linalg.pinv(szz, rcond=1e-10, hermitian=True)[q:, q:], np.array(r["szx"])
                    without = szx[q:] @ np.linalg.pinv(rest, rcond=1e-10, hermitian=True) @ szx[q:] if n_z > q else 0.0
                    partial = float((szx @ szz @ szx - without) / (r["xx"] - without)) if r["xx"] > without else 0.0
                for k in range(n_x):
                    if bread[k, k] > 0:
                        out.append([*(r[c] for c in key), k, r["beta"][k], se[k], hc[k], r["n"], g, r["r2"], f if k == 0 else None, partial if k == 0 else None])
            yield pd.DataFrame(out, columns=[*key, "term", "beta", "se", "se_hc", "n", "clusters", "r2_within", "first_stage_f", "partial_r2"])

    kinds = dict(sums.dtypes)
    fields = "term int, beta double, se double, se_hc double, n long, clusters long, r2_within double, first_stage_f double, partial_r2 double"
    return sums.mapInPandas(finish, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), fields]))


def fitted_models(df: DataFrame, models: list[Model], keys: list[str] = ()) -> DataFrame:
    """``fit_models`` over the rows of ``df`` with the regressors' names as ``term``."""
    out = fit_models(stacked(df, models, keys), keys)
    names = F.create_map(*(x for m in models for x in (F.lit(m.name), F.array(*(F.lit(t) for t in m.terms)))))
    return out.withColumn("term", F.get(F.element_at(names, F.col("model")), F.col("term"))).where("term is not null")


def pooled_ols(df: DataFrame, y: str, xs: list[str], **kw) -> Fit:
    """OLS with a constant and no effects."""
    return fe_ols(df.withColumn("_all", F.lit(0)), y, xs, ["_all"], **kw)


def grouped_ols(
    df: DataFrame, group: list[str], y: str, xs: list[str], absorb: str | None = None, weight: str | None = None
) -> DataFrame:
    """(group..., term, beta, n) for many regressions in one pass, each with at most one absorbed dimension.

    Rows shrink to one per group and absorbed level at once; each model is solved from its few sums.
    """
    columns = [y, *xs]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    value = lambda c: F.col(c).cast("double")
    cells = [(a, b) for a in range(len(columns)) for b in range(a, len(columns))]
    rows = df.dropna(subset=[*group, *columns, *([absorb] if absorb else []), *([weight] if weight else [])])
    keys = [*group, *([absorb] if absorb else [])]
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(w).alias("w"),
        *(F.sum(w * value(c)).alias(f"s{k}") for k, c in enumerate(columns)),
        *(F.sum(w * value(columns[a]) * value(columns[b])).alias(f"p{a}_{b}") for a, b in cells),
    )
    inner = [F.sum(F.col(f"p{a}_{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("w")).alias(f"p{a}_{b}") for a, b in cells]
    sums = per.groupBy(*group).agg(F.sum("n").alias("n"), *inner)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m = np.zeros((len(columns), len(columns)))
                for a, b in cells:
                    m[a, b] = m[b, a] = r[f"p{a}_{b}"]
                beta = np.linalg.pinv(m[1:, 1:], rcond=1e-10, hermitian=True) @ m[1:, 0]
                key = [r[g] for g in group]
                out += [(*key, t, float(v), int(r["n"])) for t, v in zip(xs, beta)]
            yield pd.DataFrame(out, columns=[*group, "term", "beta", "n"])

    kinds = dict(sums.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", term string, beta double, n long"
    return sums.mapInPandas(solve, schema)


def alternating(df: DataFrame, y: str, dims: list[str], rounds: int = 300, tol: float = 1e-9) -> tuple[DataFrame, float]:
    """The fallback for more levels than the exact solver takes: group means in turn, with a reliable checkpoint every
    round. Returns the rows with fe_<dim> and r_<y>, and the last round's largest change."""
    rows = df.dropna(subset=[y, *dims]).withColumn("_r", F.col(y).cast("double"))
    for d in dims:
        rows = rows.withColumn(f"fe_{d}", F.lit(0.0))
    change = float("inf")
    for _ in range(rounds):
        moved = []
        for d in dims:
            means = rows.groupBy(d).agg(F.avg("_r").alias("_m"))
            rows = rows.join(means, d).withColumn(f"fe_{d}", F.col(f"fe_{d}") + F.col("_m"))
            rows = rows.withColumn("_r", F.col("_r") - F.col("_m")).withColumnRenamed("_m", f"_m_{d}")
            moved.append(F.max(F.abs(f"_m_{d}")))
        rows = checkpointed(rows)
        change = max(x or 0.0 for x in rows.agg(*moved).first())
        rows = rows.drop(*(f"_m_{d}" for d in dims))
        if change < tol:
            break
    return rows.withColumnRenamed("_r", f"r_{y}"), change
