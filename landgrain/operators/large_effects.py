"""Fixed effects of more levels than a Gram matrix can hold: conjugate gradients over cells.

The rows shrink to cells, one per combination of the levels, and cells of one unit of the large dimension lie together
in chunks of whole units. The normal equations of the small dimensions, with the large one partialled out, are never
formed: a product with them is one pass over the chunks, in which each level's number is added up within units and the
partial sums of the levels are added across chunks. The vectors (a number per level and column) are on the driver,
which is bounded by ``MOST``; all models and all columns are solved together, each with steps of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrain.operators.components import checkpointed

MOST = 2_000_000  # levels whose vectors the driver holds
CHUNK = 200_000  # cells of a chunk; one unit is never cut
SENT = 500_000  # levels up to which their numbers are sent to all tasks, not shuffled


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def numbered_levels(rows: DataFrame, group: list[str], n_dims: int) -> pd.DataFrame:
    """(group..., label, code): all levels, sorted; the driver holds them, so they are counted first."""
    labels = F.array(*(f"_d{k}" for k in range(n_dims)))
    found = checkpointed(rows.select(*group, F.explode(labels).alias("label")).distinct())
    n = found.count()
    if n > MOST:
        raise ValueError(f"{n} levels; at most {MOST}")
    out = found.toPandas().sort_values([*group, "label"], ignore_index=True)
    return out.assign(code=np.arange(n))


def chunked(cells: DataFrame, group: list[str], n_dims: int, n_columns: int) -> DataFrame:
    """One row per chunk: ``starts`` of its units, weights, level codes and column sums of its cells, one after the other."""
    keys = [*group, "_big"]
    names = ["_w", *(f"_i{k}" for k in range(n_dims)), *(f"_s{k}" for k in range(n_columns))]

    def chunk(part: pd.DataFrame) -> pd.DataFrame:
        unit = part[keys].ne(part[keys].shift()) & ~(part[keys].isna() & part[keys].shift().isna())
        starts = np.flatnonzero(unit.any(axis=1).to_numpy() | (np.arange(len(part)) == 0))
        flat = {c: [part[c].to_numpy()] for c in names}
        return pd.DataFrame({"starts": [starts.astype(np.int64)], **flat})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < CHUNK:
                continue
            part = pd.concat(held, ignore_index=True)
            last = part.iloc[[-1]][keys]
            other = np.flatnonzero((part[keys].astype(str) != last.astype(str).iloc[0]).any(axis=1))
            cut = other[-1] + 1 if len(other) else 0  # the last unit may go on in the next batch
            if cut:
                yield chunk(part.iloc[:cut])
            held = [part.iloc[cut:]]
        held = pd.concat(held, ignore_index=True) if held else []
        if len(held):
            yield chunk(held)

    kinds = ["starts array<long>", "_w array<double>", *(f"_i{k} array<int>" for k in range(n_dims)), *(f"_s{k} array<double>" for k in range(n_columns))]
    parts = 1 + cells.count() // 1_000_000
    dealt = cells.repartition(parts, *keys).sortWithinPartitions(*keys)
    return checkpointed(dealt.mapInPandas(deal, ", ".join(kinds)))


class System:
    """The normal equations of the small dimensions' levels."""

    def __init__(self, chunks: DataFrame, n_dims: int, n_columns: int, levels: int):
        self.chunks, self.n_dims, self.n_columns, self.levels = chunks, n_dims, n_columns, levels
        self.sc = chunks.sparkSession.sparkContext

    def summed(self, width: int, of, how: str = "sum") -> np.ndarray:
        """(levels, width): per chunk, ``of(chunk)`` gives a list of (codes, values) that are added, or the least is taken."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for c in batch.to_dict("records"):
                    pairs = of(c)
                    code = np.concatenate([i for i, _ in pairs])
                    value = np.concatenate([v for _, v in pairs])
                    order = np.argsort(code, kind="stable")
                    code, value = code[order], value[order]
                    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                    value = (np.add if how == "sum" else np.minimum).reduceat(value, first, axis=0)
                    yield pd.DataFrame({"code": code[first], **{f"v{k}": value[:, k] for k in range(width)}})

        names = [f"v{k}" for k in range(width)]
        rows = self.chunks.mapInPandas(each, ", ".join(["code int", *(f"{x} double" for x in names)]))
        gather = F.sum if how == "sum" else F.min
        got = rows.groupBy("code").agg(*(gather(x).alias(x) for x in names)).toPandas()
        out = np.zeros((self.levels, width)) if how == "sum" else np.full((self.levels, width), np.inf)
        out[got["code"].to_numpy()] = got[names].to_numpy()
        return out

    def right_sides(self) -> tuple[np.ndarray, np.ndarray]:
        """(scale of each level, right-hand sides of the columns)."""
        dims, columns = range(self.n_dims), range(self.n_columns)

        def of(c):
            w, starts = c["_w"], c["starts"]
            unit = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(w)]))
            total = np.add.reduceat(w, starts)
            s = np.column_stack([c[f"_s{k}"] for k in columns])
            s = s - w[:, None] * (np.add.reduceat(s, starts, axis=0) / total[:, None])[unit]
            rest = w * (1 - w / total[unit])
            return [(c[f"_i{k}"], np.column_stack([w, rest, s])) for k in dims]

        got = self.summed(2 + self.n_columns, of)
        return np.where(got[:, 1] > 1e-9 * got[:, 0], got[:, 1], got[:, 0]), got[:, 2:]

    def product(self, p: np.ndarray) -> np.ndarray:
        """The matrix of the normal equations times ``p`` (levels, columns): one pass."""
        shared, dims = self.sc.broadcast(p), range(self.n_dims)  # at most MOST levels

        def of(c):
            p, w, starts = shared.value, c["_w"], c["starts"]
            u = w[:, None] * sum(p[c[f"_i{k}"]] for k in dims)
            mean = np.add.reduceat(u, starts, axis=0) / np.add.reduceat(w, starts)[:, None]
            u = u - w[:, None] * np.repeat(mean, np.diff(np.r_[starts, len(w)]), axis=0)
            return [(c[f"_i{k}"], u) for k in dims]

        out = self.summed(p.shape[1], of)
        shared.unpersist()
        return out

    def components(self) -> np.ndarray:
        """Per level the least code that it is linked with over shared units, each dimension by itself."""
        dims, label = range(self.n_dims), np.arange(self.levels, dtype=float)
        while True:
            shared = self.sc.broadcast(label)

            def of(c, shared=shared):
                sizes, out = np.diff(np.r_[c["starts"], len(c["_w"])]), []
                for k in dims:
                    least = np.minimum.reduceat(shared.value[c[f"_i{k}"]], c["starts"])
                    out.append((c[f"_i{k}"], np.repeat(least, sizes)[:, None]))
                return out

            new = np.minimum(label, self.summed(1, of, "min")[:, 0])
            # A level's new label is also one for the level that carried its old one.
            np.minimum.at(new, label.astype(np.int64), new.copy())
            while (new[new.astype(np.int64)] != new).any():
                new = new[new.astype(np.int64)]
            shared.unpersist()
            if (new == label).all():
                return label.astype(np.int64)
            label = new


def gradients(system: System, owner: np.ndarray, tol: float = 1e-13, rounds: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """(solutions, right-hand sides) of all columns; ``owner``: the model of each level. Preconditioned by the diagonal;
    every model and column has its own step and ends at its own residual."""
    scale, b = system.right_sides()
    models, n = int(owner.max()) + 1 if len(owner) else 0, b.shape[1]
    dot = lambda x, y: np.column_stack([np.bincount(owner, x[:, k] * y[:, k], models) for k in range(n)])
    x, r = np.zeros_like(b), b.copy()
    z = r / scale[:, None]
    p, rz, goal = z.copy(), dot(r, z), dot(b, b / scale[:, None]) * tol**2
    for _ in range(rounds):
        on = rz > goal
        if not on.any():
            break
        p *= on[owner]
        q = system.product(p)
        step = np.divide(rz, dot(p, q), out=np.zeros_like(rz), where=on & (dot(p, q) > 0))
        x += step[owner] * p
        r -= step[owner] * q
        z = r / scale[:, None]
        new = dot(r, z)
        p = z + np.divide(new, rz, out=np.zeros_like(rz), where=on)[owner] * p
        rz = np.where(on, new, 0.0)
    else:
        raise RuntimeError(f"no solution after {rounds} rounds")
    return x, b


def solved_large(rows: DataFrame, columns: list[str], n_dims: int, group: list[str], moments: DataFrame) -> DataFrame:
    """(group..., kind, a, b, value, component) as ``fixed_effects.solved`` gives them, for any number of levels up to
    ``MOST``. ``rows``: group..., _big, _w, _d<k> labels, _c<k> columns; ``moments``: those with the large dimension absorbed."""
    spark, dims = rows.sparkSession, range(n_dims)
    levels = numbered_levels(rows, group, n_dims)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "label string, code int"])
    codes = spark.createDataFrame(levels, schema)
    codes = F.broadcast(codes) if len(levels) <= SENT else codes
    w = F.col("_w")
    cells = rows.groupBy(*group, "_big", *(f"_d{k}" for k in dims)).agg(
        F.sum(w).alias("_w"), *(F.sum(w * F.col(f"_c{k}")).alias(f"_s{k}") for k in range(len(columns)))
    )
    for k in dims:
        named = codes.select(*(F.col(g).alias(f"_g{n}") for n, g in enumerate(group)), F.col("label").alias("_label"), F.col("code").alias(f"_i{k}"))
        on = [F.col(g).eqNullSafe(F.col(f"_g{n}")) for n, g in enumerate(group)] + [F.col(f"_d{k}") == F.col("_label")]
        cells = cells.join(named, reduce(lambda a, b: a & b, on)).drop("_label", *(f"_g{n}" for n in range(len(group))))
    system = System(chunked(cells.where("_w > 0"), group, n_dims, len(columns)), n_dims, len(columns), len(levels))
    owner = levels.groupby(group, dropna=False, sort=False).ngroup().to_numpy() if group else np.zeros(len(levels), int)
    x, b = gradients(system, owner)
    linked = levels["label"].to_numpy()[system.components()]
    proj = pd.concat(
        [levels[[*group]].assign(kind="proj", a=levels["label"], b=c, value=x[:, k], component=linked) for k, c in enumerate(columns)]
    )
    less = {(i, j): np.bincount(owner, b[:, i] * x[:, j]) for i in range(len(columns)) for j in range(len(columns))}
    names = levels[[*group]].assign(o=owner).drop_duplicates("o")
    taken = pd.concat([names[[*group]].assign(a=p, b=q, less=less[i, j][names["o"]]) for i, p in enumerate(columns) for j, q in enumerate(columns)])
    taken = spark.createDataFrame(taken, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "a string, b string, less double"]))
    taken = taken.toDF(*(f"_g{n}" for n in range(len(group))), "_a", "_b", "_less")
    on = [F.col(g).eqNullSafe(F.col(f"_g{n}")) for n, g in enumerate(group)] + [F.col("a") == F.col("_a"), F.col("b") == F.col("_b")]
    left = moments.join(taken, reduce(lambda a, b: a & b, on)).withColumn("value", F.col("value") - F.col("_less"))
    left = left.select(*group, "kind", "a", "b", "value", F.lit(None).cast("string").alias("component"))
    out = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "kind string, a string, b string, value double, component string"])
    return spark.createDataFrame(proj, out).unionByName(left)
