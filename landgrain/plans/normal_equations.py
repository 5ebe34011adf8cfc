"""SQL texts that solve the normal equations of the regressions in DuckDB, as the other side of the comparison.

``effects`` partials out one dimension, eliminates the levels of the others in a recursive step per level (Gauss-Jordan
on lists) and leaves CTEs with the projections, the cross products and the residuals; ``ols`` and ``iv`` add estimates
and clustered errors. Names of CTEs start with ``name``.
"""

from __future__ import annotations


def gauss(name: str, source: str, keys: list[str]) -> str:
    """CTE ``name``(keys, m): the rows of m (keys, m) in ``source`` after elimination of its len(m) first columns; a
    column without pivot is left out."""
    k = "".join(f"{x}, " for x in keys)
    return f"""
{name}_w AS (SELECT {k}1 AS k, m FROM {source} UNION ALL
  SELECT {k}k + 1, CASE WHEN m[k][k] < 1e-7 THEN m ELSE list_transform(m, lambda r, i: CASE
    WHEN i = k THEN list_transform(r, lambda x: x / m[k][k])
    ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) END
  FROM {name}_w WHERE k <= len(m)),
{name} AS (SELECT {k}m FROM {name}_w WHERE k = len(m) + 1)"""


def effects(name: str, source: str, big: str, dims: list[str], columns: list[str], keys: list[str] = (), weight: str = "1.0", slopes: list[tuple[str, str]] = ()) -> str:
    """``slopes``: (dimension, value) pairs, each level with a coefficient of its own on the value, numbered after ``dims``.

    CTEs: ``_r`` complete rows, ``_p``(keys, l, c, v) the effect of level l (number of the dimension ':' level) on
    column c, ``_mo``(keys, a, b, v) cross products of the residuals, ``_res`` rows with r_<column>."""
    keys = list(keys)
    k, using = "".join(f"{x}, " for x in keys), ", ".join(keys)
    on = lambda a, b: " AND ".join([f"{a}.{x} = {b}.{x}" for x in keys] or ["true"])
    of = lambda a: "".join(f"{a}.{x}, " for x in keys)
    needed = " AND ".join(f"{c} IS NOT NULL" for c in [big, *dims, *columns, *keys])
    effect = [*((d, "1.0") for d in dims), *((d, f"CAST({v} AS DOUBLE)") for d, v in slopes)]
    features = [(f"'{i}:' || CAST({d} AS VARCHAR)", v) for i, (d, v) in enumerate(effect)]
    features += [(f"'c:{c}'", f"CAST({c} AS DOUBLE)") for c in columns]
    pairs = ", ".join(f"{{i: {a}, j: {b}, v: _w * {x} * {y}}}" for a, x in features for b, y in features)
    each = ", ".join(f"{{l: {a}, v: _w * {x}}}" for a, x in features)
    out = f"""
{name}_r AS (SELECT *, CAST({weight} AS DOUBLE) AS _w FROM {source} WHERE {needed}),
{name}_own AS (SELECT {k}p.i AS i, p.j AS j, sum(p.v) AS v FROM (SELECT {k}unnest([{pairs}]) AS p FROM {name}_r) GROUP BY ALL),
{name}_f AS (SELECT {k}{big}, f.l AS l, sum(f.v) AS v FROM (SELECT {k}{big}, unnest([{each}]) AS f FROM {name}_r) GROUP BY ALL),
{name}_n AS (SELECT {k}{big}, sum(_w) AS w FROM {name}_r GROUP BY ALL),
{name}_mean AS (SELECT {of("a")}a.l AS i, b.l AS j, sum(a.v * b.v / s.w) AS v FROM {name}_f a JOIN {name}_f b USING ({k}{big}) JOIN {name}_n s USING ({k}{big}) GROUP BY ALL),
{name}_g AS (SELECT {k}i, j, sum(v) AS v FROM (SELECT {k}i, j, v FROM {name}_own UNION ALL SELECT {k}i, j, -v FROM {name}_mean) GROUP BY ALL)"""
    moment = f"SELECT {k}i, j, v FROM {name}_g WHERE i[:2] = 'c:' AND j[:2] = 'c:'"
    if effect:
        out += f""",
{name}_lab AS (SELECT DISTINCT {k}i AS l, i[:2] = 'c:' AS c FROM {name}_g),
{name}_dense AS (SELECT {of("a")}a.l AS i, list(coalesce(g.v, 0.0) ORDER BY b.c, b.l) AS r FROM {name}_lab a JOIN {name}_lab b ON {on("a", "b")}
  LEFT JOIN {name}_g g ON {on("a", "g")} AND g.i = a.l AND g.j = b.l WHERE NOT a.c GROUP BY {of("a")}a.l),
{name}_m0 AS (SELECT {k}list(r ORDER BY i) AS m FROM {name}_dense GROUP BY ALL),
{name}_names AS (SELECT {k}list(l ORDER BY l) AS names FROM {name}_lab WHERE NOT c GROUP BY ALL),
{gauss(f"{name}_s", f"{name}_m0", keys)},
{name}_x AS (SELECT {k}unnest(names) AS l, unnest(list_transform(m, lambda r, i: CASE WHEN abs(r[i] - 1) < 1e-6 THEN r[len(m) + 1 :] ELSE list_transform(r[len(m) + 1 :], lambda x: 0.0) END)) AS r
  FROM {name}_s JOIN {name}_names {f"USING ({using})" if keys else "ON true"}),
{name}_p AS (SELECT {k}l, unnest({sorted(columns)!r}) AS c, unnest(r) AS v FROM {name}_x),
{name}_mo AS (SELECT {k}i[3:] AS a, j[3:] AS b, sum(v) AS v FROM ({moment} UNION ALL
  SELECT {of("g")}g.i, 'c:' || p.c, -g.v * p.v FROM {name}_g g JOIN {name}_p p ON {on("g", "p")} AND g.j = p.l WHERE g.i[:2] = 'c:') GROUP BY ALL)"""
        wide = ", ".join(f"max(v) FILTER (WHERE c = '{c}') AS p_{c}" for c in columns)
        out += f""",
{name}_wide AS (SELECT {k}l, {wide} FROM {name}_p GROUP BY ALL)"""
    else:
        out += f""",
{name}_mo AS (SELECT {k}i[3:] AS a, j[3:] AS b, v FROM ({moment}))"""
    joins = " ".join(f"JOIN {name}_wide p{i} ON {on('r', f'p{i}')} AND p{i}.l = '{i}:' || CAST(r.{d} AS VARCHAR)" for i, (d, _) in enumerate(effect))
    less = lambda c: "".join(f" - p{i}.p_{c} * {v}" for i, (_, v) in enumerate(effect))
    raw = ", ".join(f"r.{c}{less(c)} AS q_{c}" for c in columns)
    part = f"PARTITION BY {k}{big}"
    res = ", ".join(f"q_{c} - sum(_w * q_{c}) OVER b / sum(_w) OVER b AS r_{c}" for c in columns)
    return out + f""",
{name}_q AS (SELECT r.*, {raw} FROM {name}_r r {joins}),
{name}_res AS (SELECT *, {res} FROM {name}_q WINDOW b AS ({part}))"""


def solve(name: str, moments: str, rows: list[str], right: list[str]) -> str:
    """CTEs ``name``_x(a, c, v): the solutions of the moments of ``rows`` for each right-hand column c, and the inverse in
    ``name``_inv(a, b, v)."""
    cell = lambda a, b: f"(SELECT coalesce(sum(v), 0.0) FROM {moments} WHERE a = '{a}' AND b = '{b}')"
    lines = [", ".join([*(cell(a, b) for b in [*rows, *right]), *("1.0" if a == b else "0.0" for b in rows)]) for a in rows]
    matrix = ", ".join(f"[{x}]" for x in lines)
    n, at = len(rows), [*rows, *right]
    names = ", ".join(f"'{x}'" for x in rows)
    out = f"""
{name}_m0 AS (SELECT [{matrix}] AS m),
{gauss(f"{name}_s", f"{name}_m0", [])},
{name}_rows AS (SELECT unnest([{names}]) AS a, unnest(m) AS r FROM {name}_s)"""
    xs = " UNION ALL ".join(f"SELECT a, '{c}' AS c, r[{n + 1 + i}] AS v FROM {name}_rows" for i, c in enumerate(right)) or f"SELECT a, '' AS c, 0.0 AS v FROM {name}_rows WHERE false"
    inv = " UNION ALL ".join(f"SELECT a, '{b}' AS b, r[{len(at) + 1 + i}] AS v FROM {name}_rows" for i, b in enumerate(rows))
    return out + f",\n{name}_x AS ({xs}),\n{name}_inv AS ({inv})"


def covariance(name: str, source: str, scores: dict[str, str], cluster: str | None, inverse: str) -> str:
    """``name``_cov(a, b, v) of estimates with bread ``inverse`` and the scores' sums by cluster, or by row."""
    sums = ", ".join((f"sum({e})" if cluster else e) + f" AS s_{k}" for k, e in scores.items())
    scale = " * count(*) / (count(*) - 1)" if cluster else ""
    parts = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum(s_{a} * s_{b}){scale} AS v FROM {name}_cl" for a in scores for b in scores)
    by = f" GROUP BY {cluster}" if cluster else ""
    return f"""
{name}_cl AS (SELECT {sums} FROM {source}{by}),
{name}_meat AS ({parts}),
{name}_cov AS (SELECT x.a AS a, z.b AS b, sum(x.v * y.v * z.v) AS v FROM {inverse} x JOIN {name}_meat y ON x.b = y.a JOIN {inverse} z ON y.b = z.a GROUP BY ALL)"""


def coefficient(table: str, a: str, c: str) -> str:
    return f"(SELECT max(v) FROM {table} WHERE a = '{a}' AND c = '{c}')"


def ols(name: str, source: str, y: str, xs: list[str], absorb: list[str], cluster: str | None, weight: str = "1.0", slopes: list[tuple[str, str]] = ()) -> str:
    """``name``_fit(term, beta, se) with absorbed effects (the large dimension first), clustered."""
    error = f"(r_{y}" + "".join(f" - r_{x} * b_{x}" for x in xs) + ")"
    betas = ", ".join(f"{coefficient(f'{name}_b_x', x, y)} AS b_{x}" for x in xs)
    return ",\n".join([
        effects(name, source, absorb[0], absorb[1:], list(dict.fromkeys([y, *xs])), weight=weight, slopes=slopes),
        solve(f"{name}_b", f"{name}_mo", xs, [y]),
        f"{name}_e AS (SELECT * FROM {name}_res, (SELECT {betas}))",
        covariance(name, f"{name}_e", {x: f"_w * r_{x} * {error}" for x in xs}, cluster, f"{name}_b_inv"),
        f"{name}_fit AS (SELECT x.a AS term, x.v AS beta, sqrt(c.v) AS se FROM {name}_b_x x JOIN {name}_cov c ON c.a = x.a AND c.b = x.a)",
    ])


def iv(name: str, source: str, y: str, x: str, zs: list[str], absorb: list[str], cluster: str) -> str:
    """``name``_fit(beta, se, f, partial): one endogenous regressor, with the first stage's clustered Wald F and partial R2."""
    first = [coefficient(f"{name}_z_x", z, x) for z in zs]
    fitted = "(" + " + ".join(f"r_{z} * pi_{z}" for z in zs) + ")"
    pis = ", ".join(f"{p} AS pi_{z}" for p, z in zip(first, zs))
    cross = lambda c: " + ".join(f"pi_{z} * (SELECT v FROM {name}_mo WHERE a = '{z}' AND b = '{c}')" for z in zs)
    left = f"(r_{x} - {fitted})"
    wald = " + ".join(f"pi_{z} * {coefficient(f'{name}_v_x', z, 'pi')}" for z in zs)
    return ",\n".join([
        effects(name, source, absorb[0], absorb[1:], list(dict.fromkeys([y, x, *zs]))),
        solve(f"{name}_z", f"{name}_mo", zs, [x, y]),
        f"{name}_pi AS (SELECT {pis})",
        f"{name}_beta AS (SELECT *, {cross(x)} AS xx, ({cross(y)}) / ({cross(x)}) AS beta FROM {name}_pi)",
        f"{name}_e AS (SELECT * FROM {name}_res, {name}_beta)",
        f"{name}_score AS (SELECT {cluster}, sum({fitted} * (r_{y} - beta * r_{x})) AS s FROM {name}_e GROUP BY {cluster})",
        covariance(f"{name}_first", f"{name}_e", {z: f"r_{z} * {left}" for z in zs}, cluster, f"{name}_z_inv"),
        f"{name}_vm AS (SELECT a, b, v FROM {name}_first_cov UNION ALL SELECT a, 'pi', v FROM {name}_z_x WHERE c = '{x}')",
        solve(f"{name}_v", f"{name}_vm", zs, ["pi"]),
        f"{name}_fit AS (SELECT beta, sqrt((SELECT sum(s * s) * count(*) / (count(*) - 1) FROM {name}_score)) / abs(xx) AS se, ({wald}) / {len(zs)} AS f, "
        f"xx / (SELECT v FROM {name}_mo WHERE a = '{x}' AND b = '{x}') AS partial FROM {name}_beta)",
    ])


def index(name: str, effect: str, source: str, period: str, base: str, keys: list[str] = ()) -> str:
    """CTE ``name``(keys, period, index) from rows (keys, l, effect): 100 exp(effect less its mean over the base periods)."""
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return (
        f"{name} AS (SELECT {k}{period}, 100 * exp(e - coalesce(avg(e) FILTER (WHERE {base}) OVER ({part}), avg(e) OVER ({part}))) AS index "
        f"FROM (SELECT {k}l[3:] AS {period}, {effect} AS e FROM {source} WHERE l[:2] = '0:'))"
    )
