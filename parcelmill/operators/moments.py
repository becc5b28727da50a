"""Cross-product matrices per group and the linear models that need nothing else.

Rows are read once. Every task adds up its rows into one small matrix per group
(NumPy on Arrow batches); the matrices are summed by Spark, and models are solved
on one row per group. The number of terms bounds a matrix, not the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.operators.quantiles import attach

c = F.col
FLUSH_GROUPS = 2000


@dataclass(frozen=True)
class Shape:
    """Column order, shifts and scales of a cross-product matrix; travels to the tasks."""

    terms: tuple[str, ...]
    y: str
    shift: tuple[float, ...]
    scale: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.terms) + 2

    @property
    def position(self) -> dict[str, int]:
        return {x: i + 1 for i, x in enumerate(self.terms)}


@dataclass(frozen=True)
class Moments:
    """One row per group: n, null counts per term, and the flattened matrix `m`.

    Columns are standardized with common shifts and scales before the products,
    which keeps the matrices well conditioned; solvers undo it.
    """

    df: DataFrame
    group: tuple[str, ...]
    shape: Shape


def moments(
    df: DataFrame, group: Sequence[str], terms: Sequence[str], y: str, required: Sequence[str] | None = None, standardize: bool = True
) -> Moments:
    """Cross products of (1, terms, y) per group.

    Rows without y or without a required term (all terms by default) are left
    out; other missing values count as 0 and are reported in `nulls`.
    """
    terms, group = tuple(terms), tuple(group)
    required = terms if required is None else tuple(required)
    values = [*terms, y]
    kept = df.where(c(y).isNotNull()).select(*[c(g).cast("string").alias(g) for g in group], *[c(x).cast("double").alias(x) for x in values])
    if standardize:
        facts = kept.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(values) for n, f in (("a", F.avg), ("s", F.stddev_samp))]).first()
        shift = tuple(float(facts[f"a{i}"] or 0.0) for i in range(len(values)))
        scale = tuple(float(facts[f"s{i}"] or 0.0) or 1.0 for i in range(len(values)))
    else:
        shift, scale = (0.0,) * len(values), (1.0,) * len(values)
    p = len(values) + 1
    upper = np.triu_indices(p)
    need = [values.index(x) for x in required]
    keys = list(group)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, float(v[0]), float(v[1]), v[2].tolist(), v[3][upper].tolist()) for k, v in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=[*keys, "n", "dropped", "nulls", "m"])

        for pdf in batches:
            if not len(pdf):
                continue
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = part[values].to_numpy(float)
                bad = np.isnan(x)
                drop = bad[:, need].any(axis=1) if need else np.zeros(len(x), bool)
                x, bad = x[~drop], bad[~drop]
                z = np.where(bad, 0.0, (x - shift) / scale)
                z = np.column_stack([np.ones(len(z)), z])
                slot = sums.setdefault(key, [0, 0, np.zeros(len(values)), np.zeros((p, p))])
                slot[0] += len(z)
                slot[1] += int(drop.sum())
                slot[2] += bad.sum(axis=0)
                slot[3] += z.T @ z
            if len(sums) >= FLUSH_GROUPS:
                yield flush()
        if sums:
            yield flush()

    head = "".join(f"`{k}` string, " for k in keys)
    partial = kept.mapInPandas(add_up, head + "n double, dropped double, nulls array<double>, m array<double>")
    facts = F.concat(F.array("n", "dropped"), "nulls", "m")
    cells = partial.select(*keys, F.posexplode(facts).alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    rows = cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("a"))
    k = len(values)
    packed = rows.select(
        *keys, c("a")[0].cast("bigint").alias("n"), c("a")[1].cast("bigint").alias("dropped"),
        F.slice("a", 3, k).alias("nulls"), F.slice("a", 3 + k, p * (p + 1) // 2).alias("m"),
    )
    return Moments(packed, group, Shape(terms, y, shift, scale))


def _square(flat: Sequence[float], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = flat
    return m + np.triu(m, 1).T


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray  # constant first, in original units
    cov: np.ndarray  # inverse cross-product matrix in original units
    ssr: float
    sst: float
    n: int

    @property
    def k(self) -> int:
        return len(self.terms) + 1

    @property
    def aic(self) -> float:
        return self.n * (math.log(2 * math.pi) + math.log(max(self.ssr, 1e-300) / self.n) + 1) + 2 * self.k

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.sst if self.sst > 0 else float("nan")

    @property
    def adj_r2(self) -> float:
        left = self.n - self.k
        return 1 - (1 - self.r2) * (self.n - 1) / left if left > 0 else float("nan")


def solve(m: np.ndarray, n: int, shape: Shape, use: Sequence[str]) -> Fit:
    """Least squares of the last column on a constant and the used terms."""
    pos, shift, scale = shape.position, shape.shift, shape.scale
    idx = [0, *[pos[x] for x in use]]
    y = len(m) - 1
    xtx, xty = m[np.ix_(idx, idx)], m[idx, y]
    inv = np.linalg.pinv(xtx, rcond=1e-12, hermitian=True)
    b = inv @ xty
    ssr = max(float(m[y, y] - b @ xty), 0.0)
    sst = float(m[y, y] - m[0, y] ** 2 / n)
    sy, my = scale[-1], shift[-1]
    # z = T x maps original rows to standardized ones, so beta = sy * T'b (+ shift of y).
    t = np.eye(len(idx))
    for j, x in enumerate(use, 1):
        s, a = scale[pos[x] - 1], shift[pos[x] - 1]
        t[j, j] = 1 / s
        t[j, 0] = -a / s
    beta = sy * (t.T @ b)
    beta[0] += my
    return Fit(list(use), beta, t.T @ inv @ t, ssr * sy * sy, sst * sy * sy, n)


def per_group(mom: Moments, schema: str, f: Callable[[np.ndarray, int, int, dict[str, float]], list[tuple]]) -> DataFrame:
    """Apply a function to each group's matrix; it returns output rows without keys."""
    keys, p, names = list(mom.group), mom.shape.size, [*mom.shape.terms, mom.shape.y]
    types = {x.name: x.dataType.simpleString() for x in mom.df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                facts = dict(zip(names, row.nulls))
                for made in f(_square(row.m, p), int(row.n), int(row.dropped), facts):
                    out.append((*[getattr(row, k) for k in keys], *made))
            yield pd.DataFrame(out, columns=[x.split()[0].strip("`") for x in _fields(full)])

    full = "".join(f"`{k}` {types[k]}, " for k in keys) + schema
    return mom.df.mapInPandas(run, full)


def _fields(schema: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(schema):
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            parts.append(schema[last:i].strip())
            last = i + 1
    return [*parts, schema[last:].strip()]


COEFFICIENTS = "term string, beta double, beta_se double"


def ols(mom: Moments, use: Sequence[str] | None = None) -> DataFrame:
    """Coefficients with classic standard errors, one row per group and term."""
    shape = mom.shape
    use = list(shape.terms if use is None else use)

    def fit(m: np.ndarray, n: int, dropped: int, nulls: dict) -> list[tuple]:
        if n <= len(use) + 1:
            return []
        r = solve(m, n, shape, use)
        s2 = r.ssr / (n - r.k)
        return [
            (x, float(b), float(math.sqrt(max(s2 * v, 0.0))), n, r.r2, r.adj_r2, r.aic, r.ssr)
            for x, b, v in zip(["const", *use], r.beta, np.diag(r.cov))
        ]

    return per_group(mom, COEFFICIENTS + ", n bigint, r2 double, adj_r2 double, aic double, ssr double", fit)


def choose_terms(m: np.ndarray, n: int, shape: Shape, forced: Sequence[str], pool: Sequence[str], gain: float, steps: int | None) -> list[str]:
    """Forward choice: add the candidate that lowers AIC most, while it lowers it by more than `gain`."""
    chosen = list(forced)
    left = list(pool)
    best = solve(m, n, shape, chosen).aic
    taken = 0
    while left and (steps is None or taken < steps):
        scored = [(solve(m, n, shape, [*chosen, x]).aic, i) for i, x in enumerate(left)]
        found = None
        level = best
        for aic, i in scored:
            if aic < level - gain:
                level, found = aic, i
        if found is None:
            break
        chosen.append(left.pop(found))
        best = level
        taken += 1
    return chosen


def stepwise(
    mom: Moments, forced: Sequence[str] | dict[str, Sequence[str]], pool: Sequence[str], gain: float = 2.0,
    steps: int | None = None, tier: str | None = None,
) -> DataFrame:
    """Chosen terms per group in order of entry.

    Candidates need variation and no missing value. A missing value in a forced
    term stops the search with the forced list. `forced` may differ by tier.
    """
    shape = mom.shape
    pos = shape.position
    tier_at = list(mom.group).index(tier) if tier else None
    keys, p, names = list(mom.group), shape.size, [*shape.terms, shape.y]

    def choose(m: np.ndarray, n: int, dropped: int, nulls: dict, name: str | None) -> list[str]:
        must = list(forced.get(name, forced.get("ALL", ())) if isinstance(forced, dict) else forced)
        varied = [x for x in must if _varies(m, n, pos[x])]
        if dropped or n < 3:
            return varied
        cands = [x for x in pool if x not in must and nulls.get(x, 0) == 0 and _varies(m, n, pos[x])]
        return choose_terms(m, n, shape, varied, cands, gain, steps)

    types = {x.name: x.dataType.simpleString() for x in mom.df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = [getattr(row, k) for k in keys]
                got = choose(_square(row.m, p), int(row.n), int(row.dropped), dict(zip(names, row.nulls)), key[tier_at] if tier else None)
                out.append((*key, got, int(row.n)))
            yield pd.DataFrame(out, columns=[*keys, "terms", "n"])

    return mom.df.mapInPandas(run, "".join(f"`{k}` {types[k]}, " for k in keys) + "terms array<string>, n bigint")


def _varies(m: np.ndarray, n: int, i: int) -> bool:
    return bool(m[i, i] - m[0, i] ** 2 / max(n, 1) > 1e-10 * max(m[i, i], 1e-12))


def ols_chosen(mom: Moments, chosen: DataFrame, spare: int = 5) -> DataFrame:
    """Fit each group on its own chosen terms; groups with fewer than terms + `spare` rows have none."""
    shape = mom.shape
    keys, p = list(mom.group), shape.size
    types = {x.name: x.dataType.simpleString() for x in mom.df.schema.fields}
    both = attach(mom.df, chosen.select(*keys, "terms"), keys, "inner")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, "term", "beta", "beta_se", "n", "r2", "adj_r2", "aic", "ssr"]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                use, n = list(row.terms), int(row.n)
                if n < len(use) + spare:
                    continue
                r = solve(_square(row.m, p), n, shape, use)
                s2 = r.ssr / (n - r.k)
                for x, b, v in zip(["const", *use], r.beta, np.diag(r.cov)):
                    out.append((*[getattr(row, k) for k in keys], x, float(b), float(math.sqrt(max(s2 * v, 0.0))), n, r.r2, r.adj_r2, r.aic, r.ssr))
            yield pd.DataFrame(out, columns=columns)

    head = "".join(f"`{k}` {types[k]}, " for k in keys)
    return both.mapInPandas(run, head + COEFFICIENTS + ", n bigint, r2 double, adj_r2 double, aic double, ssr double")


def predict(df: DataFrame, coefficients: DataFrame, group: Sequence[str], terms: Sequence[str], y: str | None = None) -> DataFrame:
    """Rows with `pred_ln` (and `residual`) from their group's coefficients; groups without a fit drop out."""
    keys = list(group)
    named = ["const", *terms]
    wide = coefficients.groupBy(*keys).agg(*[F.max(F.when(c("term") == x, c("beta"))).alias(f"__b{i}") for i, x in enumerate(named)])
    joined = df.join(wide.select(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__b{i}" for i in range(len(named))]),
                     [c(k).cast("string").eqNullSafe(c(f"__k{i}")) for i, k in enumerate(keys)] or F.lit(True))
    value = c("__b0")
    for i, x in enumerate(terms, 1):
        value = value + F.when(c(f"__b{i}").isNull(), F.lit(0.0)).otherwise(c(f"__b{i}") * c(x).cast("double"))
    out = joined.withColumn("pred_ln", value).drop(*[f"__b{i}" for i in range(len(named))], *[f"__k{i}" for i in range(len(keys))])
    return out.withColumn("residual", c(y) - c("pred_ln")).where(c("residual").isNotNull()) if y else out


def hc3(df: DataFrame, mom: Moments, use: Sequence[str] | None = None, chosen: DataFrame | None = None, spare: int = 2) -> DataFrame:
    """Heteroskedasticity-robust (HC3) standard errors, one row per group and term.

    A second pass over the rows weighs each by its residual and leverage, which follow from
    the group's coefficients and inverse by column expressions. Groups with fewer than
    terms + `spare` rows have no errors; a NULL group is a group.
    """
    shape = mom.shape
    keys, terms, p = list(mom.group), list(shape.terms), shape.size
    one = F.array(*[F.lit(x) for x in (terms if use is None else use)])
    picked = mom.df.withColumn("terms", one) if chosen is None else attach(mom.df, chosen.select(*keys, "terms"), keys, "inner")
    at = {x: i for i, x in enumerate(["const", *terms])}
    size = len(at)

    def fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                used = list(row.terms)
                if int(row.n) < len(used) + spare:
                    continue
                r = solve(_square(row.m, p), int(row.n), shape, used)
                own = [at[x] for x in ["const", *used]]
                beta, cov, mark = np.zeros(size), np.zeros((size, size)), np.zeros(size, bool)
                beta[own], mark[own] = r.beta, True
                cov[np.ix_(own, own)] = r.cov
                out.append((*[getattr(row, q) for q in keys], used, beta.tolist(), cov.tolist(), mark.tolist()))
            yield pd.DataFrame(out, columns=[*keys, "used", "beta", "cov", "mark"])

    head = "".join(f"`{k}` string, " for k in keys)
    fits = picked.select(*keys, "n", "m", "terms").mapInPandas(fit_all, head + "used array<string>, beta array<double>, cov array<array<double>>, mark array<boolean>")
    rows = df.where(c(shape.y).isNotNull()).select(
        *[c(k).cast("string").alias(k) for k in keys], c(shape.y).cast("double").alias("__y"), F.array(F.lit(1.0), *[c(x).cast("double") for x in terms]).alias("raw"),
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = attach(rows, fits.select(*keys, "beta", "cov", "mark"), keys, "inner")
    lost = F.exists(F.zip_with("raw", "mark", lambda x, m: m & (x.isNull() | F.isnan(x))), lambda x: x)
    full = met.where(~lost).withColumn("x", F.zip_with("raw", "mark", lambda x, m: F.when(m, x).otherwise(0.0)))
    error = c("__y") - dot(c("x"), c("beta"))
    leverage = dot(c("x"), F.transform("cov", lambda row: dot(row, c("x"))))
    weighted = full.select(*keys, "x", F.pow(error / F.greatest(1 - leverage, F.lit(1e-8)), F.lit(2)).alias("w"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            for key, part in pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                x = np.stack(part["x"].to_numpy())
                sums[key] = sums.get(key, 0.0) + (x * part["w"].to_numpy()[:, None]).T @ x
            if len(sums) >= FLUSH_GROUPS:
                yield pd.DataFrame([(*k, v.ravel().tolist()) for k, v in sums.items()], columns=[*keys, "meat"])
                sums.clear()
        if sums:
            yield pd.DataFrame([(*k, v.ravel().tolist()) for k, v in sums.items()], columns=[*keys, "meat"])

    partial = weighted.mapInPandas(add_up, head + "meat array<double>")
    cells = partial.select(*keys, F.posexplode("meat").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    summed = cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("meat"))

    def sandwich(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.meat is None:
                    continue
                cov = np.array([list(r) for r in row.cov])
                v = cov @ np.asarray(row.meat, float).reshape(size, size) @ cov
                for x in ["const", *row.used]:
                    out.append((*[getattr(row, q) for q in keys], x, float(row.beta[at[x]]), float(math.sqrt(max(v[at[x], at[x]], 0.0)))))
            yield pd.DataFrame(out, columns=[*keys, "term", "beta", "beta_se"])

    return attach(fits, summed, keys, "inner").select(*keys, "used", "beta", "cov", "meat").mapInPandas(sandwich, head + COEFFICIENTS)


def vif_values(m: np.ndarray, n: int, idx: Sequence[int], centered: bool) -> np.ndarray:
    """Variance inflation factors of the columns `idx` from a cross-product matrix."""
    x = m[np.ix_(idx, idx)]
    if centered:
        mean = m[0, idx] / n
        x = x - n * np.outer(mean, mean)
    d = np.sqrt(np.clip(np.diag(x), 1e-300, None))
    r = x / np.outer(d, d)
    out = np.empty(len(r))
    for j in range(len(r)):
        rest = np.delete(np.arange(len(r)), j)
        fit = r[j, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-13, hermitian=True) @ r[rest, j]
        out[j] = 1.0 / (1.0 - fit) if fit < 1.0 - 1e-12 else np.inf
    return out


def vif(mom: Moments, use: Sequence[str] | None = None, centered: bool = True) -> DataFrame:
    """VIF per group and term; uncentered needs moments taken without standardizing."""
    use = list(mom.shape.terms if use is None else use)
    pos = mom.shape.position

    def table(m: np.ndarray, n: int, dropped: int, nulls: dict) -> list[tuple]:
        kept = [x for x in use if _varies(m, n, pos[x])] if centered else use
        return list(zip(kept, map(float, vif_values(m, n, [pos[x] for x in kept], centered)))) if kept else []

    return per_group(mom, "term string, vif double", table)


def vif_prune(mom: Moments, use: Sequence[str], protected: Sequence[str] = (), limit: float = 10.0) -> DataFrame:
    """Drop the worst unprotected term while one exceeds the limit (no intercept)."""
    pos = mom.shape.position

    def prune(m: np.ndarray, n: int, dropped: int, nulls: dict) -> list[tuple]:
        kept, gone = list(use), []
        while kept:
            values = vif_values(m, n, [pos[x] for x in kept], False)
            worst = sorted(((v, x) for v, x in zip(values, kept) if v > limit and x not in protected), reverse=True)
            if not worst:
                break
            kept.remove(worst[0][1])
            gone.append(worst[0][1])
        return [(kept, gone)]

    return per_group(mom, "kept array<string>, dropped_terms array<string>", prune)


# Term families and their preferences.
LAND_FAMILY = ("log_lot", "land_share", "log_land_value")
TIME_FAMILY = ("t", "area_time")
QUALITY_PAIR = ("area_quality", "area_condition")
TERRAIN_FAMILY = ("elev_log", "slope_log", "slope_sq", "aspect_sin", "aspect_cos")


def family_rules(terms: Sequence[str], t_values: dict[str, float], n: int) -> tuple[list[str], list[str]]:
    """One land term, one quality product, one time term by size, two terrain terms by |t|."""
    kept = list(terms)
    dropped: list[str] = []

    def drop(names: Sequence[str]) -> None:
        for x in names:
            if x in kept:
                kept.remove(x)
                dropped.append(x)

    land = [x for x in LAND_FAMILY if x in kept]
    drop(land[1:])
    if all(x in kept for x in QUALITY_PAIR):
        drop(QUALITY_PAIR[1:])
    if all(x in kept for x in TIME_FAMILY):
        drop(["t"] if n >= 1000 else ["area_time"])
    terrain = sorted((x for x in TERRAIN_FAMILY if x in kept), key=lambda x: -abs(t_values.get(x, 0.0)))
    drop(terrain[2:])
    return kept, dropped


def apply_family_rules(coefficients: DataFrame, group: Sequence[str]) -> DataFrame:
    """Kept and dropped terms per group; a group has some dozens of coefficient rows."""
    keys = list(group)
    t = F.try_divide(c("beta"), c("beta_se"))
    packed = coefficients.where(c("term") != "const").groupBy(*keys).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("term", F.coalesce(t, F.lit(0.0)).alias("t")))).alias("terms")
    )
    types = {x.name: x.dataType.simpleString() for x in packed.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                values = {e["term"]: float(e["t"]) for e in row.terms}
                kept, gone = family_rules(list(values), values, int(row.n))
                out.append((*[getattr(row, k) for k in keys], kept, gone))
            yield pd.DataFrame(out, columns=[*keys, "kept", "dropped_terms"])

    head = "".join(f"`{k}` {types[k]}, " for k in keys)
    return packed.mapInPandas(run, head + "kept array<string>, dropped_terms array<string>")


def ridge(mom: Moments, alpha: float, use: Sequence[str] | None = None) -> DataFrame:
    """Ridge coefficients with the penalty on every coefficient, the constant included.

    Needs moments taken without standardizing.
    """
    use = list(mom.shape.terms if use is None else use)
    pos = mom.shape.position
    idx = [0, *[pos[x] for x in use]]

    def fit(m: np.ndarray, n: int, dropped: int, nulls: dict) -> list[tuple]:
        xtx, xty = m[np.ix_(idx, idx)], m[idx, len(m) - 1]
        d = np.sqrt(np.clip(np.diag(xtx + alpha * np.eye(len(idx))), 1e-300, None))
        scaled = (xtx + alpha * np.eye(len(idx))) / np.outer(d, d)
        b = np.linalg.solve(scaled, xty / d) / d
        return [(x, float(v), n) for x, v in zip(["const", *use], b)]

    return per_group(mom, "term string, beta double, n bigint", fit)
