"""Segmented price models: tiers, fits, publication, comparison and tuning."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.functions.cleaning import title_words
from parcelmill.operators import calibrate as cb
from parcelmill.operators import features as ft
from parcelmill.operators import moments as mo
from parcelmill.operators.quantiles import attach, group_quantiles
from parcelmill.operators.ratio import clipped_fit
from parcelmill.session import cut_lineage, stored

c = F.col
TIERS = ("T1_LOW", "T2_MID", "T3_HIGH")


def best_cuts(n: np.ndarray, total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The two cuts of least squared error between sorted cells, and the cells that could hold a better one.

    Cells have counts, sums and bounds of their values; cut k lies before cell k. The error
    falls as S1^2/n1 + S2^2/n2 + S3^2/n3 grows, which is convex in the counts and sums to the
    left of both cuts. A cut inside a cell has its count and sum in the triangle of the cell's
    two ends and the point where all of its lower values are `lo` and all others `hi`. So the
    corners of two triangles bound what cuts inside a pair of cells can reach.
    """
    center = total.sum() / n.sum()
    total, lo, hi = total - center * n, lo - center, hi - center
    cn, cs = np.append(0.0, np.cumsum(n)), np.append(0.0, np.cumsum(total))
    cs[-1] = 0.0
    wide = hi > lo
    low = np.where(wide, (hi * n - total) / np.where(wide, hi - lo, 1.0), n).clip(0, n)
    corners = [(cn[:-1], cs[:-1]), (cn[1:], cs[1:]), (cn[:-1] + low, cs[:-1] + low * lo)]

    def part(s: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.where(k > 0, s * s / np.where(k > 0, k, 1.0), 0.0)

    def reach(n1, s1, n2, s2):  # noqa: ANN001, ANN202
        return part(s1, n1)[:, None] + part(s2[None, :] - s1[:, None], n2[None, :] - n1[:, None]) + part(cs[-1] - s2, cn[-1] - n2)[None, :]

    cells, block = len(n), 256
    best, first, second = -1.0, 0, 0
    for at in range(0, cells + 1, block):
        rows = slice(at, at + block)
        found = reach(cn[rows], cs[rows], cn, cs)
        found[np.arange(cells + 1)[None, :] < np.arange(cells + 1)[rows, None]] = -1.0
        k = int(found.argmax())
        if found.flat[k] > best:
            best, first, second = float(found.flat[k]), at + k // (cells + 1), k % (cells + 1)
    open_cells = np.zeros(cells, bool)
    for at in range(0, cells, block):
        rows = slice(at, at + block)
        bound = np.max([reach(a[rows], b[rows], d, e) for a, b in corners for d, e in corners], axis=0)
        bound[np.arange(cells)[None, :] < np.arange(cells)[rows, None]] = -1.0
        may = bound >= best * (1 - 1e-12)
        open_cells[rows] |= may.any(axis=1)
        open_cells |= may.any(axis=0)
    return first, second, open_cells & wide


def _cut_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cuts and open cells of each group: the greatest values below the cuts and the codes to look into."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            n, s, lo, hi = (np.array([b[x] for b in row.cells], float) for x in ("n", "s", "lo", "hi"))
            first, second, opened = best_cuts(n, s, lo, hi)
            ends = [float(hi[k - 1]) if k else None for k in (first, second)]
            out.append((*[getattr(row, k) for k in keys], *ends, [b["code"] for b, o in zip(row.cells, opened) if o]))
        yield pd.DataFrame(out, columns=[*keys, "t0", "t1", "opened"])


def three_means(df: DataFrame, group: Sequence[str], value: str, bins: int = 256, split: int = 64, levels: int = 4) -> DataFrame:
    """One-dimensional 3-means of least squared error per group; adds `cluster` 0, 1, 2 by value.

    The best two cuts are sought over cells of each group's sorted values: `bins` equal steps
    first, then only cells that could hold a better cut (`best_cuts`) are cut into `split` steps
    each, `levels` in all. Nothing is iterated to convergence and nothing passes through the
    driver: every level is one aggregate and one row of cells per group, in one plan. Values
    that `bins * split ** (levels - 1)` steps of a group's range don't tell apart stay together;
    up to that the split is the best one. Groups of one or two distinct values use as many
    clusters. Rows without a value are left out; runs repeat exactly.
    """
    keys = list(group)
    counted = df.where(c(value).isNotNull()).groupBy(*keys, c(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    points = cut_lineage(counted)  # read by every level
    spread = points.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "t0 double, t1 double, opened array<bigint>"
    place = F.when(c("__hi") > c("__lo"), (c("__v") - c("__lo")) / (c("__hi") - c("__lo"))).otherwise(F.lit(0.0))

    def code(steps: int) -> Column:
        return F.least(F.floor(place * steps), F.lit(steps - 1)).cast("bigint")

    coded = attach(points, spread, keys, "inner").withColumn("code", code(bins))
    steps = bins
    for level in range(levels):
        sums = coded.groupBy(*keys, "code").agg(
            F.sum("__n").alias("n"), F.sum(c("__v") * c("__n")).alias("s"), F.min("__v").alias("lo"), F.max("__v").alias("hi")
        )
        packed = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("code", "n", "s", "lo", "hi"))).alias("cells"))
        cuts = cut_lineage(packed.mapInPandas(lambda batches: _cut_groups(batches, keys), schema))
        if level + 1 < levels:
            steps *= split
            # A value of a cell that stays whole keeps the code of the cell's first step.
            finer = F.when(F.array_contains("opened", c("code")), code(steps)).otherwise(c("code") * split)
            coded = attach(coded, cuts.select(*keys, "opened"), keys, "inner").withColumn("code", finer).drop("opened")
    cluster = F.when(c("t0").isNotNull() & (c(value) <= c("t0")), 0).when(c("t1").isNotNull() & (c(value) <= c("t1")), 1).otherwise(2)
    return attach(df.where(c(value).isNotNull()), cuts.drop("opened"), keys, "inner").withColumn("cluster", cluster).drop("t0", "t1")


def price_tiers(df: DataFrame, group: str, terms: Sequence[str], min_group: int = fv.MIN_GROUP_TIERING) -> DataFrame:
    """T1_LOW / T2_MID / T3_HIGH by predicted price in groups large enough, else ALL."""
    sized = attach(df, df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), [group])
    big = sized.where(c("__n") >= max(min_group, fv.MIN_ROWS_TIERING)).drop("__n")
    small = sized.where(c("__n") < max(min_group, fv.MIN_ROWS_TIERING)).drop("__n").withColumn("value_tier", F.lit("ALL"))
    filled = big.select("sale_id", group, "log_price", *[F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(x) for x in terms])
    fit = mo.ols(mo.moments(filled, [group], terms, "log_price"))
    scored = mo.predict(filled, fit, [group], terms).select("sale_id", group, "pred_ln")
    labeled = three_means(scored, [group], "pred_ln").select(
        "sale_id", F.element_at(F.array(*[F.lit(x) for x in TIERS]), c("cluster") + 1).alias("value_tier"),
        F.exp("pred_ln").alias("pred_price"),
    )
    return big.join(labeled, "sale_id").unionByName(small, allowMissingColumns=True)


def tier_bands(tiered: DataFrame, group: str) -> DataFrame:
    """Row count and 5-95 % band of the predicted price per tier."""
    kept = tiered.where(c("pred_price").isNotNull())
    bands = group_quantiles(kept, [group, "value_tier"], "pred_price", {"price_min": 0.05, "price_max": 0.95})
    return attach(kept.groupBy(group, "value_tier").agg(F.count(F.lit(1)).alias("count")), bands, [group, "value_tier"])


def run_model(
    sales: DataFrame, group: str = "valuation_area", profile: str = "baseline", bundle: str = "standard",
    anchor: str = fv.ANCHOR_DATE, reference_year: int = fv.REFERENCE_YEAR, min_group: int = fv.MIN_GROUP_TIERING,
) -> dict[str, DataFrame]:
    """Features, tiers, trim, term choice, robust fit, calibration and diagnostics of every segment."""
    rows = ft.features(sales, anchor, reference_year)
    rows, _report = ft.interactions(rows, [x for x in fv.INTERACTION_BUNDLES[bundle] if x not in rows.columns])
    rows = cut_lineage(rows)  # read by tiering, the trim and the calibration
    names = ft.predictors(rows.columns, profile, bundle)
    tiering = list(dict.fromkeys([*names["core"], *[x for x in fv.TIERING_EXTRA_TERMS if x in rows.columns]]))
    rows = cut_lineage(price_tiers(rows, group, tiering, min_group))
    keys = [group, "value_tier"]

    def large(df: DataFrame) -> DataFrame:
        return attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys).where(c("__n") >= fv.MIN_ROWS_FIT).drop("__n")

    # Segments must be large enough before and after the trim.
    trimmed = stored(large(ft.tier_trim(large(rows), [group])), "trimmed")  # a table keeps no constraints, a checkpoint does
    shaped, forced = ft.tier_terms(trimmed, names["core"])
    every = list(dict.fromkeys([*[x for v in forced.values() for x in v], *names["candidates"]]))
    mom = mo.moments(shaped, keys, every, "log_price", required=names["core"])
    mom = mo.Moments(cut_lineage(mom.df), mom.group, mom.shape)
    chosen = cut_lineage(mo.stepwise(mom, forced, names["candidates"], tier="value_tier"))
    fit = cut_lineage(mo.ols_chosen(mom, chosen))
    robust = mo.hc3(shaped, mom, chosen=chosen, spare=5)
    fitted = mo.predict(shaped, fit, keys, every, "log_price")
    values = cb.prb_flatten(cb.band_calibration(cb.retransform(fitted, keys), keys), keys)
    return {"tiers": rows, "chosen": chosen, "fit": fit, "coefficients": robust, "values": values}


def publish(coefficients: DataFrame, run_id: str, created_at: dt.datetime, mode: str = "publish") -> DataFrame:
    """Long coefficient rows of a run; dry runs and experiments add nothing to the main table."""
    rows = coefficients.withColumn("run_id", F.lit(run_id)).withColumn("created_at", F.lit(created_at))
    return rows if mode == "publish" else rows.where(F.lit(False))


def compare_runs(stats: DataFrame, first: str, second: str, keys: Sequence[str] = ("market_group", "value_tier"), columns: Sequence[str] = ("cod", "prd", "prb", "r2", "n")) -> DataFrame:
    """Two runs side by side with the difference of each measure."""
    a = stats.where(c("run_id") == first).select(*keys, *[c(x).alias(f"{x}_1") for x in columns])
    b = stats.where(c("run_id") == second).select(*keys, *[c(x).alias(f"{x}_2") for x in columns])
    return a.join(b, list(keys), "full_outer").select("*", *[(c(f"{x}_2") - c(f"{x}_1")).alias(f"{x}_delta") for x in columns])


def run_list(runs: DataFrame, status: str | None = None, starred: bool | None = None, search: str | None = None, limit: int = 200) -> DataFrame:
    """Experiment runs by status, star and name, newest first."""
    if status:
        runs = runs.where(c("status") == status)
    if starred is not None:
        runs = runs.where(c("starred") == F.lit(starred))
    if search:
        runs = runs.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return runs.orderBy(c("created_at").desc(), "run_id").limit(limit)


def coefficient_report(coefficients: DataFrame, stats: DataFrame, keys: Sequence[str] = ("run_id", "market_group")) -> DataFrame:
    """Coefficient rows with the statistics of their segment."""
    label = title_words(F.replace(c("market_group"), F.lit("_"), F.lit(" ")))
    return coefficients.withColumn("display_name", label).join(stats, list(keys), "left")


BASE_TERMS = ("living_area", "lot_size", "bedrooms", "bathrooms")


def setting_terms(setting: Mapping[str, object]) -> dict[str, Column]:
    """Columns of one model setting."""
    out = {x: c(x).cast("double") for x in BASE_TERMS}
    if setting.get("include_quality", True):
        out["quality_score"] = c("quality_score").cast("double")
    if int(setting.get("poly_degree", 1)) >= 2:
        out["living_area_sq"] = F.pow(c("living_area").cast("double"), F.lit(2))
    if setting.get("include_interactions", False):
        out["living_area_quality"] = c("living_area").cast("double") * c("quality_score") * float(setting.get("interaction_weight", 1.0))
    return out


def _scales(setting: Mapping[str, object]) -> dict[str, float]:
    """Terms of a setting with the factor each has over the plain column of the union."""
    return {x: float(setting.get("interaction_weight", 1.0)) if x == "living_area_quality" else 1.0 for x in setting_terms(setting)}


def setting_moments(df: DataFrame, grid: Sequence[Mapping[str, object]], y: str = "sale_price") -> tuple[DataFrame, mo.Moments, list[str]]:
    """Rows with every term that a setting uses, their cross products in one pass, and the terms.

    The products are grouped by `__missing`, the bits of the terms a row lacks: a setting
    sums the groups that lack none of its own terms, as it would leave those rows out.
    """
    union: dict[str, Column] = {}
    for setting in grid:
        union |= {k: v for k, v in setting_terms({**setting, "interaction_weight": 1.0}).items()}
    terms = list(union)
    rows = df.select(*[x for x in df.columns if x not in union], *[v.alias(k) for k, v in union.items()])
    bits = [F.when(c(x).isNull() | F.isnan(c(x)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(terms)]
    marked = rows.withColumn("__missing", sum(bits[1:], bits[0]))
    return rows, mo.moments(marked, ["__missing"], terms, y, required=[], standardize=False), terms


def setting_fits(mom: mo.Moments, grid: Sequence[Mapping[str, object]], terms: Sequence[str]) -> DataFrame:
    """Ridge coefficients (setting, term, beta, n) of all settings from the one matrix."""
    plain = [(_scales(s), float(s.get("ridge_alpha", 0.0))) for s in grid]
    names, p = list(terms), mom.shape.size

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                parts = [(int(g["missing"]), float(g["n"]), mo._square(g["m"], p)) for g in row.groups]
                for i, (scale, alpha) in enumerate(plain):
                    lacks = sum(1 << names.index(x) for x in scale)
                    used = [(n, m) for missing, n, m in parts if not missing & lacks]
                    if not used:
                        continue
                    n, m = sum(x[0] for x in used), np.sum([x[1] for x in used], axis=0)
                    idx = [0, *[names.index(x) + 1 for x in scale]]
                    f = np.array([1.0, *scale.values()])
                    xtx = m[np.ix_(idx, idx)] * np.outer(f, f) + alpha * np.eye(len(idx))
                    d = np.sqrt(np.clip(np.diag(xtx), 1e-300, None))
                    b = np.linalg.solve(xtx / np.outer(d, d), m[idx, p - 1] * f / d) / d
                    out += [(i, x, float(v), int(n)) for x, v in zip(["const", *scale], b)]
            yield pd.DataFrame(out, columns=["setting", "term", "beta", "n"])

    # One row per pattern of missing terms, of which there are at most 2 to the number of terms.
    one = mom.df.agg(F.sort_array(F.collect_list(F.struct(c("__missing").cast("int").alias("missing"), "n", "m"))).alias("groups"))
    return one.mapInPandas(solve, "setting int, term string, beta double, n bigint")


def fit_setting(df: DataFrame, setting: Mapping[str, object], y: str = "sale_price") -> tuple[DataFrame, DataFrame]:
    """Ridge coefficients of one setting and the rows with `prediction`."""
    terms = setting_terms(setting)
    rows = df.select(*[x for x in df.columns if x not in terms], *[v.alias(k) for k, v in terms.items()]).withColumn("all_rows", F.lit("all"))
    fit = mo.ridge(mo.moments(rows, ["all_rows"], list(terms), y, standardize=False), float(setting.get("ridge_alpha", 0.0)))
    scored = mo.predict(rows, fit, ["all_rows"], list(terms)).withColumnRenamed("pred_ln", "prediction")
    return fit, scored


def score_settings(rows: DataFrame, fits: DataFrame, grid: Sequence[Mapping[str, object]], columns: Sequence[str]) -> DataFrame:
    """`columns` of every row with `setting` and `prediction`, for all settings in one scan.

    A row that lacks a term of a setting has no prediction there; settings without a fit drop out.
    """
    table = fits.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", c("setting").cast("string"), "term"), "beta")))).scalar()
    made = []
    for i, setting in enumerate(grid):
        value = table[f"{i} const"]
        for x, factor in _scales(setting).items():
            value = value + table[f"{i} {x}"] * (c(x) * F.lit(factor))
        made.append(F.struct(F.lit(i).alias("setting"), table[f"{i} const"].isNotNull().alias("fitted"), value.alias("prediction")))
    return rows.select(*columns, F.explode(F.array(*made)).alias("s")).where("s.fitted").select("s.setting", *columns, "s.prediction")


def fit_metrics(scored: DataFrame, group: Sequence[str], y: str = "sale_price", value: str = "assessed_value") -> DataFrame:
    keys = list(group)
    shape = clipped_fit(scored, keys, value, "prediction")
    errors = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.sum(F.pow(c(y) - c("prediction"), 2)) / (F.var_pop(y) * F.count(y))).alias("r2")
    )
    return attach(shape, errors, keys, "inner")


def tune(df: DataFrame, grid: Sequence[Mapping[str, object]], max_cod: float = 10.0, prd: tuple[float, float] = (0.98, 1.03)) -> DataFrame:
    """Measures of every setting and which one to take: the first that meets both targets.

    All settings share one matrix of cross products over the union of their terms, each being
    a submatrix, and one scan that scores a row under all of them.
    """
    rows, mom, terms = setting_moments(df, grid)
    fits = cut_lineage(setting_fits(mom, grid, terms))
    out = fit_metrics(score_settings(rows, fits, grid, ["sale_price", "assessed_value"]), ["setting"])
    meets = (c("cod") < max_cod) & c("prd").between(*prd)
    first = out.agg(F.min(F.when(meets, c("setting")))).scalar()
    return out.withColumn("meets_target", meets).withColumn("selected", F.coalesce(c("setting") == first, F.lit(False)))
