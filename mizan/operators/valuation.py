"""Market values: comparables, a ridge fit shared by all models, leave-one-out errors, segments and ratings.

The fit's unknowns are the shared effects and, for every model, a level, its own age slope and levels of its larger trims.
A model's unknowns meet those of another only through the shared ones, so the normal equations are solved by blocks: sums
by (model, trim) in one aggregate, each model's block eliminated in parallel, one system as large as the shared effects on
the driver, and the models' unknowns from it in parallel again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.operators.events import tehran_day
from mizan.operators.document import lcg_share
from mizan.operators.market import exact_medians, first_of_reposts, numbered, price_outliers, usual_prices
from mizan.session import cut, stored

#: Fixed values of the method.
WINDOW_DAYS, KM_A_YEAR, ZERO_KM, STRENGTH = 30, 20_000, 1_000, 20
LEAST_SEGMENT, MOST_ERROR, LEAST_TRIM, FACTOR, MADS, INSTALLMENT_GUARD = 8, 15, 5, 3, 3, -20
LEVEL_PENALTY, SLOPE_SCALE, MAD_SCALE = 1e-8, 5, 1.4826
#: Effect: (prior, least, most) as fractions of the price, and a typical size of the feature.
PRIORS = {
    "age_slope": (-0.06, -0.2, 0.05, 5), "mileage_deviation": (-0.08, -0.2, 0, 0.5), "zero_km": (0.06, 0, 0.2, 1),
    "body_minor": (-0.02, -0.06, 0, 1), "body_painted": (-0.06, -0.15, 0, 1), "body_painted_around": (-0.12, -0.25, 0, 1),
    "chassis_repainted": (-0.06, -0.12, 0, 1), "gearbox_automatic": (0.1, 0, 0.3, 1), "dual_fuel_aftermarket": (-0.04, -0.1, 0, 1),
    "electrified": (0.15, 0, 0.4, 1), "off_colour": (-0.05, -0.12, 0, 1), "day": (0.003, -0.005, 0.01, 10),
}
TERMS = list(PRIORS)
N = len(TERMS)
COMMON_COLOURS = ("white", "black", "silver", "grey")
EXCLUDED_BODIES, EXCLUDED_PARTS = ("fully_repainted", "accident_damaged", "salvage"), ("replaced", "needs_repair")
TARGET = np.array([math.log1p(p[0]) for p in PRIORS.values()])
LOW, HIGH = (np.array([math.log1p(p[i]) for p in PRIORS.values()]) for i in (1, 2))
PENALTY = np.array([(1 if t == "age_slope" else STRENGTH) * p[3] ** 2 for t, p in PRIORS.items()], float)


def excluded_condition() -> Column:
    """A body, engine, gearbox or chassis that no comparable and no rated listing may have."""
    bad = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    out = bad("body_condition", EXCLUDED_BODIES) | bad("engine_condition", EXCLUDED_PARTS) | bad("gearbox_condition", EXCLUDED_PARTS)
    return out | bad("front_chassis", ("damaged",)) | bad("rear_chassis", ("damaged",))


#: What a listing and its reposts share.
REPOSTS = ["source_id", "model_id", "model_year", "mileage_km", "asking_price"]


def comparables(listings: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Listings that a fit may learn from: the first of eligible() reposts."""
    return first_of_reposts(eligible(listings, as_of, days), REPOSTS, [F.asc("listed_at"), F.asc("listing_id")])


def eligible(listings: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Asking listings of known model, year, mileage and gearbox; active or seen in the window; no excluded condition, no
    dealer's new car. Adds days_before: from the posting day to as_of."""
    listed, seen = tehran_day(F.col("listed_at")), tehran_day(F.col("last_seen_at"))
    known = F.col("price_type") == "asking"
    for c in ("asking_price", "model_id", "model_year", "mileage_km", "gearbox"):
        known = known & F.col(c).isNotNull()
    held = (F.col("status") == "active") | (seen >= F.date_sub(as_of, days))
    new = (F.col("seller_type") == "dealer") & (F.col("mileage_km") < ZERO_KM)
    some = listings.filter(known & (listed <= as_of) & held & ~excluded_condition() & ~F.coalesce(new, F.lit(False)))
    return some.withColumn("days_before", F.datediff(as_of, listed))


def features(year_now: int, day: bool = True, km: str | Column = "mileage_km") -> dict[str, Column]:
    """The shared features of a listing; day: also how long before the run's day it was posted (0 when rating)."""
    km = F.col(km) if isinstance(km, str) else km
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    age = F.greatest(F.lit(year_now) - F.col("model_year"), F.lit(0)).cast("double")
    return {
        "age_slope": age,
        "mileage_deviation": (km - KM_A_YEAR * F.greatest(age, F.lit(0.5))) / 100_000,
        "zero_km": flag(km < ZERO_KM),
        "body_minor": flag(F.col("body_condition") == "minor_scratches"),
        "body_painted": flag(F.col("body_condition") == "partly_repainted"),
        "body_painted_around": flag(F.col("body_condition") == "repainted_around"),
        "chassis_repainted": (flag(F.col("front_chassis") == "repainted").cast("boolean") | flag(F.col("rear_chassis") == "repainted").cast("boolean")).cast("double"),
        "gearbox_automatic": flag(F.col("gearbox") == "automatic"),
        "dual_fuel_aftermarket": flag(F.col("fuel") == "dual_fuel_aftermarket"),
        "electrified": flag(F.col("fuel").isin("hybrid", "plug_in_hybrid", "electric")),
        "off_colour": flag(~F.col("colour_family").isin(*COMMON_COLOURS)),
        "day": (-F.least(F.col("days_before"), F.lit(WINDOW_DAYS))).cast("double") if day else F.lit(0.0),
    }


def sums(rows: DataFrame, year_now: int) -> DataFrame:
    """(model_id, trim_id, n, s): sums of products of (features, 1, ln price) by model and trim; trims under LEAST_TRIM
    comparables count as none. One combining aggregate, whatever a model's size."""
    x = [*features(year_now).values(), F.lit(1.0), F.log("asking_price")]
    wide = rows.select("model_id", "trim_id", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    pairs = [(i, j) for i in range(N + 2) for j in range(i, N + 2)]
    by = wide.groupBy("model_id", "trim_id").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("s"))
    return by.withColumn("trim_id", F.when(F.col("n") >= LEAST_TRIM, F.col("trim_id")))


def _moments(s: np.ndarray) -> np.ndarray:
    full = np.zeros((N + 2, N + 2))
    full[np.triu_indices(N + 2)] = s
    return full + np.triu(full, 1).T


@dataclass
class Block:
    """One model's part of the normal equations: own unknowns (level, slope, trims), those shared, and their cross part."""

    own: np.ndarray
    cross: np.ndarray
    shared: np.ndarray
    own_y: np.ndarray
    shared_y: np.ndarray
    trims: list

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Block:
        m = [_moments(np.asarray(s, float)) for s in rows["s"]]
        named = [i for i, t in enumerate(rows["trim_id"]) if pd.notna(t)]
        p = 2 + len(named)
        own, cross, own_y = np.zeros((p, p)), np.zeros((p, N)), np.zeros(p)
        one, y = N, N + 1
        whole = sum(m)
        base = [one, 0]  # level, own age slope
        own[:2, :2] = whole[np.ix_(base, base)]
        cross[:2], own_y[:2] = whole[base, :N], whole[base, y]
        for k, i in enumerate(named, 2):
            own[k, k] = m[i][one, one] + STRENGTH
            own[k, :2] = own[:2, k] = m[i][one, base]
            cross[k], own_y[k] = m[i][one, :N], m[i][one, y]
        own[0, 0] += LEVEL_PENALTY
        own[1, 1] += STRENGTH * SLOPE_SCALE**2
        return cls(own, cross, whole[:N, :N], own_y, whole[:N, y], [rows["trim_id"].iloc[i] for i in named])

    def free(self, slope: float | None) -> np.ndarray:
        return np.array([i for i in range(len(self.own)) if i != 1 or slope is None])

    def eliminated(self, slope: float | None) -> tuple[np.ndarray, np.ndarray]:
        """What is left for the shared unknowns; slope: the model's own slope, where a bound has fixed it."""
        f = self.free(slope)
        held = 0.0 if slope is None else slope
        own_y, shared_y = self.own_y[f] - self.own[f, 1] * (0.0 if slope is None else held), self.shared_y - self.cross[1] * held
        half = np.linalg.solve(self.own[np.ix_(f, f)], np.column_stack([self.cross[f], own_y]))
        return self.shared - self.cross[f].T @ half[:, :N], shared_y - self.cross[f].T @ half[:, N]

    def solved(self, beta: np.ndarray, slope: float | None) -> np.ndarray:
        f = self.free(slope)
        out = np.zeros(len(self.own))
        out[f] = np.linalg.solve(self.own[np.ix_(f, f)], self.own_y[f] - self.cross[f] @ beta - (0.0 if slope is None else self.own[f, 1] * slope))
        if slope is not None:
            out[1] = slope
        return out


@dataclass
class Fit:
    """shared: the effects by term; models: a table (model_id, trim_id, level, slope, trim_level, inverse, half), one row for
    each model and, beside it, each trim with a level; trim_id null: the model itself. covariance: of the shared effects."""

    shared: dict[str, float]
    models: DataFrame
    covariance: np.ndarray
    held: dict = field(default_factory=dict)

    def value(self, x: dict[str, Column]) -> Column:
        """The logarithm of the value at these features, of rows that have met their model's unknowns."""
        out = F.col("level") + F.col("slope") * x["age_slope"] + F.coalesce("trim_level", F.lit(0.0))
        for t in TERMS[1:]:
            out = out + F.lit(self.shared[t]) * x[t]
        return out

    def predicted(self, rows: DataFrame, year_now: int, day: bool = True, name: str = "ln_value") -> DataFrame:
        """rows and the logarithm of their value; null for models that were not fitted."""
        return self.predicted_at(rows, year_now, {name: F.col("mileage_km")}, day)

    def predicted_at(self, rows: DataFrame, year_now: int, mileages: dict[str, Column], day: bool = True) -> DataFrame:
        """rows and, by name, the logarithm of their value at each mileage; rows meet their model's unknowns once."""
        base = self.models.filter("trim_id is null").select("model_id", "level", "slope")
        trims = self.models.filter("trim_id is not null").select("model_id", "trim_id", "trim_level")
        both = rows.join(base, "model_id", "left").join(trims, ["model_id", "trim_id"], "left")
        values = {}
        for name, km in mileages.items():
            values[name] = self.value(features(year_now, day, km))
        return both.withColumns(values).drop("level", "slope", "trim_level")


def ridge(rows: DataFrame, year_now: int, rounds: int = 50) -> Fit:
    """The ridge fit of ln price toward the priors, its effects and each model's whole slope held to their bounds by an
    active set. Rows are read once, for their sums; a round goes over the sums alone. The driver sees one system of N
    unknowns a round, and as many slopes as models pass their bounds."""
    stats = cut(sums(rows, year_now))  # one row for each model and trim
    held: dict = {}
    fixed: dict[int, float] = {}

    def system() -> tuple[np.ndarray, np.ndarray]:
        def run(model: pd.DataFrame) -> pd.DataFrame:
            a, b = Block.of(model).eliminated(held.get(model["model_id"].iloc[0]))
            return pd.DataFrame({"v": [np.concatenate([a.ravel(), b])]})

        left = stats.groupBy("model_id").applyInPandas(run, "v array<double>")
        total = left.agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(N * N + N)]).first()
        v = np.array([x or 0.0 for x in total])
        return v[: N * N].reshape(N, N) + np.diag(PENALTY), v[N * N :] + PENALTY * TARGET

    def shared_solution(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        free = [i for i in range(N) if i not in fixed]
        beta = np.array([fixed.get(i, 0.0) for i in range(N)])
        beta[free] = np.linalg.solve(a[np.ix_(free, free)], b[free] - a[np.ix_(free, list(fixed))] @ np.array(list(fixed.values()))) if free else []
        return beta

    def own(beta: np.ndarray, covariance: np.ndarray | None = None) -> DataFrame:
        def run(model: pd.DataFrame) -> pd.DataFrame:
            name, block = model["model_id"].iloc[0], Block.of(model)
            slope = held.get(name)
            v = block.solved(beta, slope)
            f = block.free(slope)
            inverse = np.zeros_like(block.own)
            inverse[np.ix_(f, f)] = np.linalg.inv(block.own[np.ix_(f, f)])
            out = []
            for k, trim in [(None, None), *enumerate(block.trims, 2)]:
                of = [0, 1] if k is None else [0, 1, k]
                near, half = np.zeros((3, 3)), np.zeros((N, 3))  # a model itself has no third unknown
                near[: len(of), : len(of)], half[:, : len(of)] = inverse[np.ix_(of, of)], block.cross.T @ inverse[:, of]
                out.append({"model_id": name, "trim_id": trim, "level": v[0], "slope": beta[0] + v[1], "trim_level": 0.0 if k is None else v[k], "own": v[1], "inverse": near.ravel(), "half": half.ravel()})
            return pd.DataFrame(out)

        kinds = {c: stats.schema[c].dataType.simpleString() for c in ("model_id", "trim_id")}
        return stats.groupBy("model_id").applyInPandas(run, f"model_id {kinds['model_id']}, trim_id {kinds['trim_id']}, level double, slope double, trim_level double, own double, inverse array<double>, half array<double>")

    beta, a = TARGET.copy(), np.eye(N)
    for _ in range(rounds):
        a, b = system()
        beta = shared_solution(a, b)
        changed = False
        for i in range(N):
            if i not in fixed and not LOW[i] <= beta[i] <= HIGH[i]:
                fixed[i] = float(np.clip(beta[i], LOW[i], HIGH[i]))
                changed = True
        out = own(beta).filter("trim_id is null and (slope < {} or slope > {})".format(LOW[0], HIGH[0])).select("model_id", "slope").collect()
        for r in out:
            if r["model_id"] not in held:
                held[r["model_id"]] = float(np.clip(r["slope"], LOW[0], HIGH[0]) - beta[0])
                changed = True
        if not changed:
            break
    free = [i for i in range(N) if i not in fixed]
    covariance = np.zeros((N, N))
    covariance[np.ix_(free, free)] = np.linalg.inv(a[np.ix_(free, free)])
    return Fit(dict(zip(TERMS, beta.tolist(), strict=True)), stored(own(beta).drop("own"), "models"), covariance, held)


def left_out(fit: Fit, rows: DataFrame, year_now: int) -> DataFrame:
    """rows with ln_value, and ln_left_out: what the fit would say of a row had it not learnt from it, by the row's
    leverage x' A^-1 x, which each model's own block and the shared covariance give without any large matrix. Leverages are
    reckoned for many rows at once; only what they are made of goes to Python."""
    base = fit.models.filter("trim_id is null").select("model_id", "level", "slope", F.col("inverse").alias("__i2"), F.col("half").alias("__h2"))
    named = fit.models.filter("trim_id is not null").select("model_id", "trim_id", "trim_level", F.col("inverse").alias("__i3"), F.col("half").alias("__h3"))
    both = rows.join(base, "model_id").join(named, ["model_id", "trim_id"], "left")
    c, x = fit.covariance, features(year_now)

    @F.pandas_udf("double")
    def leverage(parts: pd.Series) -> pd.Series:
        v = np.stack(parts) if len(parts) else np.zeros((0, N + 9 + 3 * N))
        own, inverse, half = v[:, :N], v[:, N : N + 9].reshape(-1, 3, 3), v[:, N + 9 :].reshape(-1, N, 3)
        m = np.column_stack([np.ones(len(v)), own[:, 0], np.ones(len(v))])
        u = own - np.einsum("njk,nk->nj", half, m)
        return pd.Series(np.einsum("nj,njk,nk->n", m, inverse, m) + np.einsum("nj,nj->n", u @ c, u))

    parts = F.concat(F.array(*x.values()), F.coalesce("__i3", "__i2"), F.coalesce("__h3", "__h2"))
    both = both.withColumns({"ln_value": fit.value(x), "__leverage": leverage(parts)})
    y = F.log("asking_price")
    said = y - (y - F.col("ln_value")) / F.greatest(1 - F.col("__leverage"), F.lit(1e-6))
    return both.select(*rows.columns, "ln_value", said.alias("ln_left_out"))


def residual_outliers(rows: DataFrame, residual: Column, mads: float = MADS) -> DataFrame:
    """rows and is_far: residuals further than so many scaled median absolute deviations from their median. rows are
    written once, so give only the columns that are wanted; the median and the deviation are written as a row each."""
    some = stored(rows.withColumn("__r", residual), "residuals")
    centre = F.broadcast(stored(exact_medians(some, [], "__r", "__centre"), "centre"))
    off = F.abs(F.col("__r") - F.col("__centre"))
    spread = exact_medians(some.crossJoin(centre).select(off.alias("__off")), [], "__off", "__spread")
    spread = F.broadcast(stored(spread.withColumn("__spread", MAD_SCALE * F.col("__spread")), "spread"))
    out = some.crossJoin(centre).crossJoin(spread).withColumn("is_far", (F.col("__spread") > 0) & (off > mads * F.col("__spread")))
    return out.drop("__r", "__centre", "__spread")


def segments(rows: DataFrame, value: Column) -> DataFrame:
    """One row for each model: how many comparables, how many new, its years, the median error of `value` in percent, and
    whether it rates: LEAST_SEGMENT comparables, an error of MOST_ERROR percent at most (of three or more)."""
    error = F.abs(value - F.col("asking_price")) * 100 / F.col("asking_price")
    by = rows.withColumn("__e", error).groupBy("model_id").agg(
        F.count("*").alias("comparables"), F.count_if(F.col("mileage_km") < ZERO_KM).alias("zero_km"), F.min("model_year").alias("min_year"),
        F.max("model_year").alias("max_year"), F.when(F.count("__e") >= 3, F.round(F.percentile("__e", 0.5), 2)).alias("error_pct"))
    return by.withColumn("rates", (F.col("comparables") >= LEAST_SEGMENT) & F.coalesce(F.col("error_pct") <= MOST_ERROR, F.lit(False)))


@dataclass
class Valuation:
    fit: Fit
    segments: DataFrame
    comparables: DataFrame


def valuation(rows: DataFrame, year_now: int) -> Valuation:
    """The whole fit: price outliers out, a first fit, residual outliers out, the final fit, segments by leave-one-out
    errors, and every comparable of a segment with fitted value and is_outlier. rows are read several times: give written
    ones. They are written once more, with their residuals; no step joins them by their ids."""
    columns = rows.columns
    marked = price_outliers(rows, factor=FACTOR, usual=stored(usual_prices(rows), "usual")).drop("near_median")
    first = marked.filter("not is_outlier").select(*columns)
    early = ridge(first, year_now)
    judged = residual_outliers(early.predicted(first, year_now, name="__said"), F.log("asking_price") - F.col("__said"))
    judged = judged.select(*columns, F.coalesce("is_far", F.lit(False)).alias("is_outlier"))
    kept = judged.filter("not is_outlier").select(*columns)
    final = ridge(kept, year_now)
    parts = stored(segments(left_out(final, kept, year_now), F.exp("ln_left_out")), "segments")
    every = marked.filter("is_outlier").select(*columns, "is_outlier").unionByName(judged).join(parts.select("model_id"), "model_id", "left_semi")
    every = final.predicted(every, year_now).filter("ln_value is not null")
    return Valuation(final, parts, every.withColumn("fitted", F.floor(F.exp("ln_value") + 0.5).cast("long")))


def rated(listings: DataFrame, parts: DataFrame, learnt: DataFrame) -> DataFrame:
    """(listing_id, market_value, price_gap, rating, reason) of listings(with ln_value), whose ids differ; parts: segments;
    learnt: comparables with is_outlier. The first reason that holds is the one given; a gap is stored only where there is
    no reason.

    What a model and a year offer is one written table, which listings meet once. Listings with the reasons of their own
    are written; only those that nothing else excludes meet the outliers."""
    years = listings.select("model_id", "model_year").distinct().filter("model_year is not null")
    offered = near_in_frame(learnt, years).join(parts.select("model_id", "comparables", "zero_km", "rates"), "model_id", "left")
    both = listings.join(stored(offered, "offered"), ["model_id", "model_year"], "left")
    missing = F.col("model_year").isNull() | F.col("mileage_km").isNull() | F.col("gearbox").isNull()
    same_kind = F.when(F.col("mileage_km") < ZERO_KM, F.col("zero_km")).otherwise(F.col("comparables") - F.col("zero_km"))
    unvalued = F.when(F.col("model_id").isNull(), "unmatched_model").when(F.col("price_type").isNull(), "unknown_price").when(missing, "missing_attributes").when(excluded_condition(), "excluded_condition")
    unrated = F.coalesce(unvalued, F.when(F.col("ln_value").isNull() | F.col("comparables").isNull() | (F.col("comparables") < LEAST_SEGMENT), "too_few_comparables").when(~F.col("rates"), "uncertain_segment").when((F.coalesce("near", F.lit(0)) < 3) | (same_kind < 1), "year_out_of_range"))
    both = both.withColumn("__unrated", unrated)
    both = both.withColumn("market_value", F.when(F.col("__unrated").isNull(), F.rint(F.exp("ln_value")).cast("long")))
    value, ask = F.col("market_value"), F.col("asking_price")
    why = F.coalesce("__unrated", F.when(F.col("price_type") == "negotiable", "no_asking_price").when(F.col("price_type") == "placeholder", "placeholder_price").when(F.col("price_type") == "installment", "installment_price").when((F.col("seller_type") == "dealer") & (F.col("mileage_km") < ZERO_KM), "dealer_new_car").when(~ask.between(value / 3.0, value * 3.0), "price_outlier"))
    own = stored(both.select("listing_id", "asking_price", "accepts_installments", "market_value", why.alias("__why")), "reasons")
    outliers = learnt.filter("is_outlier").select("listing_id", F.lit("price_outlier").alias("__off"))
    open_ones = own.filter("__why is null").drop("__why").join(outliers, "listing_id", "left").withColumnRenamed("__off", "__why")
    some = own.filter("__why is not null").unionByName(open_ones)
    gap = F.when(F.col("__why").isNull(), F.round(((ask - F.col("market_value")) * 100 / F.col("market_value")).cast("decimal(18,6)"), 2).cast("decimal(9,2)"))
    some = some.withColumn("__gap", gap)
    some = some.withColumn("reason", F.coalesce("__why", F.when(F.coalesce(F.col("accepts_installments"), F.lit(False)) & (F.col("__gap") <= INSTALLMENT_GUARD), "installment_price")))
    some = some.withColumn("price_gap", F.when(F.col("reason").isNull(), F.col("__gap")))
    g = F.col("price_gap")
    rating = F.when(g <= -10, "great").when(g <= -4, "good").when(g < 4, "fair").when(g < 10, "high").when(g.isNotNull(), "overpriced")
    return some.select("listing_id", "market_value", "price_gap", rating.alias("rating"), "reason")


def near_in_frame(learnt: DataFrame, years: DataFrame, span: int = 2) -> DataFrame:
    """(model_id, model_year, near): learnt rows within `span` years of each asked year, whether or not that year has any.
    Both are counts by model and year, so the frame runs over a model's years."""
    counts = learnt.filter("not is_outlier and model_year is not null").groupBy("model_id", "model_year").agg(F.count("*").alias("n"))
    every = counts.unionByName(years.withColumn("n", F.lit(0).cast("long"))).groupBy("model_id", "model_year").agg(F.sum("n").alias("n"))
    frame = Window.partitionBy("model_id").orderBy("model_year").rangeBetween(-span, span)
    return every.select("model_id", "model_year", F.sum("n").over(frame).alias("near"))


def plausible_thousands(written: Column, age: Column) -> Column:
    """Whether a figure read in thousands is a mileage that a car of this age can have; an unknown age is no obstacle."""
    return (written >= 1) & (age.isNull() | (written * 1000 <= 40_000 * (F.greatest(age, F.lit(0)) + 0.5)))


def mileage_decisions(rows: DataFrame, fit: Fit, year_now: int, ratio: float = 1.15) -> DataFrame:
    """rows(written_km, ...) with price_ratio (asking price over value at 1,000 times the figure, three decimals) and
    thousands: whether the price says that the seller wrote thousands."""
    both = fit.predicted_at(rows, year_now, {"__as": F.col("written_km"), "__thousand": F.col("written_km") * 1000}).withColumn("mileage_km", F.col("written_km") * 1000)
    said = F.least(F.round(F.col("asking_price") / F.exp("__thousand"), 3), F.lit(9_999.0))
    gap = F.exp(F.col("__as") - F.col("__thousand"))
    age = F.greatest(F.lit(year_now) - F.col("model_year"), F.lit(0))
    yes = (said <= ratio) & (gap >= ratio) & plausible_thousands(F.col("written_km"), age)
    return both.withColumns({"price_ratio": said, "thousands": F.coalesce(yes, F.lit(False))}).drop("__as", "__thousand")


def untested(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored mileage readings whose listing is no candidate any more: their test is cleared."""
    return stored.filter("price_ratio is not null").join(candidates.select("listing_id"), "listing_id", "left_anti")


def shown_comparables(near: DataFrame, subjects: DataFrame, learnt: DataFrame) -> DataFrame:
    """near(listing_id, position, comparable_id) with each comparable's price brought to the listing: price times the
    listing's value over the comparable's fitted one, in whole units."""
    own = subjects.select("listing_id", "market_value")
    other = learnt.select(F.col("listing_id").alias("comparable_id"), F.col("asking_price").alias("price"), "fitted")
    both = near.select("listing_id", "position", "comparable_id").join(own, "listing_id").join(other, "comparable_id")
    adjusted = F.round((F.col("price") * F.col("market_value")).cast("decimal(38,6)") / F.col("fitted"), 0).cast("long")
    return both.withColumn("adjusted", adjusted)


def scores(rows: DataFrame, value: Column) -> DataFrame:
    """(model_id, tested, mdape, within10): median absolute error in percent and the share within ten, by model and, with
    a null model_id, of all; a rollup."""
    error = F.abs(value - F.col("asking_price")) * 100 / F.col("asking_price")
    some = stored(rows.select("model_id", error.alias("__e")), "errors")
    tallies = [F.count("*").alias("tested"), F.round(F.avg((F.col("__e") <= 10).cast("double")) * 100, 2).alias("within10")]
    shown = ("model_id", "is_total", "tested", "mdape", "within10")
    by = some.groupBy("model_id").agg(F.lit(0).alias("is_total"), F.round(F.percentile("__e", 0.5), 2).alias("mdape"), *tallies).select(*shown)
    total = some.groupBy(F.lit(None).cast(some.schema["model_id"].dataType).alias("model_id"), F.lit(1).alias("is_total")).agg(*tallies)
    total = total.crossJoin(F.broadcast(exact_medians(some, [], "__e", "__median"))).withColumn("mdape", F.round("__median", 2))  # one row
    return by.unionByName(total.select(*shown))


def split_scores(learn: DataFrame, test: DataFrame, year_now: int) -> DataFrame:
    """scores() of test rows under a fit of learn, where their model rates and three learnt rows lie within two years."""
    done = valuation(learn, year_now)
    some = test.join(done.segments.filter("rates").select("model_id"), "model_id", "left_semi")
    close = near_in_frame(done.comparables, some.select("model_id", "model_year").distinct()).filter("near >= 3").select("model_id", "model_year")
    return scores(done.fit.predicted(some.join(close, ["model_id", "model_year"], "left_semi"), year_now), F.exp("ln_value"))


def time_split(rows: DataFrame, cut: Column, as_of: Column, year_now: int) -> DataFrame:
    """Learns from rows posted before the cut, seen from the day before it, and scores those posted since."""
    shift = F.datediff(as_of, cut) + 1
    based = rows.withColumns({"__day": tehran_day(F.col("listed_at")), "days_before": F.col("days_before") - shift})
    return split_scores(based.filter(F.col("__day") < cut).drop("__day"), based.filter(F.col("__day") >= cut).drop("__day"), year_now)


def random_split(rows: DataFrame, year_now: int, seed: int = 51, share: float = 0.8) -> DataFrame:
    """Learns from the rows that a seeded linear congruential sequence picks, row by row in the order of their ids, and
    scores the others. A row's number comes from counts of ranges, and its state of the sequence from its number."""
    places = numbered(rows, "listing_id", *[c for c in rows.columns if c != "listing_id"])
    both = stored(places.withColumn("__learn", lcg_share(F.col("n"), seed) < share).drop("n"), "split")
    return split_scores(both.filter("__learn").drop("__learn"), both.filter("not __learn").drop("__learn"), year_now)


def adjustments(shared: dict[str, float], year_now: int, least: float = 0.5) -> Column:
    """Each effect's size on a listing's price in percent, largest first; those under half a percent are not shown."""
    x = features(year_now, day=False)
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.round((F.exp(F.lit(shared[t]) * x[t]) - 1) * 100, 4).alias("percent")) for t in TERMS])
    shown = F.filter(each, lambda e: F.abs(e["percent"]) >= least)
    return F.array_sort(shown, lambda a, b: F.when(F.abs(a["percent"]) > F.abs(b["percent"]), -1).when(F.abs(a["percent"]) < F.abs(b["percent"]), 1).when(a["term"] < b["term"], -1).otherwise(1))
