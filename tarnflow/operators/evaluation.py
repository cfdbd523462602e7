"""Rolling origins, one-step skill, robustness to gaps, leaderboards and significance."""

from __future__ import annotations

from functools import reduce
from math import comb, factorial, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tarnflow.operators import metrics, models, series
from tarnflow.session import saved

HORIZON = 24


def rolling_origins(df: DataFrame, count: int = 6, first: float = 0.65, horizon: int = HORIZON) -> DataFrame:
    """(series_id, origin, cutoff): evenly spaced from 65 % of a series to a horizon before its end."""
    n = df.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("lo", F.bround(F.lit(first) * F.col("n"), 0))
    hi = F.col("n") - horizon
    at = n.select("series_id", "n", "lo", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("origin"))
    cut = F.when(F.col("lo") < hi, F.bround(F.col("lo") + (hi - F.col("lo")) * F.col("origin") / (count - 1), 0)).otherwise(hi)
    return at.select("series_id", F.col("origin").cast("long").alias("origin"), cut.cast("long").alias("cutoff")).where("cutoff > 0").dropDuplicates(["series_id", "cutoff"])


def walk_forward(df: DataFrame, origins: DataFrame, truth: str = "y", horizon: int = HORIZON) -> DataFrame:
    """Errors of mean, naive and daily repeat at each origin: (series_id, cutoff, model, mae, rmse, smape)."""
    rows = df.join(origins.select("series_id", "cutoff"), "series_id")
    past = rows.where("idx < cutoff").groupBy("series_id", "cutoff").agg(F.avg("y").alias("mean"), F.max_by("y", "idx").alias("naive"))
    day = rows.where("idx >= cutoff - 24 and idx < cutoff").select("series_id", "cutoff", (F.col("idx") - F.col("cutoff") + 24).alias("h"), F.col("y").alias("seasonal_naive"))
    test = rows.where(F.expr(f"idx >= cutoff and idx < cutoff + {horizon}")).select("series_id", "cutoff", "idx", F.col(truth).alias("truth"), ((F.col("idx") - F.col("cutoff")) % 24).alias("h"))
    wide = test.join(past, ["series_id", "cutoff"]).join(day, ["series_id", "cutoff", "h"])
    long = wide.unpivot(["series_id", "cutoff", "idx", "truth"], ["mean", "naive", "seasonal_naive"], "model", "y_hat").withColumnRenamed("truth", "y")
    return metrics.error(long, ["series_id", "cutoff", "model"])


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation over origins (0 for one), with skill against the mean model."""
    out = scores.groupBy(*by, "model").agg(*(F.avg(m).alias(m) for m in ("mae", "rmse", "smape")), F.coalesce(F.stddev_samp("rmse"), F.lit(0.0)).alias("rmse_sd"))
    return metrics.skill(out, by)


def one_step_skill(df: DataFrame) -> DataFrame:
    """One-step predictors over all rows that have each: expanding mean, last value, value a day before."""
    w = series.by()
    rows = series.expanding_mean(df).withColumns({"persistence": F.lag("y", 1).over(w), "seasonal24": F.lag("y", 24).over(w), "mean": F.col("mean_before")})
    rows = rows.where(series.F.col("idx") >= 24)
    long = rows.unpivot(["series_id", "idx", "y"], ["mean", "persistence", "seasonal24"], "model", "y_hat")
    return metrics.skill(metrics.error(long, ["series_id", "model"]), ["series_id"])


def sparsity_sweep(df: DataFrame, rates=(0, 20, 40, 60), count: int = 4) -> DataFrame:
    """Walk-forward errors on series with dropped and interpolated rows, scored on the true ones."""
    out = None
    origins = rolling_origins(df, count)
    for rate in rates:
        truth = df.select("series_id", "idx", F.col("y").alias("true_y"))
        thin = series.interpolate_linear(series.sparsify(df, rate)).join(truth, ["series_id", "idx"])
        part = walk_forward(thin, origins, "true_y").withColumn("drop_rate", F.lit(rate).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def one_step_skill_test(df: DataFrame, fitted: bool = True) -> DataFrame:
    """One-step predictors over the test rows: the mean so far, the last value, the value a day before (else the mean), and an autoregression of a day. Expects series.split()."""
    w = series.by()
    rows = series.expanding_mean(df).withColumns({"mean": F.col("mean_before"), "persistence": F.lag("y", 1).over(w), "seasonal24": F.coalesce(F.lag("y", 24).over(w), "mean_before")})
    rows = rows.where(~F.col("train"))
    names = ["mean", "persistence", "seasonal24"]
    long = rows.unpivot(["series_id", "idx", "y"], names, "model", "y_hat")
    if fitted:
        long = long.unionByName(models.ar_one_step(df).withColumn("model", F.lit("ar")))
    return metrics.skill(metrics.error(long, ["series_id", "model"]), ["series_id"])


def sparsity_models(df: DataFrame, names: tuple[str, ...], rates: tuple[int, ...] = (0, 20, 40, 60), count: int = 4) -> DataFrame:
    """Walk-forward errors of fitted models on series with dropped and interpolated rows: (series_id, drop_rate, cutoff, model, mae, rmse, smape), with the plain ones."""
    origins, thin = rolling_origins(df, count), None
    for rate in rates:
        part = series.interpolate_linear(series.sparsify(df, rate)).join(df.select("series_id", "idx", F.col("y").alias("true_y")), ["series_id", "idx"])
        part = part.withColumn("series_id", F.concat_ws("|", "series_id", F.lit(str(rate))))
        thin = part if thin is None else thin.unionByName(part)
    own = origins.withColumn("series_id", F.explode(F.array(*(F.concat_ws("|", "series_id", F.lit(str(r))) for r in rates))))
    keys = ["series_id", "cutoff", "model"]
    fitted = scored(models.walk_forward(thin, own, names, truth="true_y"), keys).where("n > 0").drop("n", "failed")
    both = walk_forward(thin, own, "true_y").unionByName(fitted)
    rate = F.element_at(F.split("series_id", r"\|"), -1)
    return both.withColumn("drop_rate", rate.cast("long")).withColumn("series_id", F.regexp_replace("series_id", r"\|[0-9]+$", ""))


def leaderboard(scores: DataFrame) -> DataFrame:
    """Best model of each series but the mean, its skill, and whether that is real (over 1 %)."""
    rows = scores.where("model <> 'mean'")
    top = rows.groupBy("series_id").agg(F.max_by("model", F.struct("skill", "model")).alias("best_model"), F.max("skill").alias("best_skill"), F.min("rmse").alias("best_rmse"))
    base = scores.where("model = 'mean'").select("series_id", F.col("rmse").alias("mean_rmse"))
    return top.join(base, "series_id").withColumn("real_skill", F.col("best_skill") > 1)


def first_tag(tagged: DataFrame, keys: list[str], order: str = "tag") -> DataFrame:
    """Of rows with equal keys the one of the first tag."""
    return tagged.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn = 1").drop("rn")


def benjamini_hochberg(df: DataFrame, by: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values within each group, and their significance."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(p)) + F.count("*").over(w.orderBy(p).rangeBetween(0, 0)) - 1
    rows = df.withColumn("raw", F.col(p) * F.count("*").over(w) / rank)
    adj = F.least(F.lit(1.0), F.min("raw").over(w.orderBy(p).rangeBetween(0, Window.unboundedFollowing)))
    return rows.withColumn("p_adjusted", adj).withColumn("significant", F.col("p_adjusted") <= alpha).drop("raw")


#: Ranges that distinct values are dealt to when they are counted in order.
RANGES = 200


def ranged(values: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """The range of a value (a number from 0) between quantiles that are sampled from a frame's column; halves are compared, so it takes some eight steps a row."""
    cuts = sorted({c for c in (values.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or [])})

    def half(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col(value) < F.lit(cuts[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return F.when(F.col(value).isNull(), 0).otherwise(half(0, len(cuts)))


def count_below(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """Each distinct value with how many rows have it and how many have a smaller one: (value, ties, below).

    Distinct values are dealt to ranges between sampled quantiles; only the ranges' totals, at most `ranges` of them, are put in order in one task.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("ties")).withColumn("range", ranged(df, value, ranges))
    return _with_below(counts, value).drop("range")


def _with_below(counts: DataFrame, value: str) -> DataFrame:
    """Distinct values (value, ties, range) with `below`."""
    totals = counts.groupBy("range").agg(F.sum("ties").alias("total"))
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    inside = F.sum("ties").over(Window.partitionBy("range").orderBy(value)) - F.col("ties")
    return counts.join(F.broadcast(before), "range").select(value, "ties", "range", (F.col("before") + inside).alias("below"))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun's formula 7.1.26, within 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


#: The law of U is used itself, not the normal one, if no value repeats and one side has at most so many values.
SMALL = 8
#: It is counted out up to this product of both sides; beyond, U is as good as a sum of uniform draws (within 1e-6 of the count at this size).
COUNTED = 100_000


def u_counts(m: int, k: int, most: int) -> np.ndarray:
    """How many of the orders of m and k distinct values give U = 0 to `most`: coefficients of the product of (1 - q^(k+i)) / (1 - q^i), i = 1 to m, in whole numbers."""
    c = np.zeros(most + 1, dtype=object)
    c[0] = 1
    for i in range(1, m + 1):
        for r in range(min(i, most + 1)):
            c[r::i] = np.cumsum(c[r::i])
        if k + i <= most:
            c[k + i :] = c[k + i :] - c[: most + 1 - k - i]
    return c


def u_at_most(u: int, m: int, k: int) -> float:
    """Probability of U <= u for m and k values without ties, all orders alike; u is a whole number."""
    m, k = sorted((m, k))
    if u < 0 or u >= m * k:
        return float(u >= 0)
    if 2 * u + 1 > m * k:
        return 1 - u_at_most(m * k - u - 1, m, k)
    if m * k <= COUNTED:
        return int(u_counts(m, k, u).sum()) / comb(m + k, m)
    x = (u + 0.5 - m * k / 2) / sqrt(k * (m + k + 1) + 1 / m) + m / 2
    return min(1.0, max(0.0, sum((-1) ** j * comb(m, j) * max(0.0, x - j) ** m for j in range(m + 1)) / factorial(m)))


@F.pandas_udf(DoubleType())
def _small_p(u: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else u_at_most(int(a), int(b), int(c)) for a, b, c in zip(u, m, k, strict=True)], dtype="float64")


def mann_whitney_less(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group against all other rows: U, and the normal approximation's z of "smaller", corrected for ties and continuity, and a p-value: of that, or of U's own law (`SMALL`). Null values don't count."""
    df = df.where(F.col(value).isNotNull())
    ranks = count_below(df, value).withColumn("rank", F.col("below") + (F.col("ties") + 1) / 2)
    total = df.agg(F.count("*").alias("n"))
    tie = ranks.agg(F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).alias("tie"))
    sums = df.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("m")).join(F.broadcast(total)).join(F.broadcast(tie))
    u = F.col("r") - F.col("m") * (F.col("m") + 1) / 2
    return _tested(sums.select(group, u.alias("u"), "m", (F.col("n") - F.col("m")).alias("k"), "tie"), group)


def _tested(sums: DataFrame, group: str) -> DataFrame:
    k, n = F.col("m") * F.col("k"), (F.col("m") + F.col("k")).cast("double")
    sd = F.sqrt(k / 12 * (n + 1 - F.try_divide(F.col("tie").cast("double"), n * (n - 1))))
    few = (F.least("m", "k") <= SMALL) & (F.least("m", "k") > 0) & (F.col("tie") == 0)
    args = [F.when(few, F.col(c)).cast("long") for c in ("u", "m", "k")]
    out = sums.select(group, "u", F.try_divide(F.col("u") + 0.5 - k / 2, F.nullif(sd, F.lit(0.0))).alias("z"), _small_p(*args).alias("few"))
    return out.select(group, "u", "z", F.coalesce("few", normal_cdf(F.col("z"))).alias("p"))


def mann_whitney_others(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group against all rows whose value the group doesn't have: U, z and p of "smaller". So no value is on both sides. Null values don't count.

    Rows are read once: equal values of a group are counted and written, and all else works on those counts, ordered by ranges of values also within a group.
    """
    own = saved(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("mine")), "values")
    counts = own.groupBy(value).agg(F.sum("mine").alias("ties"))
    all_ = saved(_with_below(saved(counts.withColumn("range", ranged(own, value)), "ranges"), value), "below")
    own = saved(own.join(all_, value), "values")
    parts = own.groupBy(F.col(group).alias("of"), F.col("range").alias("part")).agg(F.sum("ties").alias("total"))
    parts = parts.select("of", "part", (F.sum("total").over(Window.partitionBy("of").orderBy("part")) - F.col("total")).alias("before"))
    own = own.join(parts, F.col(group).eqNullSafe(F.col("of")) & (F.col("range") == F.col("part")))
    inside = F.sum("ties").over(Window.partitionBy(group, "range").orderBy(value)) - F.col("ties")
    own = own.withColumn("others", F.col("below") - F.col("before") - inside)
    cube = lambda c: F.sum(F.col(c).cast("double") * F.col(c) * F.col(c) - F.col(c))
    whole = all_.agg(F.sum("ties").alias("n"), cube("ties").alias("tie"))
    sums = own.groupBy(group).agg(F.sum(F.col("mine") * F.col("others")).cast("double").alias("u"), F.sum("mine").alias("m"), F.sum("ties").alias("shared"), cube("ties").alias("theirs"), cube("mine").alias("ours")).join(F.broadcast(whole))
    return _tested(sums.select(group, "u", "m", (F.col("n") - F.col("shared")).alias("k"), (F.col("tie") - F.col("theirs") + F.col("ours")).alias("tie")), group)


def significant(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Groups whose values are smaller than all others', by adjusted p-values: (group, p, p_adjusted, significant)."""
    tests = mann_whitney_others(df, group, value).where("p is not null").withColumn("all_", F.lit(0))
    return benjamini_hochberg(tests, ["all_"], alpha=alpha).select(group, "p", "p_adjusted", "significant")


def in_all(lists: list[DataFrame]) -> DataFrame:
    """Rows that every list has."""
    return reduce(DataFrame.intersect, lists)


def scored(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE and sMAPE of forecasts in long form, beside the failures: (by, n, failed, mae, rmse, smape)."""
    failed = forecasts.groupBy(*by).agg(F.count_if(F.col("y_hat").isNotNull()).alias("n"), F.count_if(F.col("status") != "ok").alias("failed"))
    return failed.join(metrics.error(forecasts.where("y_hat is not null"), by), by, "left")


def with_quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, quartiles, largest and mean of a value in each group: what a box plot shows."""
    cut = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.min(value).alias("low"), cut.alias("cut"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(*by, "low", *(F.col("cut")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))), "high", "mean", "n")


def pair_ranking(scores: DataFrame, models: list[str]) -> DataFrame:
    """The leaderboard with the skill of every model in a column of its own."""
    wide = scores.where("model <> 'mean'").groupBy("series_id").pivot("model", models).agg(F.max("skill"))
    return leaderboard(scores).join(wide.select("series_id", *(F.col(m).alias(f"skill_{m}") for m in models)), "series_id")
