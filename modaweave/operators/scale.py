"""Scaling, row normalisation and element-wise transforms.

A fitted scaler is a small table of numbers per feature; applying it is plain column arithmetic,
so train-fitted parameters carry over to any other table and nothing is shuffled to transform.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import exact_quantiles, exact_quantiles_long, to_long

METHODS = ("standardize", "minmax", "robust", "pareto")


def _x(f: str) -> Column:
    return F.col(f"`{f}`").cast("double")


def _seen(f: str) -> Column:
    return F.when(~F.isnan(_x(f)), _x(f))


@dataclass
class Scaler:
    """x -> (x - center) / divisor per feature; a null result may be replaced by ``fill``."""

    params: dict[str, tuple[float, float]] = field(default_factory=dict)
    fill: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        def z(f: str) -> Column:
            center, divisor = self.params[f]
            v = (_x(f) - F.lit(center)) / F.lit(divisor)
            return v if self.fill is None else F.coalesce(F.when(~F.isnan(v), v), F.lit(float(self.fill)))

        return df.withColumns({f: z(f) for f in self.params})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: _x(f) * F.lit(d) + F.lit(c) for f, (c, d) in self.params.items()})

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(f, float(c), float(d)) for f, (c, d) in self.params.items()]
        spark.createDataFrame(rows, "feature string, center double, divisor double").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, fill: float | None = None) -> Scaler:
        return cls({r["feature"]: (r["center"], r["divisor"]) for r in spark.read.parquet(path).collect()}, fill)


def fit(df: DataFrame, features: Sequence[str], method: str = "standardize", fill: float | None = None) -> Scaler:
    """One aggregate over the table; nulls and NaN are ignored, a zero divisor becomes 1."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    if method == "robust":
        long = to_long(df.select(F.lit(0).alias("_k"), *[_seen(f).alias(f) for f in features]), ["_k"], features)
        rows = {r["feature"]: r for r in exact_quantiles(long, [0.25, 0.5, 0.75]).collect()}
        raw = {f: (rows[f]["q1"], rows[f]["q2"] - rows[f]["q0"]) if f in rows else (0.0, 1.0) for f in features}
    else:
        stats = {
            "standardize": lambda f: (F.avg(_seen(f)), F.stddev_pop(_seen(f))),
            "minmax": lambda f: (F.min(_seen(f)), F.max(_seen(f)) - F.min(_seen(f))),
            "pareto": lambda f: (F.lit(0.0), F.sqrt(F.stddev_samp(_seen(f)))),
        }[method]
        aggs = []
        for i, f in enumerate(features):
            c, d = stats(f)
            aggs += [c.alias(f"c{i}"), d.alias(f"d{i}")]
        row = df.agg(*aggs).first()
        raw = {f: (row[f"c{i}"], row[f"d{i}"]) for i, f in enumerate(features)}

    def usable(v: float | None, default: float) -> float:
        return default if v is None or math.isnan(v) else float(v)

    return Scaler({f: (usable(c, 0.0), usable(d, 1.0) or 1.0) for f, (c, d) in raw.items()}, fill)


# -- rows -----------------------------------------------------------------------------------
def normalize_rows(df: DataFrame, features: Sequence[str], method: str, total: float = 1.0, axis: int = 1) -> DataFrame:
    """L1, L2, max-absolute or constant-sum; a zero denominator leaves the values as they are."""
    cols = [_x(f) for f in features]
    if method == "constant_sum" and axis == 0:
        sums = df.agg(*[F.sum(_x(f)).alias(f) for f in features]).first()
        return df.withColumns({f: _x(f) / F.lit(sums[f] or 1.0) * F.lit(total) for f in features})
    denominators = {
        "L1": lambda: sum((F.abs(c) for c in cols), F.lit(0.0)),
        "L2": lambda: F.sqrt(sum((c * c for c in cols), F.lit(0.0))),
        "max": lambda: F.greatest(*[F.abs(c) for c in cols]) if len(cols) > 1 else F.abs(cols[0]),
        "constant_sum": lambda: sum(cols, F.lit(0.0)),
    }
    if method not in denominators:
        raise ValueError(f"method must be one of {sorted(denominators)}, got {method!r}")
    factor = F.lit(total) if method == "constant_sum" else F.lit(1.0)
    work = df.withColumn("_den", denominators[method]())
    return work.withColumns(
        {f: F.when(F.col("_den") == 0, _x(f)).otherwise(_x(f) / F.col("_den") * factor) for f in features}
    ).drop("_den")


# -- elements -------------------------------------------------------------------------------
ELEMENTWISE = {
    "cbrt": lambda x: F.cbrt(x),
    "log10": lambda x: F.when(x > 0, F.log10(x)),
    "ln": lambda x: F.when(x > 0, F.log(x)),
    "log2": lambda x: F.when(x > 0, F.log2(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "expm1": lambda x: F.expm1(x),
}


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    two = F.lit(2.0) - lam
    neg = F.when(F.abs(two) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, two) - 1.0) / two)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    pos = F.exp(y) - 1.0 if abs(lam) < 1e-12 else F.pow(y * lam + 1.0, F.lit(1.0 / lam)) - 1.0
    neg = 1.0 - F.exp(-y) if abs(lam - 2) < 1e-12 else 1.0 - F.pow(1.0 - (2.0 - lam) * y, F.lit(1.0 / (2.0 - lam)))
    return F.when(y >= 0, pos).otherwise(neg)


def box_cox(x: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(x > 0, F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1.0) / lam))


def fit_power(df: DataFrame, features: Sequence[str], kind: str = "yeo-johnson", rounds: int = 5, width: int = 17, interval: tuple[float, float] = (-3.0, 5.0), widenings: int = 8) -> dict[str, float]:
    """Maximum-likelihood exponent per column.

    Equal values are counted once up front.  Each round scores a grid of exponents for all columns
    in one aggregate (the grid is a broadcast table of features x width rows), then narrows the
    interval around each winner, or moves it on if the winner stands at its end (``widenings`` times at
    most, beyond which the transform itself leaves the range of doubles).  Five rounds of 17 points
    resolve about 1e-4.

    A column on one side of zero is a power of b = x, 1 + x or 1 - x throughout.  It is scored on
    (b / geometric mean)**e, of which the logarithm is taken first, so values far from zero or close
    together lose nothing; the geometric mean drops out of the likelihood.  A column on both sides
    is shifted by the transform of its mean.
    """
    spark = df.sparkSession
    long = to_long(df.select(F.lit(0).alias("_k"), *[_seen(f).alias(f) for f in features]), ["_k"], features)
    x, c = F.col("value"), F.col("c")
    box = kind == "box-cox"
    if kind not in ("box-cox", "yeo-johnson"):
        raise ValueError(f"unknown power transform {kind!r}")
    usable = x > 0 if box else x.isNotNull() & ~F.isnan(x)
    values = long.filter(usable).groupBy("feature", "value").agg(F.count("*").cast("double").alias("c"))
    sides = values.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), (F.sum(x * c) / F.sum("c")).alias("_mean"))
    side = F.lit("box") if box else F.when(F.col("_lo") >= 0, "up").when(F.col("_hi") <= 0, "down").otherwise("both")
    log = F.when(F.col("_side") == "box", F.log(x)).when(F.col("_side") == "up", F.log1p(x)).when(F.col("_side") == "down", F.log1p(-x))
    jac = F.when(F.col("_side") == "both", F.signum(x) * F.log1p(F.abs(x))).otherwise(0.0)
    sided = values.join(F.broadcast(sides.select("feature", "_mean", side.alias("_side"))), "feature").withColumn("_log", log)
    centre = sided.groupBy("feature").agg((F.sum(F.col("_log") * c) / F.sum("c")).alias("_gm"))
    values = sided.join(F.broadcast(centre), "feature").select("feature", "value", "c", "_side", "_mean", (F.col("_log") - F.col("_gm")).alias("_l"), jac.alias("j")).persist()
    lo, hi, best = dict.fromkeys(features, interval[0]), dict.fromkeys(features, interval[1]), dict.fromkeys(features, 1.0)
    moves, narrowed = dict.fromkeys(features, 0), dict.fromkeys(features, 0)
    lam = F.col("lam")
    e = F.when(F.col("_side") == "down", 2.0 - lam).otherwise(lam)
    one_sided = F.when(F.abs(e) < 1e-12, F.col("_l")).otherwise(F.expm1(e * F.col("_l")) / e)
    shape = F.when(F.col("_side") == "both", yeo_johnson(x, lam) - yeo_johnson(F.col("_mean"), lam)).otherwise(one_sided)
    try:
        for _ in range(rounds + widenings):
            live = [f for f in features if narrowed[f] < rounds]
            if not live:
                break
            grid = spark.createDataFrame(
                [(f, m, float(g)) for f in live for m, g in enumerate(np.linspace(lo[f], hi[f], width))], "feature string, m int, lam double"
            )
            t = values.join(F.broadcast(grid), "feature").withColumn("t", shape)
            # Weighted variance about the weighted mean, from per-value moments.
            stats = t.groupBy("feature", "m", "lam").agg(
                F.sum("c").alias("n"), F.sum(c * F.col("j")).alias("jac"), (F.sum(c * F.col("t")) / F.sum("c")).alias("mu"), F.sum(c * F.col("t") * F.col("t")).alias("ss")
            )
            var = F.col("ss") / F.col("n") - F.col("mu") * F.col("mu")
            score = F.when(var > 0, -F.col("n") / 2.0 * F.log(var) + (F.col("lam") - 1.0) * F.col("jac")).otherwise(F.lit(float("-inf")))
            scored = stats.withColumn("score", F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(score))
            for r in scored.groupBy("feature").agg(F.max_by("m", F.struct("score", (-F.col("m")).alias("i"))).alias("m")).collect():
                f, m = r["feature"], r["m"]
                steps = np.linspace(lo[f], hi[f], width)
                best[f] = float(steps[m])
                if m in (0, width - 1) and not narrowed[f] and moves[f] < widenings:
                    span, step = hi[f] - lo[f], steps[1] - steps[0]  # the winner's other neighbour stays inside
                    lo[f], hi[f] = (best[f] - step, best[f] + span) if m else (best[f] - span, best[f] + step)
                    moves[f] += 1
                    continue
                lo[f], hi[f] = float(steps[max(m - 1, 0)]), float(steps[min(m + 1, width - 1)])
                narrowed[f] += 1
    finally:
        values.unpersist()
    return best


def fit_quantile(df: DataFrame, features: Sequence[str], knots: int = 1000) -> dict[str, list[float]]:
    """Evenly spaced quantiles per column (at most ``knots`` of them: a fixed-size model)."""
    n = df.count()
    m = max(2, min(knots, n))
    long = to_long(df.select(F.lit(0).alias("_k"), *[_seen(f).alias(f) for f in features]), ["_k"], features)
    model: dict[str, list[float]] = {f: [] for f in features}
    for row in exact_quantiles_long(long, list(np.linspace(0, 1, m))).orderBy("feature", "i").collect():
        model[row["feature"]].append(row["q"])
    return {f: k for f, k in model.items() if k}


def apply_quantile(df: DataFrame, model: dict[str, list[float]], output: str = "uniform") -> DataFrame:
    """Piecewise-linear rank of each value among the knots, ties averaged from both sides."""
    from statistics import NormalDist

    def placer(knots: list[float]):
        grid = np.asarray(knots)
        ref = np.linspace(0, 1, len(grid))

        @F.pandas_udf("double")
        def place(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype="float64")
            up = np.interp(v, grid, ref)
            down = -np.interp(-v, -grid[::-1], -ref[::-1])
            u = 0.5 * (up + down)
            if output == "normal":
                u = np.clip(u, 1e-7, 1 - 1e-7)
                u = np.array([NormalDist().inv_cdf(p) if np.isfinite(p) else np.nan for p in u])
            return pd.Series(u)

        return place

    return df.withColumns({f: placer(knots)(_x(f)) for f, knots in model.items()})


def transform(df: DataFrame, features: Sequence[str], method: str, **kwargs) -> DataFrame:
    if method in ELEMENTWISE:
        return df.withColumns({f: ELEMENTWISE[method](_x(f)) for f in features})
    if method in ("powertransformer", "yeo-johnson", "box-cox"):
        kind = "yeo-johnson" if method == "powertransformer" else method
        lam = fit_power(df, features, kind)
        shape = {"yeo-johnson": yeo_johnson, "box-cox": box_cox}[kind]
        shaped = df.withColumns({f: shape(_x(f), lam[f]) for f in features})
        return fit(shaped, features, "standardize").transform(shaped)
    if method == "quantiletransformer":
        return apply_quantile(df, fit_quantile(df, features), **kwargs)
    raise ValueError(f"unknown transform {method!r}")
