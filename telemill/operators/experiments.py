"""Statistics of benchmark suites: baselines, Welch tests, effect sizes, verdicts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGHER_BETTER = ("throughput", "completed")


def best_baseline(summary: DataFrame, arm: str = "predictive", higher: tuple[str, ...] = HIGHER_BETTER) -> DataFrame:
    """Per scenario and metric the best other arm by mean (ties: first by name), and the arm's difference from it in per cent (null at 0)."""
    sign = F.when(F.col("metric").isin(*higher), -1.0).otherwise(1.0)
    others = summary.where(F.col("strategy") != arm).groupBy("scenario", "metric").agg(
        F.min_by(F.struct("strategy", "mean", "std", "n"), F.struct(sign * F.col("mean"), "strategy")).alias("b")
    )
    own = summary.where(F.col("strategy") == arm).select("scenario", "metric", F.col("mean").alias("arm_mean"), F.col("std").alias("arm_std"), F.col("n").alias("arm_n"))
    joined = others.join(own, ["scenario", "metric"])
    diff = F.when(F.col("b.mean") != 0, 100.0 * (F.col("arm_mean") - F.col("b.mean")) / F.abs("b.mean"))
    return joined.select(
        "scenario", "metric", F.col("b.strategy").alias("baseline"), F.col("b.mean").alias("base_mean"), F.col("b.std").alias("base_std"), F.col("b.n").alias("base_n"),
        "arm_mean", "arm_std", "arm_n", diff.alias("diff_pct"),
    )


def _beta_cf(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def welch_cohen(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> dict[str, Column]:
    """t, df, p and d as columns; null below two values a side, p is 1 or 0 where nothing varies, d is 0 at no pooled deviation.

    Only p needs Python: one value per scenario and metric.
    """
    enough = (n1 >= 2) & (n2 >= 2)
    v1, v2 = s1 * s1 / n1, s2 * s2 / n2
    se = F.sqrt(v1 + v2)
    t = F.when(enough & (se > 0), (m1 - m2) / se)
    df = F.when(enough & (se > 0), (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)))

    @F.pandas_udf("double")
    def p_value(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) if a == a and b == b else None for a, b in zip(ts.astype(float), dfs.astype(float), strict=True)], dtype="float64")

    p = F.when(~enough, None).when(se > 0, p_value(t, df)).otherwise(F.when(m1 == m2, 1.0).otherwise(0.0))
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))
    d = F.when(enough, F.when(pooled > 0, (m1 - m2) / pooled).otherwise(0.0))
    return {"t": t, "df": df, "p": p, "d": d}


def compare_arms(best: DataFrame) -> DataFrame:
    made = welch_cohen(*[F.col(c) for c in ("arm_mean", "arm_std", "arm_n", "base_mean", "base_std", "base_n")])
    return best.withColumns(made)


def headlines(compared: DataFrame, metrics: list[str], alpha: float = 0.05, higher: tuple[str, ...] = HIGHER_BETTER) -> DataFrame:
    """A verdict per scenario and metric: better or worse only at p < alpha, else no difference."""
    good = F.when(F.col("metric").isin(*higher), F.col("diff_pct") > 0).otherwise(F.col("diff_pct") < 0)
    verdict = F.when(F.col("diff_pct").isNull() | F.col("p").isNull() | (F.col("p") >= alpha) | (F.col("diff_pct") == 0), "no difference").when(good, "better").otherwise("worse")
    return compared.where(F.col("metric").isin(*metrics)).select("scenario", "metric", "baseline", "diff_pct", verdict.alias("verdict"))


def radar_scores(summary: DataFrame, higher: tuple[str, ...] = HIGHER_BETTER) -> DataFrame:
    """Mean over scenarios of each strategy's scaled mean (1 the best of its scenario, 0 the worst, 1 where all are equal)."""
    own = Window.partitionBy("scenario", "metric")
    low, high = F.min("mean").over(own), F.max("mean").over(own)
    scaled = F.when(high == low, 1.0).when(F.col("metric").isin(*higher), (F.col("mean") - low) / (high - low)).otherwise((high - F.col("mean")) / (high - low))
    return summary.withColumn("_s", scaled).groupBy("strategy", "metric").agg(F.avg("_s").alias("score"))
