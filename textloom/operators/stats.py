"""Distribution laws: Zipf's and Heaps', profiles and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.scan import ordered_scan


def rank_freq(postings: DataFrame) -> DataFrame:
    """rank, term and freq, most frequent first, ties by term."""
    freq = postings.groupBy("term").agg(F.sum("tf").alias("freq"))
    return ordered_scan(freq, [F.desc("freq"), F.asc("term")], number="rank").select("rank", "term", "freq")


def zipf_fit(ranked: DataFrame) -> DataFrame:
    """Slope, intercept and R2 of ln f over ln r."""
    y, x = F.ln("freq"), F.ln("rank")
    return ranked.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def zipf_estimate(ranked: DataFrame, offset: float = 0.119, per_cent: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    """For each share of the vocabulary: tokens by the law (rounded half to even) and in fact."""
    whole = ranked.agg(F.count("*").alias("v"), F.max("freq").alias("top"))
    shares = whole.select("top", "v", F.explode(F.array(*map(F.lit, per_cent))).alias("per_cent"))
    shares = shares.withColumn("top_n", F.floor(F.col("v") * F.col("per_cent") / 100).cast("long"))
    joined = ranked.crossJoin(F.broadcast(shares)).where("rank <= top_n")  # one row a share
    law = F.bround(F.sum(F.col("top") / (F.col("rank") - 1 + offset)), 0).cast("long")
    return joined.groupBy("per_cent", "top_n").agg(law.alias("estimated"), F.sum("freq").alias("real"))


def heaps_curve(tokens: DataFrame) -> DataFrame:
    """Tokens and distinct terms up to the end of each document, documents in order of id."""
    size = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    fresh = tokens.groupBy("term").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("v"))
    steps = size.join(fresh, "doc_id", "left").fillna(0, ["v"])
    placed = ordered_scan(steps, ["doc_id"], {"n0": "n", "v0": "v"})
    return placed.select("doc_id", (F.col("n0") + F.col("n")).alias("n_tokens"), (F.col("v0") + F.col("v")).alias("n_unique"))


def heaps_seed(curve: DataFrame) -> DataFrame:
    """beta and ln K by least squares on logarithms."""
    y, x = F.ln("n_unique"), F.ln("n_tokens")
    return curve.agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("ln_k"), F.regr_r2(y, x).alias("r2"))


def heaps_fit(curve: DataFrame, steps: int = 12) -> tuple[float, float, float]:
    """K, beta and R2 of V = K * N^beta by Gauss-Newton; each step is one aggregation of the normal equations."""
    seed = heaps_seed(curve).first()
    if seed.beta is None:
        return float("nan"), float("nan"), float("nan")
    k, beta = math.exp(seed.ln_k), float(seed.beta)
    for _ in range(steps):
        p = F.pow("n_tokens", F.lit(beta))
        a, b, r = p, F.lit(k) * p * F.ln("n_tokens"), F.col("n_unique") - F.lit(k) * p
        s = curve.agg(*(F.sum(x * y) for x, y in ((a, a), (a, b), (b, b), (a, r), (b, r)))).first()
        det = s[0] * s[2] - s[1] * s[1]
        if not det:
            break
        k, beta = k + (s[2] * s[3] - s[1] * s[4]) / det, beta + (s[0] * s[4] - s[1] * s[3]) / det
    r = F.col("n_unique") - F.lit(k) * F.pow("n_tokens", F.lit(beta))
    s = curve.agg(F.sum(r * r), F.var_pop("n_unique") * F.count("*")).first()
    return k, beta, 1 - s[0] / s[1] if s[1] else float("nan")


def min_max(profile: DataFrame, keys: list[str], value: str = "f") -> DataFrame:
    """value scaled to 0..1 within keys; 0.5 where all are equal."""
    own = Window.partitionBy(*keys)
    low, high = F.min(value).over(own), F.max(value).over(own)
    return profile.withColumn(value, F.when(high == low, 0.5).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0))))


def histogram(values: DataFrame, keys: list[str], value: str = "value", bins: int = 15) -> DataFrame:
    """Counts in equal bins from the least to the greatest value of each key; the last bin is closed."""
    ends = values.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width: Column = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    place = F.coalesce(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / width * bins)), F.lit(0)).cast("long")
    return values.join(ends, keys).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
