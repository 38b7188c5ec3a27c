"""Evaluation of runs against judgements, and agreement of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import log2


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run (qid, doc_id, rank, ...) with relevant 0 or 1."""
    marks = qrels.select("qid", "doc_id", F.lit(1).alias("label")).distinct()
    return run.join(marks, ["qid", "doc_id"], "left").withColumn("relevant", F.coalesce("label", F.lit(0)).cast("long")).drop("label")


def relevant_counts(qrels: DataFrame) -> DataFrame:
    return qrels.select("qid", "doc_id").distinct().groupBy("qid").agg(F.count("*").alias("n_relevant"))


def precision_recall(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, rank, relevant, hits, precision and recall at every rank of the queries that have judgements."""
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged(run, qrels).join(relevant_counts(qrels), "qid").withColumn("hits", F.sum("relevant").over(order))
    return rows.select("qid", "doc_id", "rank", "relevant", "hits", "n_relevant", (F.col("hits") / F.col("rank")).alias("precision"), (F.col("hits") / F.col("n_relevant")).alias("recall"))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, ap, ndcg and p_at_k; queries with judgements but no results get zeros."""
    rows = precision_recall(run, qrels)
    sums = rows.groupBy("qid").agg(
        F.sum(F.col("precision") * F.col("relevant")).alias("hit_precision"),
        F.sum(F.col("relevant") / log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0)).alias("first"),
    )
    totals = relevant_counts(qrels)
    ideal = totals.select("qid", F.explode(F.sequence(F.lit(1).cast("long"), "n_relevant")).alias("i")).groupBy("qid").agg(F.sum(1 / log2(F.col("i") + 1)).alias("idcg"))
    out = totals.join(ideal, "qid").join(sums, "qid", "left").fillna(0)
    return out.select("qid", (F.col("hit_precision") / F.col("n_relevant")).alias("ap"), (F.col("dcg") / F.col("idcg")).alias("ndcg"), (F.col("first") / k).alias("p_at_k"))


def long_form(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot("qid", ["ap", "ndcg", "p_at_k"], "measure", "value")


def curve(run: DataFrame, qrels: DataFrame, zero_fill: bool = False) -> DataFrame:
    """qid, level (0 to 10 tenths) and precision: the best precision at that recall or more.

    Beyond the greatest recall the last level's value is carried on, or 0 with zero_fill.
    """
    levels = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("level")
    asked = relevant_counts(qrels).select("qid", levels)
    rows = precision_recall(run, qrels).select("qid", "precision", F.floor(F.col("hits") * 10 / F.col("n_relevant")).cast("long").alias("reached"))
    best = rows.groupBy("qid", "reached").agg(F.max("precision").alias("precision"))
    from_here = Window.partitionBy("qid").orderBy("level").rowsBetween(0, Window.unboundedFollowing)
    so_far = Window.partitionBy("qid").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    at = asked.join(best, (asked["qid"] == best["qid"]) & (asked["level"] == best["reached"]), "left").select(asked["qid"], "level", "precision")
    value = at.withColumn("precision", F.max("precision").over(from_here))
    if not zero_fill:
        value = value.withColumn("precision", F.last("precision", True).over(so_far))
    return value.withColumn("precision", F.coalesce("precision", F.lit(0.0)))


def correlation(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Spearman's rho and Kendall's tau-b of two runs over the first k documents of a that b has too; queries with fewer are left out."""
    by_a = Window.partitionBy("qid").orderBy(F.desc("x"), "doc_id")
    both = a.select("qid", "doc_id", F.col("score").alias("x")).join(b.select("qid", "doc_id", F.col("score").alias("y")), ["qid", "doc_id"])
    first = both.withColumn("r", F.row_number().over(by_a)).where(F.col("r") <= k)
    first = first.withColumn("n", F.count("*").over(Window.partitionBy("qid"))).where(F.col("n") == k)

    def ranks(c: str):
        own = Window.partitionBy("qid")
        return F.rank().over(own.orderBy(F.desc(c))) + (F.count("*").over(own.orderBy(F.desc(c)).rangeBetween(0, 0)) - 1) / 2

    ranked = first.withColumn("rx", ranks("x").cast("double")).withColumn("ry", ranks("y").cast("double"))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    p, q = ranked.alias("p"), ranked.alias("q")
    pairs = p.join(q, (F.col("p.qid") == F.col("q.qid")) & (F.col("p.r") < F.col("q.r")))  # k * (k - 1) / 2 a query
    sx, sy = F.signum(F.col("p.rx") - F.col("q.rx")), F.signum(F.col("p.ry") - F.col("q.ry"))
    tau = F.try_divide(F.sum(sx * sy), F.sqrt(F.sum(F.abs(sx)) * F.sum(F.abs(sy))))
    return ranked.groupBy("qid").agg(rho.alias("rho")).join(pairs.groupBy(F.col("p.qid").alias("qid")).agg(tau.alias("tau")), "qid")


def overlap(a: DataFrame, b: DataFrame, step: int = 10, limit: int = 501) -> DataFrame:
    """k and the share of the first k of two orders (id, rank) that they have in common, k = step, 2 step, ... below limit and the size."""
    n = a.count()
    ks = list(range(step, min(limit, n), step))
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id").select(F.greatest("ra", "rb").alias("at"))
    counts = both.where(F.col("at") < limit).groupBy("at").agg(F.count("*").alias("n"))  # at most `limit` rows
    series = a.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ks)).cast("array<bigint>")).alias("k"))
    return series.join(F.broadcast(counts), counts["at"] <= series["k"], "left").groupBy("k").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.col("k")).alias("overlap"))
