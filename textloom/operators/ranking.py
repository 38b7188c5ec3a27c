"""Ranked retrieval: one plan of joins, one weight expression a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import log2
from textloom.operators.index import keep_terms, postings, tokens
from textloom.scratch import materialize


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """qid, term and qtf by the index's own tokenizer and filters."""
    found = keep_terms(tokens(queries, column=query, key="qid"))
    return postings(found, "qid").withColumnRenamed("tf", "qtf")


#: Terms of all queries up to which they are broadcast.
FEW = 200_000


def matched(index: DataFrame, asked: DataFrame, docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Each posting of a query term with qtf, df, cf, dl and the one-row statistics n_docs, c (tokens) and avdl.

    Document lengths are those of the index, taken from its column dl if it has one. Terms without postings fall away.
    """
    vocab = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")) if vocabulary is None else vocabulary
    length = index.groupBy("doc_id").agg((F.max("dl") if "dl" in index.columns else F.sum("tf")).alias("dl"))
    whole = docs.agg(F.count("*").alias("n_docs")).crossJoin(length.agg(F.sum("dl").alias("c"), F.avg("dl").alias("avdl")))
    known = materialize(asked.join(vocab, "term"), "asked")
    if known.count() <= FEW:  # a broadcast, so that frequent terms are met where their postings lie
        known = F.broadcast(known)
    found = index.join(known, "term")
    found = found if "dl" in index.columns else found.join(length, "doc_id")
    return found.where("doc_id IS NOT NULL").crossJoin(F.broadcast(whole))  # one row


def ranking(matched: DataFrame, weight: Column, plus: Column | None = None, where: Column | None = None) -> DataFrame:
    """qid, doc_id and score: the sum of weight over the terms, and plus (of the document) once."""
    rows = matched if where is None else matched.where(where)
    total = F.sum(weight) if plus is None else F.sum(weight) + F.max(plus)
    return rows.groupBy("qid", "doc_id").agg(total.alias("score"))


def _tf(c: str = "tf") -> Column:
    return 1 + log2(F.col(c))


def idf() -> Column:
    return log2(F.col("n_docs") / F.col("df"))


def dot_product() -> Column:
    """Weights 1 + log2 tf, log2 N/df and 1 + log2 qtf."""
    return _tf() * idf() * _tf("qtf")


def divided() -> Column:
    """The skip index's own weight: divided by the idf."""
    return _tf() / idf() * _tf("qtf")


def vector(df_only: bool = True) -> Column:
    """(1 + log10 tf) * log10(df, or N/df) * qtf."""
    return (1 + F.log10("tf")) * F.log10(F.col("df") if df_only else F.col("n_docs") / F.col("df")) * F.col("qtf")


def cosine(matched: DataFrame, doc_norms: DataFrame, asked: DataFrame, vocabulary: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosine of query and document; terms that all documents hold are skipped."""
    vocab = vocabulary.select("term", "df").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))
    w = _tf("qtf") * idf()
    query_norms = asked.join(vocab, "term").where("df < n_docs").groupBy("qid").agg(F.sqrt(F.sum(w * w)).alias("q_norm"))
    dots = ranking(matched, _tf() * idf() * w, where=F.col("df") < F.col("n_docs"))
    return dots.join(doc_norms, "doc_id").join(query_norms, "qid").select("qid", "doc_id", (F.col("score") / (F.col("norm") * F.col("q_norm"))).alias("score"))


def bm25(k1: float = 1.2, b: float = 0.75) -> Column:
    inverse = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return inverse * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avdl"))) * F.col("qtf")


def robertson_tfidf(k1: float = 1.2, b: float = 0.75) -> Column:
    tf = F.col("tf") * k1 / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avdl")))
    return tf * log2(F.col("n_docs") / F.col("df") + 1) * F.col("qtf")


def dirichlet(mu: float = 2000.0) -> Column:
    return F.col("qtf") * log2(1 + F.col("tf") / (mu * F.col("cf") / F.col("c")))


def dirichlet_length(query_length: Column, mu: float = 2000.0) -> Column:
    return query_length * log2(F.lit(mu) / (F.col("dl") + mu))


def hiemstra(lam: float = 0.6) -> Column:
    return F.col("qtf") * log2(1 + lam * F.col("tf") * F.col("c") / ((1 - lam) * F.col("cf") * F.col("dl")))


def top(run: DataFrame, k: int, by: list[str] | str = "qid") -> DataFrame:
    """The k best of each query with their rank, ties to the smaller document."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return run.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
