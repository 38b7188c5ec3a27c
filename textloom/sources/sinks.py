"""Writers of indexes, statistics and plotted series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import index as ix


def json_index(postings: DataFrame, path: str) -> None:
    """One object a line: term, df, cf and a map of documents to frequencies."""
    rows = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("doc_id").cast("string"), "tf")))).alias("postings"))
    rows.write.mode("overwrite").json(path)


def save_index(docs: DataFrame, postings: DataFrame, path: str) -> None:
    """Postings in ranges of term, sorted by term and document so that row groups can be skipped; vocabulary, documents, norms."""
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    saved = postings.sparkSession.read.parquet(f"{path}/postings")
    ix.vocabulary(saved).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    docs.drop("text").write.mode("overwrite").parquet(f"{path}/documents")
    ix.norms(saved, docs.count()).write.mode("overwrite").parquet(f"{path}/norms")


def term_file(vocabulary: DataFrame, path: str) -> None:
    """Lines `term cf df` in order of term."""
    vocabulary.select("term", "cf", "df").orderBy("term").write.mode("overwrite").option("sep", " ").csv(path)


def rank_frequencies(ranked: DataFrame, path: str) -> None:
    ranked.orderBy("rank").select("term", "freq").write.mode("overwrite").option("sep", " ").csv(path)


def language_file(results: DataFrame, path: str) -> None:
    """Lines `number language`; all of them."""
    results.orderBy("line_no").select("line_no", "lang").write.mode("overwrite").option("sep", " ").csv(path)


def piped_csv(rows: DataFrame, path: str) -> None:
    """Blank-separated with | as the quote."""
    rows.write.mode("overwrite").option("sep", " ").option("quote", "|").csv(path)


def statistics_file(docs: DataFrame, postings: DataFrame, path: str) -> None:
    """Seven lines `number value`: documents, tokens, terms, and least tokens, least terms, most tokens and most terms of a document."""
    each = postings.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count("*").alias("v"))
    sizes = each.agg(F.sum("n").alias("tokens"), F.min("n").alias("n0"), F.min("v").alias("v0"), F.max("n").alias("n1"), F.max("v").alias("v1"))
    whole = docs.agg(F.count("*").alias("docs")).crossJoin(sizes).crossJoin(postings.agg(F.countDistinct("term").alias("terms")))  # one row each
    values = F.array("docs", "tokens", "terms", "n0", "v0", "n1", "v1")
    lines = whole.select(F.posexplode(values).alias("at", "value")).select(F.concat_ws(" ", F.col("at") + 1, F.coalesce("value", F.lit(0))))
    lines.coalesce(1).write.mode("overwrite").text(path)


def extremes_files(vocabulary: DataFrame, path: str, k: int = 10) -> None:
    """The k most and least frequent terms with their frequency, below path/top and path/bottom."""
    for name, order in (("top", F.desc("cf")), ("bottom", F.asc("cf"))):
        vocabulary.select("term", "cf").orderBy(order, "term").limit(k).write.mode("overwrite").option("sep", " ").csv(f"{path}/{name}")


def viewer_files(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph for a viewer: JSON lines with id, label and color below path/nodes, from and to below path/edges."""
    nodes.select("id", "label", "color").write.mode("overwrite").json(f"{path}/nodes")
    edges.select(F.col("src").alias("from"), F.col("dst").alias("to")).write.mode("overwrite").json(f"{path}/edges")
