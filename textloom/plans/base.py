"""Registration of queries, the tables that they share, and common table expressions for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import stopwords, text
from textloom.operators import index as ix
from textloom.operators import ranking as rk
from textloom.scratch import materialize
from textloom.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_shared: dict[tuple, tuple] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its DuckDB SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def shared(name: str):
    """Keep what a function of (spark, sf_dir) returns as a written table, once for each context and input."""

    def wrap(f):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _shared:
                _shared[key] = materialize(f(spark, sf_dir), name)
            return _shared[key]

        return get

    return wrap


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_unique: dict[tuple, bool] = {}


def unique_ids(spark: SparkSession, sf_dir: str) -> bool:
    """Whether no two documents have the same id, so that what belongs to a document can be worked out within its row."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _unique:
        _unique[key] = docs(spark, sf_dir).groupBy("doc_id").count().where("count > 1").isEmpty()
    return _unique[key]


@shared("index")
def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, term, tf and dl: each file is sorted by term, so that its pages are skipped when a few terms are asked for.

    Where no two documents share an id, the postings are sorted where the documents are read and never dealt out.
    """
    if unique_ids(spark, sf_dir):
        return ix.row_index(docs(spark, sf_dir)).sortWithinPartitions("term", "doc_id")
    rows = ix.index(docs(spark, sf_dir))
    rows = rows.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id")))
    return rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, term and tf."""
    return _postings(spark, sf_dir).select("doc_id", "term", "tf")


@shared("vocabulary")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, df and cf of the index, sorted by term."""
    return ix.vocabulary(index(spark, sf_dir)).repartitionByRange("term").sortWithinPartitions("term")


@shared("ascii")
def ascii_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(ix.tokens(docs(spark, sf_dir), text.ASCII))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and query: the words of each benchmark passage that are longer than three letters."""
    words = F.filter(text.tokens(F.col("text"), text.SPANISH), lambda t: F.length(t) > 3)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(words, " ").alias("query"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.query_terms(topics(spark, sf_dir))


@shared("matched")
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.matched(_postings(spark, sf_dir), asked(spark, sf_dir), docs(spark, sf_dir), vocabulary(spark, sf_dir))


@shared("norms")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.norms(index(spark, sf_dir), docs(spark, sf_dir).count(), vocabulary(spark, sf_dir))


#: A passage's candidates share its run of words from the second on, of so many words; passages up to FEW are broadcast.
RUN, FEW = 8, 100_000


@shared("qrels")
def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and doc_id of documents that hold a topic's whole passage."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return containing(docs(spark, sf_dir).select("doc_id", "text"), passages)


def _runs(words: Column, n: int) -> Column:
    """The hashes of the runs of n words; the words are bound once."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    return F.transform(F.array(words), lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.lit(n), F.slice(w, i, F.lit(n)))))[0]


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """qid and doc_id of the documents (doc_id, text) that hold a passage (qid, passage).

    A passage's first and last word may be parts of words; candidates share the words between,
    RUN of them at most, as a run. Documents are met where they are read as long as the passages
    are few. Passages of one or two words have no word between and are looked for in every text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    held = passages.where("passage IS NOT NULL").withColumn("w", words("passage")).withColumn("length", F.least(F.lit(RUN), F.greatest(F.size("w") - 2, F.lit(0))))
    # a passage that begins with white space begins with a whole word, which is left out all the same
    held = held.select("qid", "passage", "length", F.xxhash64("length", F.slice("w", F.lit(2), F.col("length"))).alias("run"))
    held = materialize(held, "passages")
    lengths = [r["length"] for r in held.select("length").distinct().collect()]  # RUN + 1 values at most
    few = F.broadcast if held.count() <= FEW else lambda df: df
    found = []
    for n in lengths:
        some = few(held.where(F.col("length") == n))
        if not n:
            found.append(documents.join(some, F.contains("text", F.col("passage"))).select("qid", "doc_id"))
            continue
        runs = documents.select("doc_id", "text", F.explode(F.array_distinct(_runs(words("text"), n))).alias("run"))
        found.append(runs.join(some, "run").where(F.contains("text", F.col("passage"))).select("qid", "doc_id"))
    out = found[0] if found else documents.sparkSession.createDataFrame([], "qid long, doc_id long")
    for other in found[1:]:
        out = out.unionByName(other)
    return out.distinct()


# ---- the same in SQL


def log2_sql(x: str) -> str:
    return f"(ln({x}) / ln(2))"


def tokens_sql(pattern: str, lower: bool = True, name: str = "tok") -> str:
    return f"{name} AS (SELECT doc_id, unnest(regexp_extract_all({'lower(text)' if lower else 'text'}, '{pattern}')) AS term FROM documents)"


KEEP_SQL = f"length(term) > 3 AND length(term) <= 3000 AND term NOT IN ({stopwords.sql_list(stopwords.ENGLISH)})"
INDEX_SQL = f"""{tokens_sql(text.SPANISH)},
post AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE {KEEP_SQL} GROUP BY doc_id, term),
voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term)"""
ASCII_SQL = f"{tokens_sql(text.ASCII)}, post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term), voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term)"
TOPICS_SQL = f"""top AS (SELECT item_id AS qid, array_to_string(list_filter(regexp_extract_all(lower(text), '{text.SPANISH}'), lambda t: length(t) > 3), ' ') AS query FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '{text.SPANISH}')) AS term FROM top) WHERE {KEEP_SQL} GROUP BY qid, term)"""
MATCHED_SQL = f"""{INDEX_SQL}, {TOPICS_SQL},
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT CAST(sum(dl) AS BIGINT) FROM lens) AS c, (SELECT avg(dl) FROM lens) AS avdl),
m AS (SELECT qid, doc_id, term, tf, qtf, df, cf, dl, n_docs, c, avdl FROM qt JOIN post USING (term) JOIN voc USING (term) JOIN lens USING (doc_id), st)"""
QRELS_SQL = "qrels AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)"
