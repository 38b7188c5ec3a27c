"""Queries through files: each writes a corpus, judgements or an index in a format of its own and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import stopwords, text
from textloom.operators import index as ix
from textloom.operators import stats
from textloom.plans import corpus, retrieval
from textloom.plans.base import ASCII_SQL, INDEX_SQL, QRELS_SQL, QUERIES, TOPICS_SQL, ascii_postings, asked, docs, index, qrels, query, topics, vocabulary
from textloom.scratch import folder
from textloom.sources import readers, sinks
from textloom.sources.readers import table


def _lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = folder(spark, name)
    lines.write.text(path)
    return path


_SPACE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id"), F.lit(" </DOCNO>\n"), F.coalesce("text", F.lit("")), F.lit("\n</DOC>"))
    return readers.trec(spark, _lines(spark, docs(spark, sf_dir).select(form), "trec"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS docno, md5(t) AS digest FROM (SELECT doc_id, {_SPACE.format('text')} AS t FROM documents) WHERE t <> ''")
def file_trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TREC corpus of the documents."""
    return _trec(spark, sf_dir).select("docno", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {INDEX_SQL} SELECT doc_id, term, tf FROM post")
def file_trec_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a TREC corpus."""
    return ix.index(_trec(spark, sf_dir).select(F.col("docno").cast("long").alias("doc_id"), "text"))


@query(r"SELECT CAST(item_id AS INTEGER) AS qid, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM benchmark")
def file_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.concat(F.lit("<top>\n<num>"), F.col("item_id"), F.lit("</num>\n<title>"), F.col("text"), F.lit("</title>\n</top>"))
    return readers.topics(spark, _lines(spark, table(spark, sf_dir, "benchmark").select(form), "topics"))


@query(f"WITH {QRELS_SQL} SELECT CAST(qid AS INTEGER) AS qid, CAST(doc_id AS VARCHAR) AS docno, 1 AS label FROM qrels")
def file_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.qrels(spark, _lines(spark, qrels(spark, sf_dir).select(F.concat_ws(" ", "qid", F.lit(0), "doc_id", F.lit(1))), "qrels"))


@query(f"SELECT unnest([{stopwords.sql_list(stopwords.SPANISH)}]) AS term")
def file_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array(*(F.lit(w.upper()) for w in stopwords.SPANISH)))
    return readers.stop_words(spark, _lines(spark, spark.range(1).select(words), "stop-words"))


@query(f"WITH {TOPICS_SQL} SELECT CAST(qid AS VARCHAR) AS qid, query FROM top")
def file_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.query_log(spark, _lines(spark, topics(spark, sf_dir).select(F.concat_ws(":", "qid", "query")), "log"))


@query(f"WITH {TOPICS_SQL} SELECT query FROM top WHERE query <> ''")
def file_query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.query_list(spark, _lines(spark, topics(spark, sf_dir).select(F.concat(F.lit(" "), "query")), "queries"))


@query("SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages")
def file_html_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of folders with a page in each; every file is a page whatever its extension."""
    path = folder(spark, "html")
    table(spark, sf_dir, "pages").select("page_id", "html").repartition("page_id").write.partitionBy("page_id").text(path)
    found = readers.html_directory(spark, path, every_file=True, keep_path=True)
    page = F.regexp_replace("html", "\n$", "")  # the writer ends every line
    return found.select(F.regexp_extract("path", "page_id=(\\d+)", 1).cast("long").alias("page_id"), F.length(page).cast("long").alias("n_chars"), F.md5(page.cast("binary")).alias("digest"))


@query(f"WITH {INDEX_SQL} SELECT term, df, cf, doc_id, tf FROM post JOIN voc USING (term)")
def file_json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "json-index")
    sinks.json_index(index(spark, sf_dir), path)
    return readers.json_index(spark, path)


@query(f"WITH {INDEX_SQL}, {retrieval._NORMS} SELECT doc_id, term, tf, df, round(norm, 6) AS norm FROM post JOIN voc USING (term) JOIN nr USING (doc_id) JOIN (SELECT doc_id FROM documents) USING (doc_id)")
def file_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of a saved index, joined."""
    path = folder(spark, "saved-index")
    sinks.save_index(docs(spark, sf_dir), index(spark, sf_dir), path)
    saved = readers.saved_index(spark, path)
    rows = saved["postings"].join(saved["vocabulary"].select("term", "df"), "term").join(saved["norms"], "doc_id").join(saved["documents"].select("doc_id"), "doc_id")
    return rows.select("doc_id", "term", "tf", "df", F.round("norm", 6).alias("norm"))


@query(f"WITH {ASCII_SQL} SELECT term || ' ' || cf || ' ' || df AS line FROM voc")
def file_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "terms")
    sinks.term_file(ix.vocabulary(ascii_postings(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {ASCII_SQL} SELECT term, CAST(cf AS BIGINT) AS freq FROM voc")
def file_rank_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "ranks")
    sinks.rank_frequencies(stats.rank_freq(ascii_postings(spark, sf_dir)), path)
    return readers.rank_frequencies(spark, path)


@query(f"{corpus._LANGID} SELECT doc_id || ' ' || pred AS line FROM best")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "languages")
    sinks.language_file(corpus.langid(spark, sf_dir).select(F.col("doc_id").alias("line_no"), F.col("pred").alias("lang")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {TOPICS_SQL} SELECT qid, query FROM top")
def file_piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-separated fields in pipes."""
    path = folder(spark, "piped")
    sinks.piped_csv(topics(spark, sf_dir), path)
    return spark.read.option("sep", " ").option("quote", "|").option("emptyValue", "").schema("qid long, query string").csv(path).fillna("")


_STATISTICS = """SELECT unnest([(SELECT count(*) FROM documents), (SELECT count(*) FROM tok), (SELECT count(*) FROM voc),
    (SELECT min(n) FROM z), (SELECT min(v) FROM z), (SELECT max(n) FROM z), (SELECT max(v) FROM z)]) AS value, unnest(range(1, 8)) AS line"""


@query(f"WITH {ASCII_SQL}, z AS (SELECT doc_id, count(*) AS n, count(DISTINCT term) AS v FROM tok GROUP BY doc_id) {_STATISTICS}")
def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven lines: documents, tokens, terms, and least and most tokens and terms of a document."""
    path = folder(spark, "statistics")
    sinks.statistics_file(docs(spark, sf_dir), ascii_postings(spark, sf_dir), path)
    return spark.read.text(path).select(F.split("value", " ")[0].cast("long").alias("line"), F.split("value", " ")[1].cast("long").alias("value"))


@query(f"""WITH {ASCII_SQL}, r AS (SELECT term, CAST(cf AS BIGINT) AS cf, row_number() OVER (ORDER BY cf DESC, term) AS t, row_number() OVER (ORDER BY cf, term) AS b FROM voc)
  SELECT 'top' AS list, term, cf FROM r WHERE t <= 10 UNION ALL SELECT 'bottom', term, cf FROM r WHERE b <= 10""")
def file_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most and least frequent terms, one file each."""
    path = folder(spark, "extremes")
    sinks.extremes_files(ix.vocabulary(ascii_postings(spark, sf_dir)), path)
    read = lambda name: spark.read.option("sep", " ").schema("term string, cf long").csv(f"{path}/{name}").select(F.lit(name).alias("list"), "term", "cf")
    return read("top").union(read("bottom"))


_NAME = "source || '-' || doc_id"


@query(f"WITH {INDEX_SQL} SELECT term, {_NAME} AS doc_name, tf FROM post JOIN documents USING (doc_id) WHERE source IS NOT NULL")
def named_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with the documents' names."""
    names = docs(spark, sf_dir).where("source IS NOT NULL").select("doc_id", F.concat_ws("-", "source", "doc_id").alias("doc_name"))
    return ix.named(index(spark, sf_dir), names)


@query(f"""{retrieval.CTES}, {retrieval._top_sql(retrieval.RUN_SQL['rank_daat_cosine'], 10)}
  SELECT qid, rank, printf('%2d  %-30s %.6f', rank, {_NAME}, CAST(score AS DOUBLE)) AS line FROM run JOIN documents USING (doc_id)""")
def ranking_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to show for each query: place, name and score of its best documents."""
    run = QUERIES["rank_daat_cosine"](spark, sf_dir)
    named = ix.named(run, docs(spark, sf_dir).select("doc_id", F.concat_ws("-", "source", "doc_id").alias("doc_name")))
    return named.select("qid", "rank", F.format_string("%2d  %-30s %.6f", "rank", "doc_name", "score").alias("line"))


@query(f"""WITH {INDEX_SQL}, {TOPICS_SQL}, q AS (SELECT qid, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings FROM qt JOIN voc USING (term) GROUP BY qid)
  SELECT min(n_terms) AS least_terms, max(n_terms) AS most_terms, min(n_postings) AS least_postings, max(n_postings) AS most_postings FROM q""")
def query_length_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most known terms of a query, and postings that it reads."""
    each = asked(spark, sf_dir).join(vocabulary(spark, sf_dir), "term").groupBy("qid").agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return each.agg(*(f(f"n_{c}").alias(f"{name}_{c}") for c in ("terms", "postings") for name, f in (("least", F.min), ("most", F.max))))


@query(f"SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(text), '{text.ASCII}')) % 2 = 0 THEN 'unknown' ELSE 'odd' END AS lang FROM documents")
def language_by_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook for a library of one's own, here a stand-in that fails on every other text; failures are `unknown`."""
    from textloom.operators import profiles

    return profiles.by_library(docs(spark, sf_dir).select("doc_id", "text"), _stand_in)


def _stand_in(text: str) -> str:
    import re

    if len(re.findall("[a-z]+", text.lower())) % 2 == 0:
        raise ValueError("no features in text")
    return "odd"
