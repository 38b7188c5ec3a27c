"""Readers of corpora, topics, judgements, query logs and indexes in files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import html_text

FIXTURES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names=FIXTURES) -> None:
    """Register tables as views for spark.sql."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _files(spark: SparkSession, path: str, glob: str | None, recursive: bool, encoding: str = "UTF-8") -> DataFrame:
    reader = spark.read.option("encoding", encoding).option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_directory(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """doc_name and text of the *.txt files of one folder."""
    return _files(spark, path, "*.txt", False, encoding).select("doc_name", "text")


def html_directory(spark: SparkSession, path: str, every_file: bool = False, keep_path: bool = False) -> DataFrame:
    """doc_name (stem), html and text of the pages below a folder, and their path on request; with every_file whatever their extension."""
    found = _files(spark, path, None if every_file else "*.html", True)
    return found.select(F.regexp_replace("doc_name", "[.][^.]*$", "").alias("doc_name"), F.col("text").alias("html"), html_text(F.col("text")).alias("text"), *["path"] * keep_path)


def trec(spark: SparkSession, path: str) -> DataFrame:
    """docno (digits) and text of each <DOC>; documents without number or text are left out."""
    raw = spark.read.option("lineSep", "</DOC>").option("recursiveFileLookup", "true").text(path)
    docno = F.regexp_extract("value", r"<DOCNO>\s*(\d+)\s*</DOCNO>", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^.*?</DOCNO>", ""), r"</?DOC>", "")
    return raw.select(docno.alias("docno"), F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("text")).where("docno <> '' AND text <> ''")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """qid and query of each <top>; line ends become blanks, the last of equal numbers wins within a file."""
    raw = spark.read.option("lineSep", "</top>").text(path).withColumn("at", F.monotonically_increasing_id())
    qid = F.regexp_extract("value", r"(?s)<num>\s*(?:Number:)?\s*(\d+)", 1)
    title = F.regexp_extract("value", r"(?s)<title>(.*?)(?:</title>|$)", 1)
    found = raw.select("at", qid.alias("q"), F.trim(F.regexp_replace(title, r"\s+", " ")).alias("query")).where("q <> ''")
    return found.groupBy(F.col("q").cast("int").alias("qid")).agg(F.max_by("query", "at").alias("query"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, docno and label 1 of the lines with three fields or more."""
    return parse_qrels(spark.read.text(path))


def parse_qrels(lines: DataFrame) -> DataFrame:
    fields = lines.select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 3)
    return fields.select(F.col("f")[0].cast("int").alias("qid"), F.col("f")[2].alias("docno"), F.lit(1).alias("label"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    words = spark.read.text(path).select(F.explode(F.split(F.lower(F.trim("value")), r"\s+")).alias("term"))
    return words.where("term <> ''").distinct()


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """qid and query of lines `id:query`."""
    return spark.read.text(path).select(F.split("value", ":")[0].alias("qid"), F.trim(F.get(F.split("value", ":"), F.lit(1))).alias("query"))


def query_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("query"))


def rank_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", " ").schema("term string, freq long").csv(path)


def prebuilt_index(lines: DataFrame) -> DataFrame:
    """term, doc_id and tf = 1 from lines `term:df:id,id,...,`; blank lines are skipped."""
    parts = lines.where("trim(value) <> ''").select(F.split("value", ":", 3).alias("p"))
    ids = F.filter(F.split(F.col("p")[2], ","), lambda x: F.trim(x) != "")
    return parts.select(F.col("p")[0].alias("term"), F.explode(ids).alias("id")).select("term", F.trim("id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("tf"))


def language_samples(spark: SparkSession, path: str) -> DataFrame:
    """lang (file name) and text of training files in ISO-8859-1."""
    return _files(spark, path, None, False, "ISO-8859-1").select(F.regexp_replace("doc_name", "[.][^.]*$", "").alias("lang"), "text")


_ENTRY = "term string, df long, cf long, postings map<string, long>"
_SAVED = {"postings": "doc_id long, term string, tf long", "vocabulary": "term string, df long, cf long", "documents": "doc_id long", "norms": "doc_id long, norm double"}


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What read() gives, or an empty table if nothing is there or none of it can be read as a table."""
    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def json_index(spark: SparkSession, path: str) -> DataFrame:
    """term, df, cf, doc_id and tf from an index written by sinks.json_index; a missing one is empty, lines that are no entries are left out."""
    raw = _or_empty(spark, lambda: spark.read.schema(_ENTRY).json(path), _ENTRY).where("term IS NOT NULL AND postings IS NOT NULL")
    return raw.select("term", "df", "cf", F.explode("postings").alias("doc_id", "tf")).withColumn("doc_id", F.col("doc_id").cast("long"))


def saved_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index written by sinks.save_index, empty ones where it is missing; lists of a term are found by pushed-down filters on term."""
    return {name: _or_empty(spark, lambda name=name: spark.read.parquet(f"{path}/{name}"), schema) for name, schema in _SAVED.items()}
