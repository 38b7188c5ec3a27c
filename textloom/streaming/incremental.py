"""An index that grows with a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import index as ix


def grow(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the postings of each micro-batch to path/batch=N; a batch that is run again replaces its own folder only."""

    def append(batch: DataFrame, number: int) -> None:
        ix.index(batch).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The postings so far; a document that came again counts as its last batch has it."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi").select("doc_id", "term", "tf")
