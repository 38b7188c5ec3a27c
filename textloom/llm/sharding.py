"""Sharding by a two-pass external shuffle, with built-in functions only.

Pass 1 scatters whole records into buckets by a seeded hash; there are as many buckets
as keep each within BUCKET_ROWS rows and BUCKET_BYTES bytes on average, so one fits in
a task's memory. Pass 2 shuffles each bucket by Fisher-Yates (Spark's seeded shuffle()
of its places) and lays the buckets end to end. A record's shard is its place modulo the
number of shards and its slot the quotient: the law `rows`, counts at most one apart,
slots without gaps. write_shards() writes each bucket's records from the task that
shuffled it, so records are dealt out once.

Records that are equal share a hash. Groups of more than half a bucket are collapsed to
one row and a number (before they are shuffled), numbered, and scattered by the number
too, so a record that is a third of the input spreads evenly; smaller groups go into
one bucket.

A bucket is sorted by hash before it is shuffled. Which task shuffles a bucket, and in
which order, follows from the number of buckets alone, and so do the permutations from
the seed and the records: reruns agree, whatever the partition settings, as do tasks
repeated after the loss of an executor.

Defined results: a null text has no bytes and the CRC of the empty text; rows that are
equal in all columns get places of their own; a null doc_id is an ordinary value; an
empty table gives an empty table; no column names clash, since the records travel as
one struct, and are written as one column `record` if they have a column `shard` or
`slot`. Columns of a map type cannot be hashed and raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.tables import table
from textloom.scratch import folder, materialize

SHARDS = 24
SEED = 42
BUCKET_ROWS = 8_192
BUCKET_BYTES = 64 << 20
#: Partitions that the buckets are dealt to, at most; a partition shuffles its buckets one after the other.
PARTITIONS = 32_768


def _hashed(records: DataFrame, seed: int) -> DataFrame:
    hashes = [F.xxhash64(F.lit(seed + i), *records.columns).alias(f"h{i}") for i in (0, 1)]  # 128 bits: no two records share both
    return records.select(F.struct(*records.columns).alias("record"), *hashes)


def _bytes(hashed: DataFrame) -> Column:
    fields = hashed.schema["record"].dataType.fields
    strings = [f.name for f in fields if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(64).cast("long")
    for name in strings:
        size = size + F.coalesce(F.octet_length(F.col("record")[name]), F.lit(0))
    return size


def _copies(groups: DataFrame, some: int = 10_000) -> DataFrame:
    """Each row (h0, h1, n and others) n times, with `copy` from 1; many copies are made by many tasks."""
    parts = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / some))).alias("part")).repartition("h0", "h1", "part")
    first = F.col("part") * some
    return parts.select(*groups.columns, F.explode(F.sequence(first + 1, F.least(F.col("n"), first + some))).alias("copy"))


def shuffle_into_shards(records: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of records as `record`, with `shard` and `slot`."""
    hashed = _hashed(records, seed)
    counts = materialize(hashed.groupBy("h0", "h1").agg(F.count("*").alias("n"), F.sum(_bytes(hashed)).alias("b")), "shard-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    buckets = max(1, -(-(total["n"] or 0) // bucket_rows), -(-(total["b"] or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64("h0", "h1", "copy", F.lit(seed + 2)), F.lit(buckets))
    # groups of more than half a bucket: fewer than 2 * rows / bucket_rows of them
    is_large = F.col("n") > bucket_rows // 2
    dealt = hashed.withColumn("copy", F.lit(0).cast("long"))
    numbers = counts.where(~is_large).select("h0", "h1", "n", F.lit(0).cast("long").alias("copy"))
    if not counts.where(is_large).isEmpty():
        large = materialize(counts.where(is_large).select("h0", "h1", "n"), "shard-large")
        numbers = numbers.unionByName(_copies(large).withColumn("n", F.lit(1).cast("long")))
        own = hashed.join(large.drop("n"), ["h0", "h1"], "left_semi").groupBy("record", "h0", "h1").agg(F.count("*").alias("n"))
        own = _copies(own).drop("n")
        dealt = dealt.join(large, ["h0", "h1"], "left_anti").select(*own.columns).unionByName(own)
    sizes = materialize(numbers.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")), "shard-buckets")
    starts = sizes.select("bucket", "n", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))  # one row a bucket
    partitions = min(buckets, PARTITIONS)
    scattered = dealt.withColumn("bucket", bucket).repartition(partitions, "bucket")
    order = Window.partitionBy("bucket").orderBy("h0", "h1", "copy")
    scattered = scattered.withColumn("nth", F.row_number().over(order))
    # shuffle() draws one sequence a partition: the number of partitions and the order in them are the data's own
    places = starts.repartition(partitions, "bucket").sortWithinPartitions("bucket").select("bucket", "start", F.expr(f"shuffle(sequence(0, CAST(n AS INT) - 1), {seed})").alias("place"))
    placed = scattered.join(places, "bucket").select("record", (F.col("start") + F.element_at("place", F.col("nth"))).alias("place"))
    return placed.select("record", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(records: DataFrame, path: str, **options) -> None:
    """Write records to path/shard=N/; a file holds its records in the order of their slots."""
    dealt = shuffle_into_shards(records, **options)
    laid = dealt if {"shard", "slot"} & set(records.columns) else dealt.select("record.*", "shard", "slot")
    laid.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards whole documents, and reads the digests from what was written."""
    path = folder(spark, "shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    write_shards(docs, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    written = spark.read.parquet(path)
    return written.select("doc_id", size, crc, F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
