"""Readers of the input tables that the queries of this folder share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The white space between words, as a Java regular expression's character class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def slices(sizes: list[int], most: int):
    """Ranges of rows whose sizes add up to `most` at most, one row at least."""
    start, room = 0, 0
    for at, size in enumerate(sizes):
        if at > start and room + size > most:
            yield start, at
            start, room = at, 0
        room += size
    if start < len(sizes):
        yield start, len(sizes)
