"""Language identification by character-pair profiles and Pearson's correlation."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators.stats import min_max
from textloom.session import ship

UNKNOWN = "unknown"


def grams(docs: DataFrame, *keys: str, column: str = "text", pairs: bool = True) -> DataFrame:
    """keys and grams of each row: item and n of its character pairs (or characters), counted within the row."""
    found = (text.pairs if pairs else text.code_points)(F.col(column))
    return docs.select(*keys, text.without_blanks(text.counted(found)).alias("grams"))


def profile(docs: DataFrame, key: str, column: str = "text", pairs: bool = True) -> DataFrame:
    """key, gram and f: the frequency of character pairs (or characters), scaled to 0..1 within the key."""
    return profile_of(grams(docs, key, column=column, pairs=pairs), key)


def profile_of(counts: DataFrame, key: str) -> DataFrame:
    """The profile of a key from the counts of its rows."""
    # the outer form: for the plain one Spark adds a filter that works out the array once more
    each = counts.select(key, F.explode_outer("grams").alias("g")).where("g IS NOT NULL").groupBy(key, F.col("g.item").alias("gram"))
    return min_max(each.agg(F.sum("g.n").cast("double").alias("f")), [key])


def row_correlations(counts: DataFrame, languages: DataFrame, key: str = "doc_id") -> DataFrame:
    """correlations() of rows with a key of their own: profiles and their totals are taken within the row.

    Nothing is dealt out by gram: the profiles of languages (lang, gram, f) go to the rows, which
    leave as one row a language.
    """
    n = F.transform("grams", lambda g: g["n"].cast("double"))
    ends = counts.where(F.col(key).isNotNull()).select(key, "grams", F.array_min(n).alias("low"), F.array_max(n).alias("high"))
    scaled = F.transform("grams", lambda g: F.struct(g["item"].alias("gram"), F.when(F.col("high") == F.col("low"), 0.5).otherwise((g["n"] - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0))).alias("x")))
    rows = ends.select(key, scaled.alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, g: a + f(g["x"]))
    rows = rows.select(key, "p", F.size("p").cast("long").alias("xn"), total(lambda x: x).alias("xs"), total(lambda x: x * x).alias("xq"))
    rows = rows.select(key, F.explode_outer("p").alias("g"), "xn", "xs", "xq").where("g IS NOT NULL")  # outer, as above; the totals once a row, before its grams are dealt out
    known = languages.where("lang IS NOT NULL").select("lang", "gram", F.col("f").alias("y"))
    sums = known.groupBy("lang").agg(F.count("*").alias("yn"), F.sum("y").alias("ys"), F.sum(F.col("y") * F.col("y")).alias("yq"))
    joined = rows.select(key, "g.gram", "g.x", "xn", "xs", "xq").join(F.broadcast(known), "gram")
    own = [F.max(c).alias(c) for c in ("xn", "xs", "xq")]
    common = joined.groupBy(key, "lang").agg(F.count("*").alias("m"), F.sum(F.col("x") * F.col("y")).alias("xy"), *own)
    return _pearson(common.join(F.broadcast(sums), "lang"), key)


def correlations(samples: DataFrame, languages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang and Pearson's r over the union of grams, missing ones 0.

    Only common grams are joined: size of the union, sums and squares follow from each
    side's own totals. A pair without a common gram has no row.
    """
    total = lambda df, k, p: df.groupBy(k).agg(F.count("*").alias(f"{p}n"), F.sum("f").alias(f"{p}s"), F.sum(F.col("f") * F.col("f")).alias(f"{p}q"))
    common = samples.select(key, "gram", F.col("f").alias("x")).join(languages.select("lang", "gram", F.col("f").alias("y")), "gram")
    common = common.groupBy(key, "lang").agg(F.count("*").alias("m"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    return _pearson(common.join(total(samples, key, "x"), key).join(total(languages, "lang", "y"), "lang"), key)


def _pearson(rows: DataFrame, key: str) -> DataFrame:
    rows = rows.withColumn("n", F.col("xn") + F.col("yn") - F.col("m"))
    top = F.col("n") * F.col("xy") - F.col("xs") * F.col("ys")
    below = F.sqrt(F.greatest(F.col("n") * F.col("xq") - F.col("xs") * F.col("xs"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("n") * F.col("yq") - F.col("ys") * F.col("ys"), F.lit(0.0)))
    return rows.select(key, "lang", F.try_divide(top, below).alias("r"))


def best_language(correlated: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pred and r of the highest correlation; constants last, ties to the first name."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(F.round("r", 9)), "lang")
    return correlated.withColumn("k", F.row_number().over(order)).where("k = 1").select(key, F.col("lang").alias("pred"), "r")


def by_library(docs: DataFrame, detect: Callable[[str], str] | None = None, languages: DataFrame | None = None) -> DataFrame:
    """doc_id and lang of docs (doc_id, text) by a library's function; a text on which it fails is `unknown`.

    Without a function the profiles of languages (lang, gram, f) decide.
    """
    if detect is None:
        found = best_language(correlations(profile(docs, "doc_id"), languages))
        return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("pred", F.lit(UNKNOWN)).alias("lang"))
    ship(docs.sparkSession)

    def one(text: str | None) -> str:
        try:
            return detect(text) or UNKNOWN
        except Exception:  # whatever a library raises on a text it cannot place
            return UNKNOWN

    @F.pandas_udf("string")
    def detected(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return docs.select("doc_id", detected("text").alias("lang"))
