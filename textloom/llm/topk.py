"""Exact top-k by inner product: term-at-a-time accumulation in blocks.

Vectors become whole numbers and their components are terms: a block of candidates
is stored as one posting list a component, either (places, weights) or, where most
candidates have the component, all weights with zeros filled in. For each query the
non-zero components in turn scatter query weight times posting weights into a dense
array of scores, one place a candidate. A partition (numpy's introselect) finds the
block's best; the best of all blocks are merged by a per-query top-k aggregate.

Rows that are equal are counted first and travel as one with a number. Candidates and
queries are dealt into blocks, and each pair of blocks is one group: no side is
broadcast or collected. The work is queries times candidates by definition; what is
sent is a copy of the candidates for each block of queries and the reverse. Blocks grow
with the input up to BLOCK candidates and QUERIES queries, what a task can hold, and
are smaller only while there are fewer groups than tasks.

Defined results: vectors that are null or hold a null or a component that is not finite
take no part, nor do rows without a vec_id; an empty vector scores 0 with all; a query's
own row alone is not its candidate, so rows that share a vec_id find each other and
each gives its own ranks; vectors of unequal length are padded with zeros; an empty
table gives an empty table; equal scores go to the smaller vec_id. Components saturate
at the limits of a long; sums are exact and a score beyond a long is held to its limit
before ranks are given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.tables import table
from textloom.scratch import materialize
from textloom.session import ship

K = 20
BLOCK = 65_536
QUERIES = 16_384
LEAST = 4096
DENSE = 0.5
LONG = (-(1 << 63), (1 << 63) - 1)


class Postings:
    """Posting lists of a block of whole-number vectors."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.lists = len(vectors), []
        self.most = max((abs(int(x)) for x in (vectors.max(initial=0), vectors.min(initial=0))), default=0)
        for weights in vectors.T:
            at = np.flatnonzero(weights)
            self.lists.append((None, np.ascontiguousarray(weights)) if len(at) > DENSE * self.n else (at, weights[at]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        terms = np.flatnonzero(query[: len(self.lists)])
        if self.most * sum(abs(int(query[t])) for t in terms) > LONG[1]:
            return self._large_scores(query, terms)
        out = np.zeros(self.n, dtype=np.int64)
        for term in terms:
            at, weights = self.lists[term]
            if at is None:
                out += query[term] * weights
            else:
                out[at] += query[term] * weights
        return out

    def _large_scores(self, query: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The same in numbers of any size, held to the limits of a long at the end."""
        out = np.zeros(self.n, dtype=object)
        for term in terms:
            at, weights = self.lists[term]
            out[slice(None) if at is None else at] += int(query[term]) * weights.astype(object)
        return np.array([min(max(x, LONG[0]), LONG[1]) for x in out], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], ~scores[places]))][:k]  # ~x falls as x grows, and unlike -x never overflows


def _matrix(column: pd.Series) -> np.ndarray:
    width = max(map(len, column), default=0)
    out = np.zeros((len(column), width), dtype=np.int64)
    for row, x in enumerate(column):
        out[row, : len(x)] = x
    return out


def _deal(n: int, most: int, tasks: int) -> int:
    """Blocks for n rows: as few as hold `most` each, or as many as there are tasks while they are small."""
    return max(1, -(-n // most), min(tasks, n // LEAST))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors and queries (vec_id long, v array<long>) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    equal = lambda rows: rows.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    vectors, queries = materialize(equal(vectors), "candidates"), materialize(equal(queries), "queries")
    m = queries.count()
    piles = max(1, -(-m // QUERIES))
    blocks = _deal(vectors.count(), BLOCK, -(-spark.sparkContext.defaultParallelism // piles))
    # two rows that share a vec_id differ in v, and so in their hash
    own = F.xxhash64("vec_id", "v")
    left = vectors.select("vec_id", "v", "n", F.pmod(own, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(piles - 1))).alias("pile"))
    right = queries.select("vec_id", "v", own.alias("hash"), F.pmod(own, F.lit(piles)).cast("int").alias("pile"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def cell(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(asked):
            ids, many, matrix = candidates["vec_id"].to_numpy(), candidates["n"].to_numpy(), _matrix(candidates["v"])
            sizes, postings = candidates["v"].map(len).to_numpy(), Postings(matrix)
            place = pd.Index(ids)
            for query_id, key, size, query in zip(asked["vec_id"], asked["hash"], asked["v"].map(len), _matrix(asked["v"]), strict=True):
                left = many
                if query_id in place:
                    same = np.flatnonzero(ids == query_id)
                    width = min(matrix.shape[1], len(query))
                    same = same[(sizes[same] == size) & (matrix[same, :width] == query[:width]).all(axis=1)]
                    left = many.copy()
                    left[same] -= 1
                scores = postings.scores(query)
                if left is many:
                    own_ids, own_left = ids, many
                else:
                    there = np.flatnonzero(left > 0)
                    scores, own_ids, own_left = scores[there], ids[there], left[there]
                places = best(scores, own_ids, k)
                places = np.repeat(places, np.minimum(own_left[places], k))[:k]
                found.append(pd.DataFrame({"query_id": query_id, "hash": key, "vec_id": own_ids[places], "score": scores[places]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "hash": [], "vec_id": [], "score": []}).astype("int64")

    cells = left.groupBy("block", "pile").cogroup(right.groupBy("block", "pile")).applyInPandas(cell, "query_id long, hash long, vec_id long, score long")
    order = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    repeated = queries.where("n > 1").select(F.col("vec_id").alias("r_id"), own.alias("r_hash"), "n")
    ranked = ranked.join(repeated, (F.col("query_id") == F.col("r_id")) & (F.col("hash") == F.col("r_hash")), "left")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long"))))
    return ranked.select("query_id", "rank", "vec_id", "score", times.alias("time")).drop("time")


def whole_numbers(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, for the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    taken = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP10_SQL = """WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
t AS (SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS term FROM v),
d AS (SELECT q.r AS qr, c.r AS cr, sum(CAST(q.x AS HUGEINT) * c.x) AS score FROM t q JOIN t c ON q.term = c.term WHERE q.vec_id % 20 = 0 GROUP BY q.r, c.r),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(least(greatest(coalesce(score, 0), -9223372036854775808), 9223372036854775807) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r LEFT JOIN d ON qr = q.r AND cr = c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
