"""Mixing sources to target weights by capped water-filling.

Each source's share of the whole goes by its weight; a source that would repeat
its documents more than `epochs` times is clamped there and the excess goes to
the others by weight, until none is above. With sources in ascending order of
cap / weight, the clamped ones are a prefix of that order, and the fixed point of
the rounds is one running sum over one row a source.

A source's documents are then taken floor(target / size) times whole, and some
once more: in a seeded order, each that brings the source no further from its
target, to the end of the order. A document that is refused uses up nothing, so
smaller ones behind it fill the gap. The order is that of md5(seed:doc_id:md5(text)),
cut into ranges of about RANGE rows. Each pass takes whole ranges up to the first
that may hold a refusal, walks that one, and goes on behind it with what is left;
rows that are equal in doc_id, text and source are walked as one with a number.

Only sizes and hashes are shuffled. mix() reads the texts once more and meets the
decisions, a few rows a source, where they lie; only the rows of walked ranges,
about RANGE for each, are dealt out.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a row without words comes as often as all of its source do; a source
without words has target 0 and takes none; rows that share a doc_id are dealt with one by one; a null doc_id is
ordered as the empty string; an empty table gives an empty table. Input columns
with the names of results are replaced by mix_plan(); mix() returns the input's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.tables import SPACE, table
from textloom.scratch import materialize

SEED = 42
EPOCHS = 3
#: Rows of a range of the seeded order, about.
RANGE = 4096
#: Decisions are broadcast up to so many rows, a few for each source, and joined by a shuffle beyond.
SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"), F.lit(0).cast("long"))


def seeded(doc_id: Column, text: Column, seed: int) -> Column:
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def targets(sources: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> source, source_size, target, reps, extra.

    sources has one row a source: both windows run over that many rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    level = (
        sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap"))
        .withColumn("rest", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("above", (F.col("rest") * F.col("weight") > F.col("cap") * F.col("open")) | (F.col("cap") == 0))
    )
    place = F.when(~F.col("above"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))
    first = F.min_by(F.struct("rest", "open"), place).over(all_rows)
    share = F.col("weight") * F.col("first.rest").cast("double") / F.col("first.open")
    return (
        level.withColumn("first", first)
        .withColumn("target", F.when(F.col("above"), F.col("cap").cast("double")).otherwise(share))
        .withColumn("reps", F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
        .withColumn("extra", F.round(F.col("target")).cast("long") - F.col("reps") * F.col("source_size"))
        .select("source", "source_size", "target", "reps", "extra")
    )


#: Of one range, in order: the words left behind it, and how many rows of each key come once more while each brings the sum no further away.
WALK = """aggregate(rows, struct(before AS left, CAST(array() AS ARRAY<STRUCT<key:STRING,n:BIGINT>>) AS taken), (a, r) ->
  aggregate(array(CASE WHEN r.size <= 2 * a.left THEN least(r.n, (2 * a.left - r.size) div (2 * r.size) + 1) ELSE 0L END), a, (b, more) ->
    CASE WHEN more > 0 THEN struct(b.left - more * r.size AS left, concat(b.taken, array(struct(r.key AS key, more AS n))) AS taken) ELSE b END))"""


class Plan:
    """What a mix takes: the targets of the sources and which rows of the seeded order come once more."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, source: str, seed: int, epochs: int):
        self.names, self.seed = (text, doc_id, source), seed
        self.sized = materialize(self._sized(docs, F.col(doc_id).alias("doc_id")), "mix-sizes")
        self.spark = self.sized.sparkSession
        found = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        found = materialize(found, "mix-sources")
        self.targets = materialize(targets(found, epochs), "mix-targets")
        self.few = found.count() <= SOURCES
        rows = found.agg(F.max("rows")).first()[0] or 0
        self.digits = next(d for d in range(1, 17) if rows <= RANGE * 16**d)
        self._decide()

    def _sized(self, docs: DataFrame, *keep: Column) -> DataFrame:
        text, doc_id, source = self.names
        return docs.select(*keep, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), seeded(F.col(doc_id), F.col(text), self.seed).alias("key"))

    def _range(self) -> Column:
        return F.left(F.col("key"), F.lit(self.digits))

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _decide(self) -> None:
        kind = self.targets.schema["source"].dataType.simpleString()
        ranged = self.sized.where("size > 0").withColumn("range", self._range())
        open_ = [(r["source"], "", r["extra"]) for r in self.targets.where("extra > 0").collect()]  # one row a source
        spans, walked = [], []  # ranges between two, sizes up to a limit; and rows taken of each key of the ranges walked
        while open_:
            now = self.spark.createDataFrame(open_, f"o_source {kind}, after string, left long")
            fit = ranged.join(self._small(now), F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") > F.col("after")) & (F.col("size") <= 2 * F.col("left")))
            sums = fit.groupBy("o_source", "left", "range").agg(F.sum("size").alias("words"))
            running = Window.partitionBy("o_source").orderBy("range")
            edge = sums.withColumn("done", F.sum("words").over(running)).where("done > left")
            edge = edge.groupBy("o_source", "left").agg(F.min(F.struct("range", (F.col("left") - F.col("done") + F.col("words")).alias("before"))).alias("e"))
            edge = edge.select(F.col("o_source").alias("e_source"), F.col("e.range").alias("e_range"), F.col("e.before").alias("before"))
            rows = ranged.join(self._small(edge), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range")))
            groups = rows.groupBy("e_source", "e_range", "before", "key", "size").agg(F.count("*").alias("n"))
            piles = groups.groupBy("e_source", "e_range", "before").agg(F.sort_array(F.collect_list(F.struct("key", "size", "n"))).alias("rows"))
            walks = piles.select("e_source", "e_range", F.expr(WALK).alias("w")).select("e_source", "e_range", "w.left", "w.taken")
            walks = materialize(walks, "mix-walks")
            at = {r.e_source: r for r in walks.select("e_source", "e_range", "left").collect()}
            spans += [(s, after, at[s].e_range if s in at else "~", 2 * left) for s, after, left in open_]
            walked.append(walks)
            open_ = [(s, r.e_range, r.left) for s, r in at.items() if r.left > 0]
        self.spans = self.spark.createDataFrame(spans, f"p_source {kind}, after string, until string, most long")
        nothing = self.spark.createDataFrame([], f"e_source {kind}, e_range string, left long, taken array<struct<key:string,n:long>>")
        self.walks = reduce(DataFrame.unionAll, walked, nothing)

    def applied(self, rows: DataFrame) -> DataFrame:
        """rows (with source, size and key) with source_size, target and copies."""
        rows = rows.withColumn("range", self._range())
        edges = self.walks.select(F.col("e_source").alias("w_source"), F.col("e_range").alias("w_range"), F.lit(True).alias("edge"))
        marked = rows.join(self._small(edges), F.col("source").eqNullSafe(F.col("w_source")) & (F.col("range") == F.col("w_range")), "left").drop("w_source", "w_range")
        inside = (F.col("range") > F.col("after")) & (F.col("range") < F.col("until"))
        outer = marked.where("edge IS NULL").join(self._small(self.spans), F.col("source").eqNullSafe(F.col("p_source")) & inside, "left")
        outer = outer.withColumn("more", F.coalesce((F.col("size") > 0) & (F.col("size") <= F.col("most")), F.lit(False)).cast("long"))
        taken = self.walks.select(F.col("e_source").alias("t_source"), F.explode("taken").alias("t"))
        taken = taken.select("t_source", F.col("t.key").alias("t_key"), F.col("t.n").alias("t_taken"))
        edge = marked.where("edge").withColumn("nth", F.row_number().over(Window.partitionBy("source", "key").orderBy(F.lit(1))))
        edge = edge.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("key") == F.col("t_key")), "left")
        edge = edge.withColumn("more", (F.col("nth") <= F.coalesce("t_taken", F.lit(0))).cast("long"))
        placed = outer.select(*rows.columns, "more").unionByName(edge.select(*rows.columns, "more"))
        named = self.targets.withColumnRenamed("source", "s")
        placed = placed.join(self._small(named), F.col("source").eqNullSafe(F.col("s")))
        return placed.withColumn("copies", F.col("reps") + F.col("more"))


def mix_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row."""
    plan = Plan(docs, text, doc_id, source, seed, epochs)
    return plan.applied(plan.sized).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each row of docs as often as the plan says; the columns of docs."""
    plan = Plan(docs, text, doc_id, source, seed, epochs)
    rows = plan.applied(plan._sized(docs, F.struct(*docs.columns).alias("row")))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mix_sql(source: str, size: str = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))") -> str:
    """DuckDB CTEs, to follow WITH RECURSIVE, ending in `mixed`: the rows of source with size, source_size, target, copies and taken."""
    return f"""
      sz AS (SELECT *, CAST({size} AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM {source}),
      so AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sz GROUP BY source),
      wt AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {EPOCHS} AS cap FROM so),
      rn AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open,
          row_number() OVER (ORDER BY cap / weight, encode(source) NULLS LAST) AS rk FROM wt
        WINDOW w AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      ab AS (SELECT *, rest * weight > cap * open OR cap = 0 AS above FROM rn),
      tg AS (SELECT source, source_size, CASE WHEN above THEN CAST(cap AS DOUBLE)
          ELSE weight * CAST((SELECT arg_min(rest, rk) FROM ab WHERE NOT above) AS DOUBLE) / (SELECT arg_min(open, rk) FROM ab WHERE NOT above) END AS target FROM ab),
      tr AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least({EPOCHS}, floor(target / source_size)) AS BIGINT) ELSE 0 END AS reps FROM tg),
      ex AS (SELECT *, CAST(round(target) AS BIGINT) - reps * source_size AS extra FROM tr),
      ps AS (SELECT s.*, ex.source_size, ex.target, ex.reps, ex.extra, row_number() OVER (PARTITION BY s.source ORDER BY key) AS nth
        FROM sz s JOIN ex ON s.source IS NOT DISTINCT FROM ex.source),
      wk AS (SELECT source, CAST(0 AS BIGINT) AS nth, extra AS rest, 0 AS more FROM ex
        UNION ALL SELECT p.source, p.nth, CASE WHEN p.size > 0 AND p.size <= 2 * w.rest THEN w.rest - p.size ELSE w.rest END, CASE WHEN p.size > 0 AND p.size <= 2 * w.rest THEN 1 ELSE 0 END
        FROM wk w JOIN ps p ON p.source IS NOT DISTINCT FROM w.source AND p.nth = w.nth + 1),
      mixed AS (SELECT ps.*, reps + more AS copies FROM ps JOIN wk ON ps.source IS NOT DISTINCT FROM wk.source AND ps.nth = wk.nth)"""


OP2_SQL = f"""WITH RECURSIVE {mix_sql('documents')}
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM mixed"""
