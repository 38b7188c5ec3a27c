r"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is a built-in SQL expression; no user function runs. The word array
of a text is bound once with a one-element transform(), so that no expression
inside a lambda is evaluated again for each element.

Defined results: a null text counts as empty; an empty text has no words and
fails (n_words below the least); a row that is repeated is judged each time; an
empty table gives an empty table. Columns of the input that have the name of a
metric are replaced by annotate(). Ratios with a zero denominator are 0. Texts
of any length are judged whole, in O(n log n) of their words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.tables import SPACE, table

#: Frequent function words of the languages that the rules know.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is a that was for it as with on be by this or are from an at he "
            "de la le les et un une que en est pour dans du des pas qui ou sur avec "
            "der die das und ist ein eine zu nicht mit sich auf für von dem den ich "
            "el los las por con una para se del su al es no lo".split()
        )
    )
)


@dataclass(frozen=True)
class Rule:
    """A metric must lie within [least, most] for texts of from_words words or more."""

    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Lenient on purpose: short, accented, quoted or listed prose passes.
RULES = (
    Rule("mean_word_length", least=2.0, most=14.0),
    Rule("symbol_ratio", most=0.25),
    Rule("dup_line_ratio", most=0.5),
    Rule("upper_ratio", most=0.7, from_words=20),
    Rule("stop_ratio", least=0.005, from_words=200),
)

BASE_LEAST_WORDS = 20
BASE_MOST_REPEATED = 30  # per cent of the words
WINDOW = 8


def _counts() -> str:
    """One SQL expression with every count of a text, as a struct."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    # Words in windows found twice or more: sort (hash, position), keep those with an equal neighbour,
    # then add up the distance to the next such position, at most a window.
    repeated = f"""
      aggregate(transform(array(array_sort(filter(
        transform(array(sort_array(transform(hs, (h, i) -> struct(h AS h, i AS i)))), s ->
          transform(s, (x, j) -> CASE
            WHEN (j > 0 AND s[greatest(j - 1, 0)].h = x.h)
              OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h) THEN x.i END))[0],
        p -> p IS NOT NULL))), p ->
        transform(p, (x, j) -> CASE WHEN j = size(p) - 1 THEN {WINDOW}L
          ELSE CAST(least({WINDOW}, p[least(j + 1, size(p) - 1)] - x) AS BIGINT) END))[0],
        0L, (a, x) -> a + x)"""
    # The hash of a window from those of its halves: of two words, four, then eight.
    halves = "hs"
    for step in (1, 2, 4):
        halves = f"transform(array({halves}), a -> zip_with(a, slice(a, {step + 1}, size(a)), (x, y) -> xxhash64(x, y)))[0]"
    hashes = f"""
      CASE WHEN size(ws) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>) ELSE
        slice({halves.replace("array(hs)", "array(transform(ws, w -> xxhash64(w)))")}, 1, size(ws) - {WINDOW - 1}) END"""
    return f"""
      transform(array(filter(split(t, r'[{SPACE}]+'), w -> w <> '')), ws -> struct(
        CAST(size(ws) AS BIGINT) AS n_words,
        aggregate(ws, 0L, (a, w) -> a + length(w)) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) AS BIGINT) AS n_symbols,
        transform(array(filter(split(t, '\\n'), l -> l RLIKE r'[^{SPACE}]')), ls ->
          struct(size(ls) AS n, CAST(size(ls) - size(array_distinct(ls)) AS BIGINT) AS dup))[0] AS lines,
        transform(array({hashes}), hs -> CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0L ELSE {repeated} END)[0]
          AS n_repeat_words,
        size(filter(ws, w -> lower(w) IN ({stops}))) AS n_stop,
        length(t) - length(regexp_replace(t, r'\\p{{Lu}}+', '')) AS n_upper))[0]"""


def _ratio(top: str, below: str) -> str:
    return f"CASE WHEN {below} > 0 THEN CAST({top} AS DOUBLE) / {below} ELSE 0D END"


def compile_rules(rules=RULES) -> Column:
    """The conjunction of all rules as one boolean column over the metrics."""
    checks = []
    for rule in rules:
        metric, long_enough = F.col(rule.metric), F.col("n_words") >= rule.from_words
        if rule.least is not None:
            checks.append(~long_enough | (metric >= rule.least))
        if rule.most is not None:
            checks.append(~long_enough | (metric <= rule.most))
    return reduce(lambda a, b: a & b, checks, F.lit(True))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_length", "symbol_ratio", "dup_line_ratio", "stop_ratio", "upper_ratio", "base_failed", "kept")


def annotate(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All columns of docs, the metrics of METRICS and the verdict `kept`."""
    own = [c for c in docs.columns if c not in METRICS]
    counted = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("__t")).withColumn("__c", F.expr(_counts().replace("(t,", "(__t,").replace("(t)", "(__t)")))
    lifted = counted.select(
        *own,
        *(F.col(f"__c.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")),
        F.col("__c.lines.dup").alias("n_dup_lines"),
        F.col("__c.n_repeat_words").alias("n_repeat_words"),
        F.expr(_ratio("__c.word_chars", "__c.n_words")).alias("mean_word_length"),
        F.expr(_ratio("__c.n_symbols", "__c.n_words")).alias("symbol_ratio"),
        F.expr(_ratio("__c.lines.dup", "__c.lines.n")).alias("dup_line_ratio"),
        F.expr(_ratio("__c.n_stop", "__c.n_words")).alias("stop_ratio"),
        F.expr(_ratio("__c.n_upper", "__c.word_chars")).alias("upper_ratio"),
    )
    failed = (F.col("n_words") < BASE_LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_MOST_REPEATED * F.col("n_words"))
    return lifted.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that pass, with their own columns only."""
    judged = annotate(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text")), "__text", rules)
    return judged.where("kept").select("__row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs).select("doc_id", *METRICS[:5], "base_failed", "kept", *METRICS[5:10])


def _sql_rules() -> str:
    checks = []
    for r in RULES:
        if r.least is not None:
            checks.append(f"(n_words < {r.from_words} OR {r.metric} >= {r.least})")
        if r.most is not None:
            checks.append(f"(n_words < {r.from_words} OR {r.metric} <= {r.most})")
    return " AND ".join(checks)


def metrics_sql(source: str) -> str:
    """CTEs for DuckDB ending in `judged`: the rows of source (doc_id, text, ...) with every metric."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"
    return rf"""
      src AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {source}),
      ws AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM src),
      win AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM ws WHERE len(w) >= {WINDOW})),
      dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
      nxt AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM dup),
      rep AS (SELECT rid, sum(coalesce(least({WINDOW}, j - i), {WINDOW})) AS n FROM nxt GROUP BY rid),
      cnt AS (SELECT s.*, len(w) AS n_words,
          length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
          length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
          list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
          CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
          len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop,
          length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
        FROM src s JOIN ws USING (rid) LEFT JOIN rep USING (rid)),
      met AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
          {ratio('word_chars', 'n_words')} AS mean_word_length, {ratio('n_symbols', 'n_words')} AS symbol_ratio,
          {ratio('len(ls) - len(list_distinct(ls))', 'len(ls)')} AS dup_line_ratio,
          {ratio('n_stop', 'n_words')} AS stop_ratio, {ratio('n_upper', 'word_chars')} AS upper_ratio,
          n_words < {BASE_LEAST_WORDS} OR 100 * n_repeat_words > {BASE_MOST_REPEATED} * n_words AS base_failed FROM cnt),
      judged AS (SELECT *, NOT base_failed AND {_sql_rules()} AS kept FROM met)"""


OP9_SQL = f"""WITH {metrics_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
  mean_word_length, symbol_ratio, dup_line_ratio, stop_ratio, upper_ratio FROM judged"""
