"""Queries on the index, its physical layout, ranked and boolean retrieval, and evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import boolean, evaluation
from textloom.operators import index as ix
from textloom.operators import ranking as rk
from textloom.operators.stats import histogram
from textloom.plans.base import INDEX_SQL, KEEP_SQL, MATCHED_SQL, QRELS_SQL, TOPICS_SQL, asked, docs, index, log2_sql, matched, norms, qrels, query, shared, topics, vocabulary
from textloom.scratch import materialize
from textloom.sources import readers

L2 = log2_sql

# ---- index


@query(f"WITH {INDEX_SQL}, f AS (SELECT term, min(doc_id) AS d FROM post GROUP BY term) SELECT term, row_number() OVER (ORDER BY d, term) - 1 AS term_id FROM f")
def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_ids(index(spark, sf_dir))


def _offsets(width: int) -> str:
    return f"""WITH {INDEX_SQL}, f AS (SELECT term, min(doc_id) AS d, count(*) AS df FROM post GROUP BY term)
  SELECT row_number() OVER w - 1 AS term_id, term, df, CAST({width} * (sum(df) OVER w - df) AS BIGINT) AS "offset" FROM f WINDOW w AS (ORDER BY d, term ROWS UNBOUNDED PRECEDING)"""


@query(_offsets(8))
def posting_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.offsets(index(spark, sf_dir))


@query(_offsets(12))
def posting_offsets_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.offsets(index(spark, sf_dir), 12)


@query(f"WITH {INDEX_SQL} SELECT term, part, df, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM (SELECT *, doc_id // {ix.SPAN} AS part FROM post) JOIN voc USING (term) GROUP BY term, part, df")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ix.posting_lists(index(spark, sf_dir))
    return lists.select("term", "part", "df", F.array_join(F.transform("postings", lambda p: F.concat(p["doc_id"], F.lit(":"), p["tf"])), ",").alias("postings"))


_NORMS = f"nr AS (SELECT doc_id, sqrt(sum(pow((1 + {L2('tf')}) * {L2('(SELECT count(*) FROM documents) / df')}, 2))) AS norm FROM post JOIN voc USING (term) GROUP BY doc_id)"


@query(f"WITH {INDEX_SQL}, {_NORMS} SELECT doc_id, round(norm, 6) AS norm FROM nr")
def doc_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norms(spark, sf_dir).select("doc_id", F.round("norm", 6).alias("norm"))


@query(f"WITH {TOPICS_SQL} SELECT qid, term, qtf FROM qt")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir)


@query(f"WITH {INDEX_SQL}, {TOPICS_SQL} SELECT qid, term, df FROM qt JOIN voc USING (term)")
def query_terms_in_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).join(vocabulary(spark, sf_dir), "term").select("qid", "term", "df")


# ---- ranked retrieval


def _run_sql(weight: str, plus: str = "", where: str = "") -> str:
    return f"SELECT qid, doc_id, round(sum({weight}){plus}, 6) AS score FROM m {where} GROUP BY qid, doc_id"


def _top_sql(run: str, k: int, name: str = "run") -> str:
    return f"{name} AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ({run})) WHERE rank <= {k})"


def _query_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).groupBy("qid").agg(F.sum("qtf").alias("q_len"))


TF = f"(1 + {L2('tf')})"
IDF = L2("n_docs / df")
K1B = "(1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avdl))"
#: name: weight, SQL of the weight, condition, its SQL
MODELS: dict[str, tuple[Callable[[], Column], str, str | None]] = {
    "rank_taat": (rk.dot_product, f"{TF} * {IDF} * (1 + {L2('qtf')})", None),
    "rank_vector_log10df": (rk.vector, "(1 + log10(tf)) * log10(df) * qtf", None),
    "rank_vector_idf": (lambda: rk.vector(False), "(1 + log10(tf)) * log10(n_docs / df) * qtf", None),
    "rank_skip_div": (rk.divided, f"{TF} / {IDF} * (1 + {L2('qtf')})", "n_docs / df > 1"),
    "rank_tfidf": (rk.robertson_tfidf, f"tf * 1.2::DOUBLE / (tf + {K1B}) * {L2('n_docs / df + 1')} * qtf", None),
    "rank_bm25": (rk.bm25, f"ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + {K1B}) * qtf", None),
    "rank_hiemstra": (rk.hiemstra, f"qtf * {L2('1 + 0.6::DOUBLE * tf * c / ((1 - 0.6::DOUBLE) * cf * dl)')}", None),
}
RUN_SQL = {name: _run_sql(sql, where=f"WHERE {where}" if where else "") for name, (_, sql, where) in MODELS.items()}
RUN_SQL["rank_dirichlet"] = f"SELECT qid, doc_id, round(s, 6) AS score FROM (SELECT qid, doc_id, sum(qtf * {L2('1 + tf / (2000::DOUBLE * cf / c)')}) + max(ql * {L2('2000::DOUBLE / (dl + 2000)')}) AS s FROM m JOIN (SELECT qid, CAST(sum(qtf) AS BIGINT) AS ql FROM qt GROUP BY qid) USING (qid) GROUP BY qid, doc_id)"
RUN_SQL["rank_daat_cosine"] = f"""SELECT qid, doc_id, round(s / (norm * qn), 6) AS score FROM
  (SELECT qid, doc_id, sum({TF} * {IDF} * (1 + {L2('qtf')}) * {IDF}) AS s FROM m WHERE df < n_docs GROUP BY qid, doc_id) JOIN nr USING (doc_id)
  JOIN (SELECT qid, sqrt(sum(pow((1 + {L2('qtf')}) * {L2('(SELECT count(*) FROM documents) / df')}, 2))) AS qn FROM qt JOIN voc USING (term) WHERE df < (SELECT count(*) FROM documents) GROUP BY qid) USING (qid)"""
CTES = f"WITH {MATCHED_SQL}, {_NORMS}"


def run_of(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, doc_id and score of a model; scores to six digits, so that equal ones tie."""
    if name == "rank_daat_cosine":
        run = rk.cosine(matched(spark, sf_dir), norms(spark, sf_dir), asked(spark, sf_dir), vocabulary(spark, sf_dir), docs(spark, sf_dir))
        return run.select("qid", "doc_id", F.round("score", 6).alias("score"))
    where = MODELS[name][2] if name in MODELS else None
    return scored(spark, sf_dir, (name,), where).withColumnRenamed(name, "score")


def scored(spark: SparkSession, sf_dir: str, names: tuple[str, ...], where: str | None = None) -> DataFrame:
    """qid, doc_id and a column of each model's scores, in one pass over the matches."""
    rows = matched(spark, sf_dir)
    if "rank_dirichlet" in names:
        length = _query_length(spark, sf_dir)
        rows = rows.join(F.broadcast(length) if length.count() <= rk.FEW else length, "qid")
    sums = [F.sum(rk.dirichlet()) + F.max(rk.dirichlet_length(F.col("q_len"))) if n == "rank_dirichlet" else F.sum(MODELS[n][0]()) for n in names]
    rows = rows if where is None else rows.where(where)
    return rows.groupBy("qid", "doc_id").agg(*(F.round(x, 6).alias(n) for n, x in zip(names, sums, strict=True)))


def _ranked(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rk.top(run_of(name, spark, sf_dir), 10)

    run.__name__ = name
    query(f"{CTES}, {_top_sql(RUN_SQL[name], 10)} SELECT qid, doc_id, score, rank FROM run")(run)


for _name in RUN_SQL:
    _ranked(_name)


@query(f"{CTES} {RUN_SQL['rank_bm25']}")
def rank_bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matching document, not only the first ones."""
    return run_of("rank_bm25", spark, sf_dir)


# ---- boolean retrieval, over frequent terms of the fixtures

EXPRESSIONS = {
    "bool_and": "tion AND ther", "bool_or": "tion OR ther", "bool_and_not": "tion AND NOT ther", "bool_not": "NOT tion",
    "bool_and3": "tion AND ther AND thon", "bool_or_and": "(tion OR ther) AND thon", "bool_and_or": "(tion AND ther) OR thon", "bool_nested": "NOT (tion OR ther) AND (erin OR NOT thon)",
}


def _bool_sql(node: boolean.Node) -> str:
    if node.kind == "term":
        return f"SELECT DISTINCT doc_id FROM post WHERE term = '{node.term}'"
    parts = [f"(SELECT * FROM ({_bool_sql(p)}))" for p in node.parts]
    if node.kind == "not":
        return f"SELECT DISTINCT doc_id FROM documents EXCEPT {parts[0]}"
    return (" INTERSECT " if node.kind == "and" else " UNION ").join(parts)


def _boolean(name: str, expression: str) -> None:
    def one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boolean.search(expression, index(spark, sf_dir), docs(spark, sf_dir))

    def by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boolean.search_by_sets(expression, index(spark, sf_dir), docs(spark, sf_dir))

    sql = f"WITH {INDEX_SQL} SELECT doc_id FROM ({_bool_sql(boolean.parse(expression))})"
    one_pass.__name__, by_sets.__name__ = name, f"{name}_sets"
    query(sql)(one_pass)
    query(sql)(by_sets)


for _name, _expression in EXPRESSIONS.items():
    _boolean(_name, _expression)


@query(f"WITH {INDEX_SQL} SELECT a.doc_id, a.tf AS tf_a, b.tf AS tf_b FROM post a JOIN post b USING (doc_id) WHERE a.term = 'tion' AND b.term = 'ther'")
def postings_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir)
    one = lambda t, name: rows.where(F.col("term") == t).select("doc_id", F.col("tf").alias(name))
    return one("tion", "tf_a").join(one("ther", "tf_b"), "doc_id")


_LOG = f"""WITH {INDEX_SQL}, lt AS (SELECT DISTINCT turn_id, term FROM (SELECT conv_id * 1000 + turn AS turn_id, unnest(regexp_extract_all(lower(text), '{text.SPANISH}')) AS term FROM conversations WHERE role = 'user') WHERE {KEEP_SQL}),
  lg AS (SELECT turn_id, count(*) AS n_terms, string_agg(term, ' ' ORDER BY term) AS terms FROM lt LEFT JOIN voc USING (term) GROUP BY turn_id HAVING count(*) IN (2, 3) AND count(df) = count(*))"""


@query(f"{_LOG} SELECT turn_id, n_terms, terms FROM lg")
def query_log_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with exactly two or three index terms in the whole turn, all in the vocabulary; terms in their own order, as the reference sorts them."""
    log = readers.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"))
    terms = rk.query_terms(log)
    few = terms.groupBy("qid").agg(F.count("*").alias("n_terms")).where(F.col("n_terms").isin(2, 3))
    known = terms.join(few, "qid").join(vocabulary(spark, sf_dir).select("term", "df"), "term", "left")
    lines = known.groupBy("qid", "n_terms").agg(F.count("df").alias("n_known"), F.array_join(F.sort_array(F.collect_list("term")), " ").alias("terms"))
    return lines.where(F.col("n_known") == F.col("n_terms")).select(F.col("qid").alias("turn_id"), "n_terms", "terms")


def _template_sql(template: str) -> str:
    """A template over the flags t0, t1 and t2, in SQL."""
    return re.sub(r"\{(\d)\}", r"t\1", template)


_TEMPLATES = [(n, t) for n, several in boolean.TEMPLATES.items() for t in several]


#: Pairs of a line and a document that a task of query_log_boolean groups, at most (up to 20,000 tasks).
PAIRS = 4_000_000


@query(f"""{_LOG}, ln AS (SELECT DISTINCT n_terms, terms, string_split(terms, ' ') AS w FROM lg),
  fl AS (SELECT n_terms, terms, doc_id, bool_or(term = w[1]) AS t0, bool_or(term = w[2]) AS t1, coalesce(bool_or(term = w[3]), false) AS t2 FROM ln JOIN post ON list_contains(w, term) GROUP BY ALL)
  {" UNION ALL ".join(f"SELECT terms, '{t}' AS template, doc_id FROM fl WHERE n_terms = {n} AND ({_template_sql(t)})" for n, t in _TEMPLATES)}""")
def query_log_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each template query over the terms of accepted lines, once for lines with the same terms."""
    lines = query_log_gate(spark, sf_dir).select("n_terms", "terms").distinct()
    asked = lines.select("n_terms", "terms", F.posexplode(F.split("terms", " ")).alias("place", "term"))
    asked = materialize(asked, "lines")
    lines = asked.select("n_terms", "terms").distinct()
    bounded = F.broadcast if asked.count() <= rk.FEW else lambda df: df  # frequent terms are met where their postings lie
    known = index(spark, sf_dir).select("doc_id", "term").join(bounded(asked.select("term").distinct()), "term", "left_semi")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, lines.count() * docs(spark, sf_dir).count() // PAIRS))
    by_doc = known.repartition(parts, "doc_id")  # postings are dealt out, not their pairs with lines
    flags = by_doc.join(bounded(asked), "term").groupBy("n_terms", "terms", "doc_id").agg(*(F.max(F.col("place") == i).alias(f"t{i}") for i in range(3)))
    held = F.array(*(F.when((F.col("n_terms") == n) & F.expr(_template_sql(t)), F.lit(t)) for n, t in _TEMPLATES))
    return flags.select("terms", F.explode(F.array_compact(held)).alias("template"), "doc_id")


# ---- physical layout

_NUMBERED = f"WITH {INDEX_SQL}, i AS (SELECT term, doc_id, tf, count(*) OVER (PARTITION BY term) AS df, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS idx FROM post), s AS (SELECT *, CAST(floor(sqrt(df)) AS BIGINT) AS step FROM i), k AS (SELECT term, doc_id, tf, idx, CASE WHEN idx % step = 0 AND idx + step < df THEN idx + step ELSE 0 END AS skip_to FROM s)"


@query(f"{_NUMBERED} SELECT term, doc_id, tf, idx, skip_to FROM k")
def skip_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.skips(index(spark, sf_dir))


@query(f"{_NUMBERED} SELECT term, doc_id, idx, skip_to FROM k WHERE skip_to <> 0")
def skip_list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.skips(index(spark, sf_dir)).where("skip_to <> 0").select("term", "doc_id", "idx", "skip_to")


_GAPS = f"WITH {INDEX_SQL}, g AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post)"


@query(f"{_GAPS} SELECT term, doc_id, tf, gap FROM g")
def dgaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.gaps(index(spark, sf_dir)).select("term", "doc_id", "tf", "gap")


@query(f"WITH {INDEX_SQL} SELECT term, doc_id, tf FROM post")
def dgaps_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = ix.gaps(index(spark, sf_dir)).withColumn("at", F.col("doc_id")).drop("doc_id")
    return ix.ungap(gapped, "at").select("term", "doc_id", "tf")


def _vbyte_sql(n: str) -> str:
    parts = [f"CASE WHEN {n} >> {7 * k} > 0 THEN printf('%02X', ({n} >> {7 * k}) & 127) ELSE '' END" for k in range(8, 0, -1)]
    return f"concat({', '.join(parts)}, printf('%02X', ({n} & 127) + 128))"


def _gamma_sql(n: str) -> str:
    bits = f"bin({n})"
    return f"(repeat('1', length({bits}) - 1) || '0' || substr({bits}, 2))"


def _padded_sql(n: str) -> str:
    code = _gamma_sql(n)
    return f"rpad({code}, CAST(8 * ceil(length({code}) / 8) AS INTEGER), '0')"


_CODES = f"{_GAPS}, c AS (SELECT term, doc_id, tf, gap, {_vbyte_sql('gap')} AS docs_hex, {_padded_sql('tf')} AS tf_bits FROM g)"


@query(f"{_GAPS} SELECT term, doc_id, {_vbyte_sql('gap')} AS gap_hex, {_vbyte_sql('doc_id')} AS doc_hex FROM g")
def vbyte_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.gaps(index(spark, sf_dir)).select("term", "doc_id", ix.vbyte(F.col("gap")).alias("gap_hex"), ix.vbyte(F.col("doc_id")).alias("doc_hex"))


@query(f"WITH {INDEX_SQL} SELECT term, doc_id, {_gamma_sql('tf')} AS bits, {_padded_sql('tf')} AS padded FROM post")
def gamma_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("term", "doc_id", ix.gamma(F.col("tf")).alias("bits"), ix.gamma(F.col("tf"), True).alias("padded"))


_LISTS = f"""{_CODES}, p AS (SELECT *, doc_id // {ix.SPAN} AS part, doc_id - gap AS before FROM c),
  l AS (SELECT term, part, any_value(df) AS df, arg_min(before, doc_id) AS previous, count(*) AS n, string_agg(docs_hex, '' ORDER BY doc_id) AS docs, string_agg(tf_bits, '' ORDER BY doc_id) AS freqs FROM p JOIN voc USING (term) GROUP BY term, part)"""


@query(f"{_LISTS} SELECT term, part, df, previous, n, docs, freqs, length(docs) * 4 AS docs_bits, length(freqs) AS freqs_bits FROM l")
def compressed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.compressed(index(spark, sf_dir))


@shared("vocabulary_of_codes")
def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0]


@shared("codes")
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by the bit at which they begin, so that row groups are skipped when a few lists are asked for."""
    return _stored(spark, sf_dir)[1].repartitionByRange("docs_at").sortWithinPartitions("docs_at")


@cache
def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ix.store_compressed(index(spark, sf_dir))


@query(f"""{_LISTS} SELECT term, part, df, previous, n, CAST(coalesce(sum(4 * length(docs)) OVER w, 0) AS BIGINT) AS docs_at, CAST(coalesce(sum(length(freqs)) OVER w, 0) AS BIGINT) AS freqs_at
  FROM l WINDOW w AS (ORDER BY term, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def compressed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits at which the codes of each part of a list begin."""
    return _vocabulary(spark, sf_dir)


@query(f"WITH {INDEX_SQL} SELECT term, doc_id, tf, df FROM post JOIN voc USING (term)")
def decompressed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.decompress(_vocabulary(spark, sf_dir).join(_codes(spark, sf_dir), ["docs_at", "freqs_at"]))


@query(f"WITH {INDEX_SQL} SELECT term, doc_id, tf FROM post")
def decompressed_index_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.decompress(ix.compressed(index(spark, sf_dir), use_gaps=False), use_gaps=False).select("term", "doc_id", "tf")


@query(f"WITH {MATCHED_SQL}, {_top_sql(RUN_SQL['rank_taat'], 10)} SELECT qid, doc_id, score, rank FROM run")
def rank_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot-product ranking over the compressed index: only the lists of the query terms are found, by their bits, and decoded."""
    terms = asked(spark, sf_dir)
    found = ix.decompress(ix.lookup(_vocabulary(spark, sf_dir), _codes(spark, sf_dir), terms))
    n_docs = docs(spark, sf_dir).agg(F.count("*").alias("n_docs"))  # one row
    rows = found.join(terms, "term").crossJoin(F.broadcast(n_docs))
    run = rk.ranking(rows, rk.dot_product())
    return rk.top(run.select("qid", "doc_id", F.round("score", 6).alias("score")), 10)


@query(f"""{_GAPS} SELECT 8 * count(*) AS plain, 12 * count(*) AS with_skips, CAST(sum(length({_vbyte_sql('doc_id')}) // 2) AS BIGINT) AS vbyte,
  CAST(sum(length({_vbyte_sql('gap')}) // 2) AS BIGINT) AS gap_vbyte, CAST(sum(length({_gamma_sql('tf')})) AS BIGINT) AS gamma_bits, CAST(sum(length({_padded_sql('tf')}) // 8) AS BIGINT) AS gamma_bytes FROM g""")
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes (gamma also in bits) that the postings take in each layout."""
    hex_bytes = lambda c: F.sum(F.length(ix.vbyte(F.col(c))) / 2).cast("long")
    return ix.gaps(index(spark, sf_dir)).agg(
        (F.count("*") * 8).alias("plain"), (F.count("*") * 12).alias("with_skips"), hex_bytes("doc_id").alias("vbyte"), hex_bytes("gap").alias("gap_vbyte"),
        F.sum(F.length(ix.gamma(F.col("tf"))).cast("long")).alias("gamma_bits"), F.sum(F.length(ix.gamma(F.col("tf"), True)) / 8).cast("long").alias("gamma_bytes"),
    )


@query(f"WITH {INDEX_SQL} SELECT term, doc_id, tf FROM post")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings again from their codes."""
    rows = index(spark, sf_dir)
    return rows.select("term", ix.unvbyte(ix.vbyte(F.col("doc_id"))).alias("doc_id"), ix.ungamma(ix.gamma(F.col("tf"), True)).alias("tf"))


@query(f"WITH {INDEX_SQL} SELECT term, doc_id, CAST(1 AS BIGINT) AS tf FROM post")
def index_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines `term:df:ids,` of each part of a list written from the index and read back."""
    lists = ix.posting_lists(index(spark, sf_dir)).withColumn("ids", F.col("postings.doc_id"))
    lines = lists.select(F.concat("term", F.lit(":"), "df", F.lit(":"), F.array_join(F.col("ids").cast("array<string>"), ","), F.lit(",")).alias("value"))
    return readers.prebuilt_index(lines)


# ---- evaluation

#: Documents of a run that are evaluated: as many as the evaluated systems return where nothing else is asked of them.
DEPTH = 1000
SYSTEMS = ("rank_bm25", "rank_tfidf", "rank_hiemstra", "rank_dirichlet")


@shared("runs")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, qid, doc_id, score and rank of the first documents of each system."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("system"), F.col(n).alias("score")) for n in SYSTEMS)))
    rows = scored(spark, sf_dir, SYSTEMS).select("qid", "doc_id", each.alias("s")).select("s.system", "qid", "doc_id", "s.score")
    return rk.top(rows, DEPTH, ["system", "qid"])


_EVAL = f"""{CTES}, {QRELS_SQL}, {', '.join(_top_sql(RUN_SQL[s], DEPTH, f'run_{s}') for s in SYSTEMS)},
  runs AS ({' UNION ALL '.join(f"SELECT '{s}' AS system, * FROM run_{s}" for s in SYSTEMS)}),
  rc AS (SELECT qid, count(*) AS n_relevant FROM qrels GROUP BY qid),
  jd AS (SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS relevant FROM runs r LEFT JOIN qrels q ON r.qid = q.qid AND r.doc_id = q.doc_id),
  pr AS (SELECT system, qid, doc_id, rank, relevant, n_relevant, CAST(sum(relevant) OVER (PARTITION BY system, qid ORDER BY rank) AS BIGINT) AS hits FROM jd JOIN rc USING (qid)),
  sy AS (SELECT unnest({list(SYSTEMS)}) AS system),
  pq AS (SELECT system, qid, coalesce(sum(relevant * hits / rank), 0) / any_value(n_relevant) AS ap,
      coalesce(sum(relevant / {L2('rank + 1')}), 0) / any_value(idcg) AS ndcg, coalesce(sum(CASE WHEN rank <= 10 THEN relevant ELSE 0 END), 0) / 10 AS p_at_k
    FROM (SELECT system, qid, n_relevant, (SELECT sum(1 / {L2('i + 1')}) FROM unnest(range(1, n_relevant + 1)) AS u(i)) AS idcg FROM sy, rc)
    LEFT JOIN (SELECT system, qid, rank, relevant, hits FROM pr) USING (system, qid) GROUP BY system, qid),
  lf AS (SELECT system, qid, measure, value FROM pq UNPIVOT (value FOR measure IN (ap, ndcg, p_at_k))),
  cv AS (SELECT system, qid, level, max(p) AS p FROM (SELECT system, qid, unnest(range(0, 11)) AS level FROM sy, rc) LEFT JOIN (SELECT system, qid, hits, n_relevant, hits / rank AS p FROM pr) USING (system, qid)
    WHERE p IS NULL OR hits * 10 // n_relevant >= level GROUP BY ALL),
  cw AS (SELECT system, qid, level, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY system, qid ORDER BY level), 0) AS precision
    FROM (SELECT system, qid, unnest(range(0, 11)) AS level FROM sy, rc) LEFT JOIN cv USING (system, qid, level))"""


def _each(spark: SparkSession, sf_dir: str, what) -> DataFrame:
    """what(run, qrels) of every system in one plan: a system's query is a query of its own."""
    systems = F.explode(F.array(*map(F.lit, SYSTEMS)))
    judged = qrels(spark, sf_dir).select(systems.alias("system"), "qid", "doc_id").select(F.struct("system", "qid").alias("qid"), "doc_id")
    found = what(runs(spark, sf_dir).withColumn("qid", F.struct("system", "qid")).drop("system"), judged)
    rest = [c for c in found.columns if c != "qid"]
    return found.select("qid.system", "qid.qid", *rest)


@query(f"WITH {QRELS_SQL} SELECT qid, doc_id FROM qrels")
def qrels_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qrels(spark, sf_dir)


@query(f"WITH {QRELS_SQL}, {TOPICS_SQL} SELECT qid, coalesce(any_value(query), '') AS query, count(*) AS n_relevant, string_agg(doc_id, ',' ORDER BY doc_id) AS relevant FROM qrels LEFT JOIN top USING (qid) GROUP BY qid")
def relevant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = qrels(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n_relevant"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return lists.join(topics(spark, sf_dir), "qid", "left").select("qid", F.coalesce("query", F.lit("")).alias("query"), "n_relevant", F.array_join(F.col("ids").cast("array<string>"), ",").alias("relevant"))


@query(f"{_EVAL} SELECT system, qid, doc_id, score, rank, CAST(relevant AS BIGINT) AS relevant FROM jd WHERE rank <= 11")
def run_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda run, q: evaluation.judged(run.where("rank <= 11"), q)).select("system", "qid", "doc_id", "score", "rank", "relevant")


@query(f"{_EVAL} SELECT system, qid, doc_id, rank, hits, round(hits / rank, 6) AS precision, round(hits / n_relevant, 6) AS recall FROM pr")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _each(spark, sf_dir, evaluation.precision_recall)
    return rows.select("system", "qid", "doc_id", "rank", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_EVAL} SELECT system, qid, measure, round(value, 6) AS value FROM lf")
def metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _each(spark, sf_dir, lambda run, q: evaluation.long_form(evaluation.per_query(run, q)))
    return rows.select("system", "qid", "measure", F.round("value", 6).alias("value"))


@query(f"{_EVAL} SELECT system, round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg, round(avg(p_at_k), 6) AS p10 FROM pq GROUP BY system")
def map_ndcg_p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _each(spark, sf_dir, evaluation.per_query)
    return rows.groupBy("system").agg(F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("p_at_k"), 6).alias("p10"))


@query(f"{_EVAL} SELECT system, qid, level, round(precision, 6) AS precision FROM cw")
def pr_curve_11pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, evaluation.curve).select("system", "qid", "level", F.round("precision", 6).alias("precision"))


@query(f"{_EVAL} SELECT system, level, round(avg(precision), 6) AS precision FROM cw GROUP BY system, level")
def pr_curve_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, evaluation.curve).groupBy("system", "level").agg(F.round(F.avg("precision"), 6).alias("precision"))


@query(f"""{_EVAL}, rv AS (SELECT system, measure, round(value, 6) AS value FROM lf), en AS (SELECT system, measure, min(value) AS low, max(value) AS high FROM rv GROUP BY ALL)
  SELECT system, measure, CAST(coalesce(least(14, floor((value - low) / nullif(high - low, 0) * 15)), 0) AS BIGINT) AS bin, count(*) AS n FROM rv JOIN en USING (system, measure) GROUP BY ALL""")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(metrics_per_query(spark, sf_dir), ["system", "measure"])


DEPTHS = (10, 25, 50)


def _correlation_sql(k: int) -> str:
    return f"""{CTES}, a AS ({RUN_SQL['rank_tfidf']}), b AS ({RUN_SQL['rank_bm25']}),
  f AS (SELECT * FROM (SELECT qid, doc_id, a.score AS x, b.score AS y, row_number() OVER (PARTITION BY qid ORDER BY a.score DESC, doc_id) AS r FROM a JOIN b USING (qid, doc_id)) WHERE r <= {k}),
  g AS (SELECT * FROM f WHERE qid IN (SELECT qid FROM f GROUP BY qid HAVING count(*) = {k})),
  h AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY x DESC) + (count(*) OVER (PARTITION BY qid, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY qid ORDER BY y DESC) + (count(*) OVER (PARTITION BY qid, y) - 1) / 2 AS ry FROM g),
  rh AS (SELECT qid, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM h GROUP BY qid),
  ta AS (SELECT p.qid, sum(sign(p.rx - q.rx) * sign(p.ry - q.ry)) / nullif(sqrt(sum(abs(sign(p.rx - q.rx))) * sum(abs(sign(p.ry - q.ry)))), 0) AS tau FROM h p JOIN h q ON p.qid = q.qid AND p.r < q.r GROUP BY p.qid)
  SELECT qid, round(rho, 6) AS rho, round(tau, 6) AS tau FROM rh JOIN ta USING (qid)"""


@query(" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS top_k, * FROM ({_correlation_sql(k)})" for k in DEPTHS))
def model_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho and Kendall's tau-b of two models over the first 10, 25 and 50 documents of one; a query has no row for a depth that it does not reach."""
    both = scored(spark, sf_dir, ("rank_tfidf", "rank_bm25")).withColumnsRenamed({"rank_tfidf": "score", "rank_bm25": "other"})
    deepest = materialize(rk.top(both, max(DEPTHS)), "correlated")  # each depth is a prefix of it
    a, b = deepest.select("qid", "doc_id", "score"), deepest.select("qid", "doc_id", F.col("other").alias("score"))
    each = [evaluation.correlation(a, b, k).withColumn("top_k", F.lit(k).cast("long")) for k in DEPTHS]
    rows = reduce(DataFrame.unionByName, each)
    return rows.select("top_k", "qid", F.round("rho", 6).alias("rho"), F.round("tau", 6).alias("tau"))
