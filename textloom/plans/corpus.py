"""Queries on tokens, vocabulary, statistics, entities, distribution laws and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import stemmers, stopwords, text
from textloom.operators import index as ix
from textloom.operators import profiles, stats
from textloom.plans.base import ASCII_SQL, INDEX_SQL, ascii_postings, docs, index, query, tokens_sql, shared, unique_ids
from textloom.scratch import materialize
from textloom.sources.readers import table


@query(f"WITH {ASCII_SQL} SELECT doc_id, term, tf FROM post")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(ix.tokens(docs(spark, sf_dir), text.ASCII))


@query(f"WITH {ASCII_SQL} SELECT term, df, cf FROM voc")
def vocab_df_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.vocabulary(ascii_postings(spark, sf_dir))


@query(f"WITH {ASCII_SQL} SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM voc) AS n_terms, (SELECT count(*) FROM tok) AS n_tokens")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = docs(spark, sf_dir)
    return ix.statistics(every, ix.tokens(every, text.ASCII), ascii_postings(spark, sf_dir))


_LENGTHS = f"n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{text.ASCII}')) AS n FROM documents)"


@query(f"WITH {_LENGTHS} SELECT min(n) AS shortest, (SELECT min(doc_id) FROM n WHERE n = (SELECT min(n) FROM n)) AS shortest_doc, max(n) AS longest, (SELECT min(doc_id) FROM n WHERE n = (SELECT max(n) FROM n)) AS longest_doc FROM n")
def doc_length_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = docs(spark, sf_dir).select("doc_id", F.size(text.tokens(F.col("text"), text.ASCII)).cast("long").alias("n"))
    return n.agg(
        F.min("n").alias("shortest"), F.min_by("doc_id", F.struct("n", "doc_id")).alias("shortest_doc"),
        F.max("n").alias("longest"), F.min_by("doc_id", F.struct(-F.col("n"), "doc_id")).alias("longest_doc"),
    )


_VALID = f"WITH {ASCII_SQL}, ok AS (SELECT * FROM post WHERE length(term) BETWEEN 1 AND 3000 AND term NOT IN ({stopwords.sql_list(stopwords.SPANISH)})), v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM ok GROUP BY term)"


@query(f"""{_VALID} SELECT round((SELECT count(*) FROM tok) / (SELECT count(*) FROM documents), 6) AS tokens_a_doc,
  round((SELECT count(*) FROM ok) / (SELECT count(*) FROM documents), 6) AS terms_a_doc, (SELECT CAST(sum(length(term)) // count(*) AS BIGINT) FROM v) AS term_length""")
def corpus_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, rows = docs(spark, sf_dir), ascii_postings(spark, sf_dir)
    valid = rows.where(F.length("term").between(1, 3000) & ~F.col("term").isin(*stopwords.SPANISH))
    n = every.agg(F.count("*").alias("n"))
    counts = rows.agg(F.sum("tf").alias("t")).crossJoin(valid.agg(F.count("*").alias("p"))).crossJoin(n)  # one row each
    lengths = valid.select("term").distinct().agg((F.sum(F.length("term")) / F.count("*")).alias("l"))
    return counts.crossJoin(lengths).select(F.round(F.col("t") / F.col("n"), 6).alias("tokens_a_doc"), F.round(F.col("p") / F.col("n"), 6).alias("terms_a_doc"), F.floor("l").cast("long").alias("term_length"))


@query(f"WITH {ASCII_SQL} SELECT count(*) AS hapaxes FROM voc WHERE cf = 1")
def hapax_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.vocabulary(ascii_postings(spark, sf_dir)).where("cf = 1").agg(F.count("*").alias("hapaxes"))


@query(f"WITH {ASCII_SQL} SELECT term, cf FROM voc ORDER BY cf DESC, term LIMIT 10")
def top10_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.vocabulary(ascii_postings(spark, sf_dir)).select("term", "cf").orderBy(F.desc("cf"), "term").limit(10)


@query(f"WITH {ASCII_SQL} SELECT term, cf FROM voc ORDER BY cf, term LIMIT 10")
def bottom10_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.vocabulary(ascii_postings(spark, sf_dir)).select("term", "cf").orderBy("cf", "term").limit(10)


def _tokenizer(name: str, pattern: str, lower: bool, sql_pattern: str | None = None, sql_where: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ix.tokens(docs(spark, sf_dir), pattern, lower)
        return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"), F.min("term").alias("first"), F.max("term").alias("last"))

    run.__name__ = name
    query(f"WITH {tokens_sql(sql_pattern or pattern, lower)} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, min(term) AS first, max(term) AS last FROM tok {sql_where} GROUP BY doc_id")(run)


_tokenizer("tokens_ascii", text.ASCII, True)
_tokenizer("tokens_unicode", text.UNICODE, True)
_tokenizer("tokens_es_letters", text.SPANISH, True)
_tokenizer("tokens_alnum", text.ALNUM, False)
_tokenizer("tokens_residual", text.RESIDUAL, False)
# RE2 has no look-around: whole words of the wider class, then those of Spanish letters only
_tokenizer("tokens_query", text.QUERY, True, text.UNICODE, f"WHERE regexp_full_match(term, '{text.SPANISH}')")


@query(f"WITH {INDEX_SQL} SELECT doc_id, term, tf FROM post")
def stopword_filtered_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index(docs(spark, sf_dir))


@query(f"WITH {tokens_sql(text.SPANISH)} SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({stopwords.sql_list(stopwords.SPANISH)}) GROUP BY doc_id, term")
def spanish_filtered_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(ix.keep_terms(ix.tokens(docs(spark, sf_dir)), stopwords.SPANISH, longer_than=0))


# ---- entities and pages


def _entity(kind: str, pattern: str) -> None:
    # addresses of pages are looked through for URLs as well
    more = kind == "url"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = docs(spark, sf_dir).select("text")
        texts = texts.union(table(spark, sf_dir, "pages").select("url")) if more else texts
        found = texts.select(F.explode(text.matches(F.col("text"), pattern)).alias("entity"))
        return found.groupBy(F.lower("entity").alias("entity")).agg(F.count("*").alias("n"))

    run.__name__ = f"entity_{kind}_counts"
    query(f"SELECT lower(e) AS entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{pattern}')) AS e FROM (SELECT text FROM documents{' UNION ALL SELECT url FROM pages' if more else ''})) GROUP BY 1")(run)


for _kind, _pattern in text.ENTITIES.items():
    _entity(_kind, _pattern)


def _chain_sql() -> str:
    columns, rest = [], "text"
    for kind, pattern in text.ENTITIES.items():
        columns.append(f"len(regexp_extract_all({rest}, '{pattern}')) AS n_{kind}")
        rest = f"regexp_replace({rest}, '{pattern}', '', 'g')"
    return f"SELECT doc_id, {', '.join(columns)}, len(regexp_extract_all({rest}, '{text.RESIDUAL}')) AS n_word FROM documents"


@query(_chain_sql())
def entity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", *(F.size(c).cast("long").alias(f"n_{k}") for k, c in text.entities(F.col("text")).items()))


_PLAIN = "html"
for _gone in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_gone}', ' ', 'g')"
for _code, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_code}', '{_char}')"


@query(f"SELECT page_id, length({_PLAIN}) AS n_chars, len(regexp_extract_all(lower({_PLAIN}), '{text.UNICODE}')) AS n_tokens FROM pages")
def html_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))
    return plain.select("page_id", F.length("text").cast("long").alias("n_chars"), F.size(text.tokens(F.col("text"), text.UNICODE)).cast("long").alias("n_tokens"))


@query(f"SELECT term, count(DISTINCT page_id) AS df FROM (SELECT page_id, unnest(regexp_extract_all(lower({_PLAIN}), '{text.UNICODE}')) AS term FROM pages) GROUP BY term")
def html_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.html_text(F.col("html")).alias("text"))
    return ix.vocabulary(ix.postings(ix.tokens(plain, text.UNICODE))).select("term", "df")


_TIDY = f"array_to_string(list_filter(list_transform(flatten(list_transform(string_split({_PLAIN}, chr(10)), lambda l: string_split(trim(l), '  '))), lambda p: trim(p)), lambda p: p <> ''), chr(10))"


@query(f"SELECT page_id, md5({_TIDY}) AS digest, length({_TIDY}) AS n_chars FROM pages")
def html_tidy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = table(spark, sf_dir, "pages").select("page_id", text.tidy(text.html_text(F.col("html"))).alias("text"))
    return plain.select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n_chars"))


# ---- distribution laws

_RANKED = f"WITH {ASCII_SQL}, rf AS (SELECT row_number() OVER (ORDER BY cf DESC, term) AS rank, term, cf AS freq FROM voc)"


@query(f"{_RANKED} SELECT rank, term, freq FROM rf")
def zipf_rank_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_freq(ascii_postings(spark, sf_dir)).select(F.col("rank").cast("long").alias("rank"), "term", "freq")


@query(f"{_RANKED} SELECT round(regr_slope(ln(freq), ln(rank)), 6) AS slope, round(regr_intercept(ln(freq), ln(rank)), 6) AS intercept, round(regr_r2(ln(freq), ln(rank)), 6) AS r2 FROM rf")
def zipf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = stats.zipf_fit(stats.rank_freq(ascii_postings(spark, sf_dir)))
    return fit.select(*(F.round(c, 6).alias(c) for c in fit.columns))


@query(f"""{_RANKED}, sh AS (SELECT (SELECT max(freq) FROM rf) AS top, unnest([10, 20, 30]) AS per_cent, (SELECT count(*) FROM rf) AS v)
  SELECT per_cent, v * per_cent // 100 AS top_n, CAST(round_even(sum(top / (rank - 1 + 0.119::DOUBLE)), 0) AS BIGINT) AS estimated, CAST(sum(freq) AS BIGINT) AS real
  FROM sh JOIN rf ON rank <= v * per_cent // 100 GROUP BY ALL""")
def zipf_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zipf_estimate(stats.rank_freq(ascii_postings(spark, sf_dir)))


_HEAPS = f"""WITH {tokens_sql(text.UNICODE)}, sz AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
  fr AS (SELECT doc_id, count(*) AS v FROM (SELECT term, min(doc_id) AS doc_id FROM tok GROUP BY term) GROUP BY doc_id),
  hp AS (SELECT doc_id, CAST(sum(n) OVER w AS BIGINT) AS n_tokens, CAST(sum(coalesce(v, 0)) OVER w AS BIGINT) AS n_unique FROM sz LEFT JOIN fr USING (doc_id) WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.heaps_curve(ix.tokens(docs(spark, sf_dir), text.UNICODE))


@query(f"{_HEAPS} SELECT doc_id, n_tokens, n_unique FROM hp")
def heaps_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir)


@query(f"{_HEAPS} SELECT round(regr_slope(ln(n_unique), ln(n_tokens)), 6) AS beta, round(regr_intercept(ln(n_unique), ln(n_tokens)), 6) AS ln_k, round(regr_r2(ln(n_unique), ln(n_tokens)), 6) AS r2 FROM hp")
def heaps_loglog(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = stats.heaps_seed(_curve(spark, sf_dir))
    return fit.select(*(F.round(c, 6).alias(c) for c in fit.columns))


@query()
def heaps_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K, beta and R2 by non-linear least squares: iterations, so no SQL; held against numpy in the tests."""
    k, beta, r2 = stats.heaps_fit(materialize(_curve(spark, sf_dir), "heaps"))
    return spark.range(1).select(F.lit(k).alias("k"), F.lit(beta).alias("beta"), F.lit(r2).alias("r2"))


# ---- languages


def _grams_sql(pairs: bool) -> str:
    if pairs:
        return "list_filter(list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1]), lambda p: NOT contains(p, ' '))"
    return "list_filter(cs, lambda p: p <> ' ')"


def _profile_sql(key: str, pairs: bool, name: str) -> str:
    return f"""{name}c AS (SELECT {key}, gram, CAST(count(*) AS DOUBLE) AS f FROM (SELECT {key}, unnest({_grams_sql(pairs)}) AS gram FROM (SELECT {key}, regexp_extract_all(text, '(?s).') AS cs FROM documents)) GROUP BY ALL),
{name} AS (SELECT {key}, gram, CASE WHEN max(f) OVER w = min(f) OVER w THEN 0.5 ELSE (f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w) END AS f FROM {name}c WINDOW w AS (PARTITION BY {key}))"""


def _rounded(profile: DataFrame) -> DataFrame:
    return profile.select("lang", "gram", F.round("f", 6).alias("f"))


@query(f"WITH {_profile_sql('lang', False, 'p')} SELECT lang, gram, round(f, 6) AS f FROM p")
def char_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.profile(docs(spark, sf_dir), "lang", pairs=False))


@query(f"WITH {_profile_sql('lang', True, 'p')} SELECT lang, gram, round(f, 6) AS f FROM p")
def bigram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_languages(spark, sf_dir))


_LANGID = f"""WITH {_profile_sql('doc_id', True, 'd')}, {_profile_sql('lang', True, 'l')},
  co AS (SELECT doc_id, lang, count(*) AS m, sum(d.f * l.f) AS xy FROM d JOIN l USING (gram) GROUP BY doc_id, lang),
  dt AS (SELECT doc_id, count(*) AS xn, sum(f) AS xs, sum(f * f) AS xq FROM d GROUP BY doc_id),
  lt AS (SELECT lang, count(*) AS yn, sum(f) AS ys, sum(f * f) AS yq FROM l GROUP BY lang),
  r AS (SELECT doc_id, lang, (n * xy - xs * ys) / nullif(sqrt(greatest(n * xq - xs * xs, 0)) * sqrt(greatest(n * yq - ys * ys, 0)), 0) AS r
    FROM (SELECT *, xn + yn - m AS n FROM co JOIN dt USING (doc_id) JOIN lt USING (lang))),
  best AS (SELECT doc_id, lang AS pred, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(r, 9) DESC NULLS LAST, lang) AS k FROM r) WHERE k = 1)"""


@shared("grams of documents")
def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.grams(docs(spark, sf_dir), "doc_id", "lang")


@shared("profiles of languages")
def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_of(_grams(spark, sf_dir), "lang")


#: Rows of the profiles of languages up to which they are broadcast.
FEW_GRAMS = 1_000_000


@shared("languages found")
def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, languages = _grams(spark, sf_dir), _languages(spark, sf_dir)
    if unique_ids(spark, sf_dir) and languages.count() <= FEW_GRAMS:
        return profiles.best_language(profiles.row_correlations(counts, languages))
    samples = materialize(profiles.profile_of(counts, "doc_id"), "profiles")
    return profiles.best_language(profiles.correlations(samples, languages))


@query(f"{_LANGID} SELECT doc_id, pred, round(r, 6) AS r FROM best")
def langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).withColumn("r", F.round("r", 6))


@query(f"{_LANGID} SELECT lang, pred, count(*) AS n FROM best JOIN documents USING (doc_id) GROUP BY lang, pred")
def langid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").groupBy("lang", "pred").agg(F.count("*").alias("n"))


# ---- stems


def _stems(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stemmers.stemmed(index(spark, sf_dir), name)
        return ix.vocabulary(rows)

    run.__name__ = f"stem_{name}"
    query()(run)


for _name in stemmers.STEMMERS:
    _stems(_name)

