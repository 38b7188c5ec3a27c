"""From documents to an inverted index: tokens, postings, vocabulary, norms, physical layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import stopwords, text
from textloom.operators.scan import ordered_scan
from textloom.scratch import materialize


def tokens(docs: DataFrame, pattern: str = text.SPANISH, lower: bool = True, column: str = "text", key: str = "doc_id") -> DataFrame:
    """key, pos (from 0) and term of each token."""
    return docs.select(key, F.posexplode(text.tokens(F.col(column), pattern, lower)).alias("pos", "term"))


def keep_terms(tokens: DataFrame, stop: tuple[str, ...] = stopwords.ENGLISH, longer_than: int = 3, at_most: int = 3000) -> DataFrame:
    """Tokens of a valid length that are no stop-words. The list is a bounded parameter, so it becomes a set in the filter."""
    kept = tokens.where((F.length("term") > longer_than) & (F.length("term") <= at_most))
    return kept.where(~F.col("term").isin(*stop)) if stop else kept


def postings(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    return tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))


def index(docs: DataFrame, column: str = "text") -> DataFrame:
    """Postings of the default index: letters of Spanish, longer than 3, English stop-words out."""
    return postings(keep_terms(tokens(docs, column=column)))


def row_index(docs: DataFrame, column: str = "text") -> DataFrame:
    """index() of documents with ids of their own, and dl (the document's kept tokens): terms are counted within the row, so nothing is dealt out.

    The outer explode: for the plain one Spark adds a filter that works out the array once more.
    """
    kept = F.filter(text.tokens(F.col(column), text.SPANISH), lambda t: (F.length(t) > 3) & (F.length(t) <= 3000) & ~t.isin(*stopwords.ENGLISH))
    rows = docs.select("doc_id", kept.alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), text.counted(F.col("w")).alias("c"))
    return rows.select("doc_id", "dl", F.explode_outer("c").alias("c")).where("c IS NOT NULL").select("doc_id", F.col("c.item").alias("term"), F.col("c.n").alias("tf"), "dl")


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def statistics(docs: DataFrame, tokens: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents, terms and tokens; tokens are counted before any filter."""
    n = docs.agg(F.count("*").alias("n_docs"))
    t = postings.agg(F.countDistinct("term").alias("n_terms"))
    return n.crossJoin(t).crossJoin(tokens.agg(F.count("*").alias("n_tokens")))


def term_ids(postings: DataFrame) -> DataFrame:
    """term and term_id (from 0) by first appearance: least document, then the term."""
    first = postings.groupBy("term").agg(F.min("doc_id").alias("first_doc"))
    return ordered_scan(first, ["first_doc", "term"]).select("term", (F.col("row_number") - 1).alias("term_id"))


def offsets(postings: DataFrame, width: int = 8) -> DataFrame:
    """term_id, term, df and the byte offset of the term's list at `width` bytes a posting (8; 12 with skips)."""
    sized = postings.groupBy("term").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("df"))
    placed = ordered_scan(sized, ["first_doc", "term"], {"before": "df"})
    return placed.select((F.col("row_number") - 1).alias("term_id"), "term", "df", (F.col("before") * width).alias("offset"))


#: Document numbers of a part of a posting list: no list is sorted, windowed or held in one piece.
SPAN = 1 << 16


def parts(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """Postings with part, and of the term's parts before it: before (their postings) and previous (their last document, or 0); df of the whole list."""
    cut = postings.withColumn("part", F.expr(f"doc_id div {span}"))
    sizes = cut.groupBy("term", "part").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    by_part = Window.partitionBy("term").orderBy("part")
    known = sizes.select(
        "term", "part",
        F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.lag("last").over(by_part), F.lit(0)).alias("previous"),
        F.sum("n").over(Window.partitionBy("term")).alias("df"),
    )
    return cut.join(known, ["term", "part"])


def posting_lists(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """term, part, df and the postings of that part in order of document."""
    pile = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    return parts(postings, span).groupBy("term", "part").agg(F.first("df").alias("df"), pile.alias("postings"))


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with the documents' names in place of their numbers; names: doc_id and doc_name."""
    return rows.join(names.select("doc_id", "doc_name"), "doc_id").drop("doc_id")


def norms(postings: DataFrame, n_docs: Column | int, vocabulary: DataFrame | None = None) -> DataFrame:
    """doc_id and the Euclidean norm of (1 + log2 tf) * log2(N / df)."""
    vocab = postings.groupBy("term").agg(F.count("*").alias("df")) if vocabulary is None else vocabulary.select("term", "df")
    w = (1 + text.log2(F.col("tf"))) * text.log2(n_docs / F.col("df"))
    return postings.join(vocab, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


# ---- the physical layout as data


def skips(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """Postings with idx (from 0) and skip_to: every int(sqrt(df))-th entry points that far ahead, the others hold 0."""
    step = F.floor(F.sqrt(F.col("df"))).cast("long")
    own = Window.partitionBy("term", "part").orderBy("doc_id")
    numbered = parts(postings, span).withColumn("idx", (F.row_number().over(own) - 1 + F.col("before")).cast("long"))
    to = F.when((F.col("idx") % step == 0) & (F.col("idx") + step < F.col("df")), F.col("idx") + step).otherwise(0)
    return numbered.select("term", "doc_id", "tf", "idx", to.cast("long").alias("skip_to"))


def gaps(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """Postings with part, previous and gap, the distance to the term's previous document (the first: to 0)."""
    own = Window.partitionBy("term", "part").orderBy("doc_id")
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(own), F.col("previous"))
    return parts(postings, span).withColumn("gap", gap).select("term", "part", "df", "previous", "doc_id", "tf", "gap")


def ungap(gapped: DataFrame, order: str) -> DataFrame:
    """The documents again, from gaps in the order of a column within each part."""
    own = Window.partitionBy("term", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return gapped.withColumn("doc_id", F.col("previous") + F.sum("gap").over(own))


def vbyte(n: Column) -> Column:
    """Hex of the groups of 7 bits, high ones first; the last byte has its top bit set."""
    group = lambda k: F.shiftright(n, 7 * k) % 128
    parts = [F.when((F.shiftright(n, 7 * k) > 0) if k else F.lit(True), F.lpad(F.hex(group(k) + (0 if k else 128)), 2, "0")).otherwise("") for k in range(8, -1, -1)]
    return F.concat(*parts)


def unvbyte(code: Column) -> Column:
    """The number that a vbyte hex string stands for."""
    at = F.sequence(F.lit(1), F.length(code) - 1, F.lit(2))
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a * 128 + F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("long") % 128)


def gamma(n: Column, padded: bool = False) -> Column:
    """Elias gamma bits of n >= 1: its length in ones (less one), a 0, the bits after the first; padded to whole bytes on request."""
    bits = F.bin(n)
    code = F.concat(F.repeat(F.lit("1"), F.length(bits) - 1), F.lit("0"), F.substring(bits, F.lit(2), F.length(bits)))
    return F.rpad(code, (8 * F.ceil(F.length(code) / 8)).cast("int"), F.lit("0")) if padded else code


def ungamma(code: Column) -> Column:
    """The number that gamma bits (padded or not) stand for."""
    ones = F.instr(code, "0") - 1
    return F.conv(F.concat(F.lit("1"), F.substring(code, ones + 2, ones)), 2, 10).cast("long")


def compressed(postings: DataFrame, use_gaps: bool = True, span: int = SPAN) -> DataFrame:
    """term, part, df, previous, n, docs (vbyte hex) and freqs (padded gamma bits) of each part of a list, with the bits that each takes."""
    rows = gaps(postings, span) if use_gaps else gaps(postings, span).withColumn("gap", F.col("doc_id"))
    coded = rows.select("term", "part", "df", "previous", "doc_id", vbyte(F.col("gap")).alias("d"), gamma(F.col("tf"), True).alias("f"))
    pile = F.sort_array(F.collect_list(F.struct("doc_id", "d", "f")))
    lists = coded.groupBy("term", "part").agg(F.first("df").alias("df"), F.first("previous").alias("previous"), F.count("*").alias("n"), pile.alias("p"))
    lists = lists.select("term", "part", "df", "previous", "n", F.array_join("p.d", "").alias("docs"), F.array_join("p.f", "").alias("freqs"))
    return lists.withColumns({"docs_bits": (F.length("docs") * 4).cast("long"), "freqs_bits": F.length("freqs").cast("long")})


def store_compressed(postings: DataFrame, use_gaps: bool = True, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The compressed index as two tables: a vocabulary with the bit at which each part's codes begin, and the codes by those bits.

    Vocabulary: term, part, df, previous, n, docs_at and freqs_at. Codes: docs_at, freqs_at, docs and freqs, in that order.
    """
    lists = materialize(compressed(postings, use_gaps, span), "compressed")  # the codes stay there while their bits are counted
    placed = ordered_scan(lists.drop("docs", "freqs"), ["term", "part"], {"docs_at": "docs_bits", "freqs_at": "freqs_bits"})
    vocabulary = placed.select("term", "part", "df", "previous", "n", "docs_at", "freqs_at")
    codes = lists.select("term", "part", "docs", "freqs").join(placed.select("term", "part", "docs_at", "freqs_at"), ["term", "part"])
    return vocabulary, codes.select("docs_at", "freqs_at", "docs", "freqs")


#: A vbyte code in hex: bytes without the top bit, then one with it.
_VBYTE = "(?:[0-7][0-9A-F])*[89A-F][0-9A-F]"
#: A padded gamma code: k ones, a 0 and what is left of its bytes, for every k that a frequency may need.
_GAMMA = "|".join(f"1{{{k}}}0[01]{{{8 * -(-(2 * k + 1) // 8) - k - 1}}}" for k in range(40))


def lookup(vocabulary: DataFrame, codes: DataFrame, terms: DataFrame) -> DataFrame:
    """The parts of the lists of some terms, found by the bits at which they begin."""
    return vocabulary.join(terms.select("term").distinct(), "term").join(codes, ["docs_at", "freqs_at"])


def decompress(lists: DataFrame, use_gaps: bool = True) -> DataFrame:
    """term, doc_id, tf and df from parts of compressed lists."""
    codes = F.arrays_zip(F.regexp_extract_all("docs", F.lit(_VBYTE), F.lit(0)).alias("d"), F.regexp_extract_all("freqs", F.lit(_GAMMA), F.lit(0)).alias("f"))
    rows = lists.select("term", "part", "df", "previous", F.posexplode(codes).alias("at", "c"))
    rows = rows.select("term", "part", "df", "previous", "at", unvbyte(F.col("c.d")).alias("gap"), ungamma(F.col("c.f")).alias("tf"))
    rows = ungap(rows, "at") if use_gaps else rows.withColumnRenamed("gap", "doc_id")
    return rows.select("term", "doc_id", "tf", "df")
