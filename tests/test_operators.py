"""Hand-checked values, round trips and brute force for what SQL cannot express."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import stemmers, text
from textloom.operators import boolean, evaluation, stats, web
from textloom.operators import index as ix
from textloom.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("n,code", [(0, "80"), (5, "85"), (127, "FF"), (128, "0180"), (824, "06B8"), (214577, "0D0CB1")])
def test_vbyte(spark, n, code):
    assert one(spark, ix.vbyte(F.lit(n).cast("long"))) == code
    assert one(spark, ix.unvbyte(F.lit(code))) == n


@pytest.mark.parametrize("n,bits", [(1, "0"), (2, "100"), (9, "1110001")])
def test_gamma(spark, n, bits):
    assert one(spark, ix.gamma(F.lit(n).cast("long"))) == bits
    assert one(spark, ix.ungamma(ix.gamma(F.lit(n).cast("long"), True))) == n


def test_codes_of_many_numbers(spark):
    rows = spark.range(1, 70_000, 37).select("id", ix.unvbyte(ix.vbyte(F.col("id"))).alias("a"), ix.ungamma(ix.gamma(F.col("id"), True)).alias("b"))
    assert rows.where("id <> a OR id <> b").count() == 0


def test_skips_and_gaps(spark):
    rows = spark.createDataFrame([("t", i * 3, 1) for i in range(10)] + [("u", 5, 1)], "term string, doc_id long, tf long")
    assert {r.idx: r.skip_to for r in ix.skips(rows).where("term = 't'").collect()} == {i: {0: 3, 3: 6, 6: 9}.get(i, 0) for i in range(10)}
    assert ix.skips(rows).where("term = 'u'").first().skip_to == 0
    three = spark.createDataFrame([("t", d, 1) for d in (3, 7, 11)], "term string, doc_id long, tf long")
    assert [r.gap for r in ix.gaps(three).orderBy("doc_id").collect()] == [3, 4, 4]


@pytest.mark.parametrize("span", [3, 10, 1 << 16])
def test_lists_in_parts(spark, span):
    """Skips, gaps and codes do not depend on where a list is cut."""
    rows = [("t", d, 1 + d % 300) for d in range(0, 90, 2)] + [("u", 50, 2**31)]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    found = {(r.term, r.doc_id): (r.idx, r.skip_to) for r in ix.skips(postings, span).collect()}
    assert found == {("t", d): (i, i + 6 if i % 6 == 0 and i + 6 < 45 else 0) for i, d in enumerate(range(0, 90, 2))} | {("u", 50): (0, 0)}
    assert {r.gap for r in ix.gaps(postings, span).where("term = 't' AND doc_id > 0").collect()} == {2}
    assert sum(len(r.postings) for r in ix.posting_lists(postings, span).collect()) == 46
    for use_gaps in (True, False):
        vocabulary, codes = ix.store_compressed(postings, use_gaps, span)
        assert vocabulary.groupBy("docs_at", "freqs_at").count().where("count > 1").count() == 0
        some = ix.decompress(ix.lookup(vocabulary, codes, spark.createDataFrame([("t",), ("none",)], "term string")), use_gaps)
        assert sorted((r.term, r.doc_id, r.tf) for r in some.collect()) == rows[:-1]
        assert sorted((r.term, r.doc_id, r.tf) for r in ix.decompress(ix.compressed(postings, use_gaps, span), use_gaps).collect()) == rows


def test_tokenizers(spark):
    get = lambda s, p: one(spark, text.tokens(F.lit(s), p))
    assert get("El niño, 2 veces", text.ASCII) == ["el", "ni", "o", "veces"]
    assert get("el niño está_1", text.UNICODE) == ["el", "niño", "está_1"]
    assert one(spark, text.bigrams(F.lit("ab c😀d"))) == ["ab", "c😀", "😀d"]
    assert one(spark, text.bigrams(F.lit(""))) == []


def test_porter():
    pairs = "caresses:caress ponies:poni feed:feed agreed:agre plastered:plaster sing:sing hopping:hop filing:file happy:happi sky:sky relational:relat vietnamization:vietnam triplicate:triplic electrical:electr revival:reviv adjustable:adjust bowdlerize:bowdler controll:control roll:roll"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert stemmers.porter(word) == stem


def test_lancaster():
    for word, stem in {"maximum": "maxim", "presumably": "presum", "multiply": "multiply", "provision": "provid", "owed": "ow", "saying": "say", "crying": "cry", "string": "string", "meant": "meant", "cement": "cem"}.items():
        assert stemmers.lancaster(word) == stem


def test_spanish_stemmer():
    for word, stem in {"chicas": "chic", "chicharrones": "chicharron", "torear": "tor", "toros": "tor", "trabajadores": "trabaj", "rápidamente": "rapid", "comprándola": "compr"}.items():
        assert stemmers.spanish(word) == stem


def test_stems_with_one_form_add_up(spark):
    rows = spark.createDataFrame([(1, "connect", 2), (1, "connected", 3)], "doc_id long, term string, tf long")
    assert [(r.term, r.tf) for r in stemmers.stemmed(rows, "porter").collect()] == [("connect", 5)]
    assert [r.tf for r in stemmers.stemmed(rows, "porter", binary_tf=True).collect()] == [1]


def test_boolean(spark):
    rows = spark.createDataFrame([("a", d, d) for d in (1, 2, 3)] + [("b", d, 9) for d in (2, 3, 4)], "term string, doc_id long, tf long")
    docs = spark.range(1, 6).withColumnRenamed("id", "doc_id")
    for expression, want in {"a AND b": {2, 3}, "a OR b": {1, 2, 3, 4}, "a AND NOT b": {1}, "NOT a": {4, 5}, "NOT (a AND missing)": {1, 2, 3, 4, 5}}.items():
        for search in (boolean.search, boolean.search_by_sets):
            assert {r.doc_id for r in search(expression, rows, docs).collect()} == want
    assert not boolean.is_boolean("history") and boolean.is_boolean("a OR b")
    for bad in ("a AND", "(a", "a b", "AND a", ""):
        with pytest.raises(ValueError):
            boolean.parse(bad)


def test_curve_and_average_precision(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (2, 11, 2)], "qid long, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 10), (1, 12), (2, 10), (2, 99), (3, 7)], "qid long, doc_id long")
    ap = {r.qid: r.ap for r in evaluation.per_query(run, qrels).collect()}
    assert ap[1] == pytest.approx((1 + 2 / 3) / 2) and ap[3] == 0
    curve = {(r.qid, r.level): r.precision for r in evaluation.curve(run, qrels).collect()}
    assert [curve[1, k] for k in range(11)] == pytest.approx([1.0] * 6 + [2 / 3] * 5)
    assert [curve[2, k] for k in range(11)] == [1.0] * 11 and curve[3, 5] == 0
    filled = {(r.qid, r.level): r.precision for r in evaluation.curve(run, qrels, zero_fill=True).collect()}
    assert filled[2, 5] == 1.0 and filled[2, 6] == 0


def test_min_max_of_equal_values(spark):
    rows = spark.createDataFrame([("x", 2.0)] * 3, "k string, f double")
    assert [r.f for r in stats.min_max(rows, ["k"]).collect()] == [0.5] * 3


def test_heaps_fit_recovers_its_law(spark):
    curve = spark.createDataFrame([(int(n), int(7.5 * n**0.61)) for n in range(1000, 200_000, 1500)], "n_tokens long, n_unique long")
    k, beta, r2 = stats.heaps_fit(curve)
    assert k == pytest.approx(7.5, rel=0.01) and beta == pytest.approx(0.61, abs=0.001) and r2 > 0.9999


def test_urls(spark):
    get = lambda c: one(spark, c)
    assert [get(web.physical_depth(F.lit(u))) for u in ("http://a.b/", "http://a.b/x/y/", "http://a.b/x?q=/z")] == [0, 2, 1]
    base = "http://a.b/x/y?q=1"
    for href, want in {"/k": "http://a.b/k", "k": "http://a.b/x/k", "//c.d/e": "http://c.d/e", "?z": "http://a.b/x/y?z", "#f": "http://a.b/x/y?q=1#f", "https://e.f": "https://e.f"}.items():
        assert get(web.resolve(F.lit(base), F.lit(href))) == want
    for url, want in {"http://www.site.org:80/p": "site.org", "http://a.b.site.co.uk/": "site.co.uk", "https://unlu.edu.ar": "unlu.edu.ar", "http://co.uk": "co.uk", "http://x.de/": "x.de", "http://localhost/": "localhost"}.items():
        assert get(web.domain(F.lit(url))) == want


def test_fetching(spark):
    pages = {"http://a.b/": "<a href='/x'>x</a>", "http://a.b/x": "no links", "http://a.b/none": None}
    urls = spark.createDataFrame([(u,) for u in [*pages, "http://a.b/gone", "http://a.b/"]], "url string")
    found = web.fetch(urls, lambda u: pages[u], several=2)
    assert {r.url: r.error for r in found.collect()} == {"http://a.b/": None, "http://a.b/x": None, "http://a.b/none": "no text", "http://a.b/gone": "KeyError"}
    assert sorted((r.url, r.pos, r.link) for r in web.fetched_links(found).collect()) == [("http://a.b/", 0, "http://a.b/x"), ("http://a.b/x", None, None)]


def test_missing_and_broken_indexes_are_empty(spark, tmp_path):
    assert readers.json_index(spark, str(tmp_path / "none")).count() == 0
    assert [df.count() for df in readers.saved_index(spark, str(tmp_path / "none")).values()] == [0] * 4
    (tmp_path / "broken").write_text('{"term": "a", "df"\n{"other": 1}\n{"term": "b", "df": 1, "cf": 2, "postings": {"7": 2}}\n')
    assert [(r.term, r.doc_id, r.tf) for r in readers.json_index(spark, str(tmp_path / "broken")).collect()] == [("b", 7, 2)]


def test_languages_of_a_library(spark):
    from textloom.operators import profiles

    docs = spark.createDataFrame([(1, "el gato y el perro"), (2, "the cat and the dog"), (3, None)], "doc_id long, text string")
    languages = profiles.profile(spark.createDataFrame([("es", "el gato come y el perro duerme"), ("en", "the cat eats and the dog sleeps")], "lang string, text string"), "lang")
    assert {r.doc_id: r.lang for r in profiles.by_library(docs, None, languages).collect()} == {1: "es", 2: "en", 3: "unknown"}
    assert {r.doc_id: r.lang for r in profiles.by_library(docs, lambda t: {"e": "es", "t": "en"}[t[0]]).collect()} == {1: "es", 2: "en", 3: "unknown"}


@pytest.mark.parametrize("few_links", [0, 100])
def test_link_analysis_against_numpy(spark, few_links):
    """Within one task and as rounds of joins, to a coarse tolerance here: rounds cost a job or two each."""
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (0, 3)]  # 3 has no link out
    table = spark.createDataFrame(edges + edges[:1], "src long, dst long")
    p = np.full(4, 0.25)
    for _ in range(300):
        new = np.full(4, 0.15 / 4 + 0.85 * p[3] / 4)
        for s, d in edges:
            new[d] += 0.85 * p[s] / sum(a == s for a, _ in edges)
        p = new
    got = {r.id: r.score for r in web.pagerank(table, tolerance=1e-3, few_links=few_links).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(p.tolist(), abs=6e-3) and sum(got.values()) == pytest.approx(1)
    m = np.zeros((4, 4))
    m[tuple(zip(*edges, strict=True))] = 1
    values, vectors = np.linalg.eigh(m.T @ m)
    authority = np.abs(vectors[:, values.argmax()])
    got = {r.id: (r.hub, r.authority) for r in web.hits(table, tolerance=1e-3, few_links=few_links).collect()}
    assert [got[i][1] for i in range(4)] == pytest.approx((authority / authority.sum()).tolist(), abs=1e-2)
    hub = m @ authority
    assert [got[i][0] for i in range(4)] == pytest.approx((hub / hub.sum()).tolist(), abs=1e-2)
    with pytest.raises(Exception, match="did not converge"):
        web.pagerank(table, most=2, few_links=few_links).collect()


def queue_crawl(seeds, links, per_site, max_logical, max_physical, max_known, max_pages):
    """The crawl with a first-in first-out queue: url -> (id, depth, visited, outlinks)."""
    site = lambda u: ".".join(u.split("/")[2].split(".")[-2:])
    known = {u: [i, 0, False, set()] for i, u in enumerate(seeds)}
    queue, done, count = deque(seeds), {}, 0
    while queue and count < max_pages:
        url = queue.popleft()
        me = known[url]
        if done.get(site(url), 0) >= per_site or url not in links:
            continue
        done[site(url)] = done.get(site(url), 0) + 1
        count += 1
        me[2] = True
        for link in links[url]:
            if not link.startswith("http") or len([p for p in link.split("/")[3:] if p]) > max_physical:
                continue
            if link in known:
                me[3].add(known[link][0])
            elif me[1] + 1 <= max_logical and done.get(site(link), 0) < per_site and len(known) < max_known:
                known[link] = [len(known), me[1] + 1, False, set()]
                queue.append(link)
                me[3].add(known[link][0])
    return {u: (i, d, v, sorted(o)) for u, (i, d, v, o) in known.items()}


@pytest.mark.parametrize("per_site,max_known", [(20, 1000), (2, 1000), (3, 12)])
def test_crawl_against_a_queue(spark, per_site, max_known):
    rng = np.random.default_rng(per_site)
    urls = [f"http://s{i % 4}.org/p{i}" for i in range(40)]
    links = {u: [urls[j] for j in rng.integers(0, 40, 4)] + ["mailto:x", f"{u}/a/b/c/d"] for u in urls[:36]}
    rows = [(u, k, v) for u, own in links.items() for k, v in enumerate(own)]
    found = web.crawl(spark.createDataFrame([(urls[0], 0), (urls[1], 1)], "url string, place int"), spark.createDataFrame(rows, "url string, pos long, link string"), per_site=per_site, max_known=max_known)
    got = {r.url: (r.id, r.depth, r.visited, list(r.outlinks)) for r in found.collect()}
    assert got == queue_crawl(urls[:2], links, per_site, 3, 3, max_known, max_known)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text("El perro\ncome")
    (tmp_path / "t" / "a.html").write_text("<p>x</p>")
    assert [(r.doc_name, r.text) for r in readers.text_directory(spark, str(tmp_path / "t")).collect()] == [("b.txt", "El perro\ncome")]
    assert [(r.doc_name, r.text.strip()) for r in readers.html_directory(spark, str(tmp_path / "t")).collect()] == [("a", "x")]
    (tmp_path / "c.trec").write_text("<DOC>\n<DOCNO> 7 </DOCNO>\nfirst\n\nsecond\n</DOC>\n<DOC>\n<DOCNO>8</DOCNO>\n\n</DOC>\n")
    assert [(r.docno, r.text) for r in readers.trec(spark, str(tmp_path / "c.trec")).collect()] == [("7", "first\n\nsecond")]
    (tmp_path / "topics").write_text("<top><num>1</num><title>one\ntwo</title></top>\n<top><num>1</num><title>three</title></top>")
    assert [(r.qid, r.query) for r in readers.topics(spark, str(tmp_path / "topics")).collect()] == [(1, "three")]
    (tmp_path / "qrels").write_text("1 0 d1 1\n1 0\n2 0 d2\n")
    assert [(r.qid, r.docno, r.label) for r in readers.qrels(spark, str(tmp_path / "qrels")).collect()] == [(1, "d1", 1), (2, "d2", 1)]
    (tmp_path / "log").write_text("3:casa blanca\n")
    assert [(r.qid, r.query) for r in readers.query_log(spark, str(tmp_path / "log")).collect()] == [("3", "casa blanca")]
    lines = spark.createDataFrame([("a:2:3,5,",), ("",), ("b:0:,",)], "value string")
    assert [(r.term, r.doc_id) for r in readers.prebuilt_index(lines).collect()] == [("a", 3), ("a", 5)]
    docs = spark.createDataFrame([(1, "gatos negros gatos"), (2, "perros negros")], "doc_id long, text string")
    postings = ix.index(docs)
    want = sorted((r.doc_id, r.term, r.tf) for r in postings.collect())
    sinks.json_index(postings, str(tmp_path / "json"))
    assert sorted((r.doc_id, r.term, r.tf) for r in readers.json_index(spark, str(tmp_path / "json")).collect()) == want
    sinks.save_index(docs, postings, str(tmp_path / "index"))
    saved = readers.saved_index(spark, str(tmp_path / "index"))
    assert sorted((r.doc_id, r.term, r.tf) for r in saved["postings"].collect()) == want and saved["norms"].count() == 2


def test_index_from_a_stream(spark, tmp_path):
    from textloom.streaming import incremental

    source = tmp_path / "in"
    for n, rows in enumerate([[(1, "gatos negros")], [(2, "perros"), (1, "gatos blancos")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(source / f"d{n}"))
        stream = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(str(source))
        incremental.grow(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.doc_id, r.term) for r in incremental.read(spark, str(tmp_path / "out")).collect()) == [(1, "blancos"), (1, "gatos"), (2, "perros")]
