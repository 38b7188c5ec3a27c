"""Queries that do the whole of what others of their kind do in part."""

import duckdb
import numpy as np

from helpers import rows_of
from textloom.plans import base, retrieval, web


def test_correlation_at_three_depths(spark, small):
    assert {r.top_k for r in retrieval.model_rank_correlation(spark, small).collect()} == {10, 25, 50}


def test_gate_takes_the_terms_of_whole_log_lines(spark, tmp_path):
    docs = [(1, "apple banana"), (2, "apple cherry"), (3, "banana cherry"), (4, "apple banana cherry damson")]
    log = [(1, 0, "user", "apple banana cherry damson"), (1, 1, "user", "the banana, the apple; with banana"), (2, 0, "user", "cherry banana apple"), (3, 0, "user", "apple unknown"), (4, 0, "assistant", "apple banana"), (5, 0, "user", "apple")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(log, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    gate = rows_of(retrieval.query_log_gate(spark, str(tmp_path)).collect(), ["turn_id", "n_terms", "terms"])
    assert gate == [(1001, 2, "apple banana"), (2000, 3, "apple banana cherry")]
    found = {}
    for r in retrieval.query_log_boolean(spark, str(tmp_path)).collect():
        found.setdefault((r.terms, r.template), set()).add(r.doc_id)
    assert found == {
        ("apple banana", "{0} AND {1}"): {1, 4}, ("apple banana", "{0} OR {1}"): {1, 2, 3, 4}, ("apple banana", "{0} AND NOT {1}"): {2},
        ("apple banana cherry", "{0} AND {1} AND {2}"): {4}, ("apple banana cherry", "({0} OR {1}) AND {2}"): {2, 3, 4}, ("apple banana cherry", "({0} AND {1}) OR {2}"): {1, 2, 3, 4},
    }
    for name in ("query_log_gate", "query_log_boolean"):
        got = base.QUERIES[name](spark, str(tmp_path))
        want = [tuple(r) for r in con.execute(f"SELECT {', '.join(got.columns)} FROM ({base.SQL[name]})").fetchall()]
        assert rows_of(got.collect(), got.columns) == sorted(want, key=repr)


def _dense(spark, small):
    """Node ids and the matrix of links, src to dst."""
    edges = [(r.src, r.dst) for r in web.graph(spark, small).select("src", "dst").distinct().collect()]
    ids = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for s, d in edges:
        m[place[s], place[d]] = 1
    return ids, m


def _limits(m):
    """PageRank as the solution of its equations; hub and authority after many rounds."""
    n, out = len(m), m.sum(axis=1, keepdims=True)
    step = np.where(out > 0, m / np.maximum(out, 1), 1 / n)
    rank = np.linalg.solve(np.eye(n) - 0.85 * step.T, np.full(n, 0.15 / n))
    hub = np.full(n, 1 / n)
    for _ in range(3000):
        authority = m.T @ hub
        authority /= authority.sum()
        hub = m @ authority
        hub /= hub.sum()
    return rank, hub, authority


def test_link_analysis_converges(spark, small):
    ids, m = _dense(spark, small)
    rank, hub, authority = _limits(m)
    found = {r.id: r.score for r in web._pagerank(spark, small).collect()}
    assert np.abs(np.array([found[i] for i in ids]) - rank).sum() < 1e-8
    found = {r.id: (r.hub, r.authority) for r in web._hits(spark, small).collect()}
    assert np.abs(np.array([found[i] for i in ids]) - np.array([hub, authority]).T).sum() < 1e-6
    assert web.web.pagerank(web.graph(spark, small).limit(0)).count() == 0 == web.web.hits(web.graph(spark, small).limit(0)).count()


def test_overlap_of_pagerank_and_authority(spark, small):
    ids, m = _dense(spark, small)
    rank, _, authority = _limits(m)
    orders = [[x for _, x in sorted(zip(-np.round(s, 9), ids, strict=True))] for s in (rank, authority)]
    assert [r.id for r in web.hits_order(spark, small).orderBy("rank").collect()] == orders[1]
    ks = range(10, min(501, len(ids)), 10)
    want = [(k, len(set(orders[0][:k]) & set(orders[1][:k])) / k) for k in ks]
    assert sorted(tuple(r) for r in web.rank_overlap_at_k(spark, small).select("k", "overlap").collect()) == want


def test_passages_of_every_length_are_found(spark):
    texts = {1: "one two three four five six seven eight nine ten eleven", 2: "xone two threes", 3: "a word", 4: "", 5: None, 6: "line\nends two  blanks here and there is more of it"}
    passages = {1: "two three four", 2: "word", 3: "ne two th", 4: "one two three four five six seven eight nine ten", 5: "ends two  blanks here and there is more o", 6: "absent words of some length", 7: "ven", 8: None, 9: " two three"}
    found = base.containing(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(passages.items()), "qid long, passage string"))
    want = {(q, d) for q, p in passages.items() for d, t in texts.items() if p is not None and t is not None and p in t}
    assert {tuple(r) for r in found.select("qid", "doc_id").collect()} == want
