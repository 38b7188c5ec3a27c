"""What was dealt out row by row and is now worked out where the rows lie: the same results, and plans without those exchanges."""

import re

import duckdb
import pytest

from helpers import rows_of
from textloom.functions import text
from textloom.operators import index as ix
from textloom.operators import profiles, ranking
from textloom.plans import base, corpus, files, retrieval  # noqa: F401  files registers its queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def odd(spark, tmp_path):
    """Documents with null and empty texts, a null language and one id twice."""
    rows = [(1, "el gato come\ny el perro", "es"), (2, "the cat 😀 eats the cat the", "en"), (3, "", "en"), (4, None, "es"), (5, " ", None), (6, "x", "en"), (2, "the perro gato", "es"), (7, "perro " * 90, "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(rows[:6] + rows[7:8], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "unique" / "documents.parquet"))
    return str(tmp_path)


def agrees(spark, folder, *names):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    for name in names:
        got = base.QUERIES[name](spark, folder)
        want = [tuple(r) for r in con.execute(f"SELECT {', '.join(got.columns)} FROM ({base.SQL[name]})").fetchall()]
        assert rows_of(got.collect(), got.columns) == rows_of([dict(zip(got.columns, r)) for r in want], got.columns), name


def test_items_are_counted_within_the_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), (["z"],), ([],), (None,)], "w array<string>")
    found = [None if r.c is None else [tuple(x) for x in r.c] for r in rows.select(text.counted(rows["w"]).alias("c")).collect()]
    assert found == [[("a", 2), ("b", 3), ("c", 1)], [("z", 1)], None, None]


def test_languages_are_found_within_the_rows(spark, odd):
    for folder in (odd, f"{odd}/unique"):
        agrees(spark, folder, "langid", "langid_confusion", "bigram_profile", "char_profile")
    counts, languages = corpus._grams(spark, f"{odd}/unique"), corpus._languages(spark, f"{odd}/unique")
    found = profiles.row_correlations(counts, languages)
    assert "hashpartitioning(gram" not in plan(found) and "Window" not in plan(found)
    slow = profiles.correlations(profiles.profile_of(counts, "doc_id"), languages)
    assert rows_of(found.collect(), ["doc_id", "lang", "r"]) == rows_of(slow.collect(), ["doc_id", "lang", "r"])


INDEXED = ("postings_intersect", "bool_and3_sets", "bool_nested_sets", "skip_list_entries", "file_json_index", "doc_norms", "decompressed_index", "compressed_index")


def test_index_is_counted_within_the_rows(spark, odd):
    for folder in (odd, f"{odd}/unique"):
        agrees(spark, folder, "codec_roundtrip", *INDEXED)
    rows = ix.row_index(base.docs(spark, f"{odd}/unique"))
    assert "Exchange" not in plan(rows)
    assert {(r.doc_id, r.term, r.tf, r.dl) for r in rows.collect() if r.doc_id == 1} == {(1, "gato", 1, 3), (1, "come", 1, 3), (1, "perro", 1, 3)}


def _topics(spark, odd):
    items = [(1, "the gato come perro"), (2, "cat eats perro perro"), (3, "absent"), (4, None)]
    for folder in (odd, f"{odd}/unique"):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_matches_are_met_where_postings_lie(spark, odd):
    _topics(spark, odd)
    one = f"{odd}/unique"
    found = ranking.matched(base._postings(spark, one), base.asked(spark, one), base.docs(spark, one), base.vocabulary(spark, one))
    assert "SortMergeJoin" not in plan(found) and "hashpartitioning(term" not in plan(found)
    slow = ranking.matched(base.index(spark, one), base.asked(spark, one), base.docs(spark, one))
    columns = ["qid", "doc_id", "term", "tf", "qtf", "df", "cf", "dl", "n_docs", "c", "avdl"]
    assert rows_of(found.collect(), columns) == rows_of(slow.collect(), columns)


def test_systems_are_scored_in_one_pass(spark, odd):
    _topics(spark, odd)
    got = retrieval.runs(spark, odd).collect()
    want = [(n, r.qid, r.doc_id, r.score, r.rank) for n in retrieval.SYSTEMS for r in ranking.top(retrieval.run_of(n, spark, odd), retrieval.DEPTH).collect()]
    assert rows_of(got, ["system", "qid", "doc_id", "score", "rank"]) == sorted(want, key=repr) and want
    assert len(re.findall(r"Exchange hashpartitioning\(qid#\d+L?, doc_id", plan(retrieval.scored(spark, odd, retrieval.SYSTEMS)))) == 1


def test_pairs_of_lines_and_documents_are_not_dealt_out(spark, odd, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 1)
    log = [(1, 0, "user", "gato perro"), (1, 1, "user", "come gato perro"), (2, 0, "user", "gato absent"), (3, 0, "user", "eats perro")]
    spark.createDataFrame(log, "conv_id long, turn long, role string, text string").write.parquet(f"{odd}/conversations.parquet")
    found = retrieval.query_log_boolean(spark, odd)
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, 24\)", plan(found))  # 3 lines, 8 documents
    assert "hashpartitioning(n_terms" not in plan(found) and "SortMergeJoin" not in plan(found)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    want = [tuple(r) for r in con.execute(f"SELECT {', '.join(found.columns)} FROM ({base.SQL['query_log_boolean']})").fetchall()]
    assert rows_of(found.collect(), found.columns) == sorted(want, key=repr) and want


def test_codes_stay_while_their_bits_are_counted(spark, odd):
    agrees(spark, odd, "compressed_vocabulary")
    vocabulary, codes = ix.store_compressed(base.index(spark, odd))
    assert rows_of(ix.decompress(vocabulary.join(codes, ["docs_at", "freqs_at"])).select("term", "doc_id", "tf").collect(), ["term", "doc_id", "tf"]) == rows_of(base.index(spark, odd).collect(), ["term", "doc_id", "tf"])
    for path in vocabulary.inputFiles():  # no file of the ordered scan holds codes
        if "/scan-" in path:
            assert "docs" not in spark.read.parquet(path).columns
