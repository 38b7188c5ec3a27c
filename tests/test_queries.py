import pytest

from textloom.plans import base, corpus, files, retrieval, web  # noqa: F401


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_agrees_with_its_sql(name, same):
    same(base.QUERIES[name], base.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
