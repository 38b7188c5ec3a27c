"""Inputs on which the training-data operators once did less than the whole job."""

import hashlib

import numpy as np

from helpers import rows_of
from textloom.llm import langid, mixing, topk


def test_top_k_meets_every_pair_of_several_blocks_and_piles(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 25)
    vectors = np.random.default_rng(5).integers(-2, 3, (200, 4))
    whole = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<long>").repartition(4)
    got = rows_of(topk.top_k(whole, whole.where("vec_id % 2 = 0"), 250).collect(), ["query_id", "rank", "vec_id", "score"])
    want = []
    for q in range(0, 200, 2):
        others = sorted((-int(vectors[q] @ vectors[i]), i) for i in range(200) if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(others, 1)]
    assert got == sorted(want, key=repr)


def test_mixing_goes_on_behind_a_document_that_is_refused(spark, monkeypatch):
    key = lambda i, text: hashlib.md5(f"42:{i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
    sizes = {i: 1 + i * 7 % 60 for i in range(400)}
    sizes |= {400: 25_000, 401: 900, 402: 333}
    rows = [(i, "w " * n, "a") for i, n in sizes.items()] + [(1000 + i, "w " * 800, None) for i in range(10)] + [(2000 + i, "w " * 500, "b") for i in range(20)] + [(3000 + i, "w " * 500, "c") for i in range(30)] + [(4000, None, "b")]
    rows += [(5000, "w " * 40, "a")] * 50  # equal rows
    order = sorted((r for r in rows if r[2] == "a"), key=lambda r: key(r[0], r[1]))
    monkeypatch.setattr(mixing, "RANGE", 8)
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == len(rows)
    total = sum(len((r[1] or "").split()) for r in order)
    plan = mixing.targets(spark.createDataFrame([("a", total), ("b", 10_000), ("c", 15_000), (None, 8000)], "source string, source_size long")).collect()
    want = []
    for p in plan:
        left = p.extra
        for i, text, _ in sorted((r for r in rows if r[2] == p.source), key=lambda r: key(r[0], r[1])):
            size = len((text or "").split())
            more = int(0 < size <= 2 * left)
            left -= more * size
            want.append((i, p.source, size, p.reps + more))
    assert sorted(((r.doc_id, r.source, r["size"], r.copies) for r in got), key=repr) == sorted(want, key=repr)
    a = next(p for p in plan if p.source == "a")
    assert a.reps == 0 and abs(a.target - sum(r.taken for r in got if r.source == "a")) < 60
    assert mixing.mix_plan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_every_labelled_language_gets_a_model(spark):
    rows = [(f"only text {i} " * 3, f"l{i}") for i in range(40)] + [("1 2 3", "digits")]
    rows += [(f"long words number {i} " * 3000, "long") for i in range(10)]
    models = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample_chars=20)
    assert sorted(models.langs) == sorted({lang for _, lang in rows} - {"digits"})


def test_rows_without_words_never_come_once_more(spark):
    rows = [(i, "", "empty") for i in range(5)] + [(i, None if i % 2 else "w " * 9, "some") for i in range(10, 60)] + [(i, "w " * 500, "big") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {(r.source, r["size"] > 0): set() for r in mixing.mix_plan(docs).collect()}
    for r in mixing.mix_plan(docs).collect():
        copies[r.source, r["size"] > 0].add(r.copies)
    assert copies["empty", False] == {0} and copies["some", False] == copies["some", True] == {3}
    mixed = sorted(map(str, mixing.mix(docs).collect()))
    assert mixed == sorted(map(str, mixing.mix(docs.repartition(5)).collect())) and len(mixed) == 150 + sum(r.copies for r in mixing.mix_plan(docs.where("source = 'big'").unionByName(docs.where("source <> 'big'"))).collect() if r.source == "big")
