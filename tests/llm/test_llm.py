"""The training-data operators against brute force, their SQL, and odd input."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from brute_pii import base, digest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import rows_of
from textloom.llm import bpe, chat, langid, mixing, pii, quality, registry, sharding, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, ids string, taken string"


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang").collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty, very long and repeated texts, ties, and columns named like results."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "one two three four five"), (None, None), (7, "\n \t"), (8, "mail a@b.co now 😀"), (9, "mail a@b.co now 😀")]
    return spark.createDataFrame([(i, t, None if i == 7 else "en", None if i == 8 else "s", None, 0.5, True, 3, "x", None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_its_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


# ---- 1


def noisy(seed, n=240):
    rng = random.Random(seed)
    plain = [f"lorem{i}" for i in range(150)]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic = int(i % 3 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "vilewords", "foulmouth"])
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_learns_rare_words(spark):
    rows = noisy(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    network = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    unseen = noisy(2)
    found = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(unseen, "doc_id long, text string, toxic int"), network).collect()}
    right = np.mean([(found[i] >= 0.7) == bool(t) for i, _, t in unseen])
    assert right > 0.95 and all(0 <= s <= 1 for s in found.values())


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    network = toxicity.Network(["a"], np.zeros(1, np.float32))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, mask = rng.standard_normal((3, 5, toxicity.WORD + 2 * toxicity.CHARS)), np.ones((3, 5))
    mask[1, 3:] = 0
    y, weight = np.array([1.0, 0, 1]), np.ones(3)
    _, g, _ = network.gradients(x, mask, y, weight)
    for name in ("uf", "wb", "attend", "attend_v", "out"):
        at = tuple(0 for _ in network.p[name].shape)
        network.p[name][at] += 1e-3
        up = network.gradients(x, mask, y, weight)[0]
        network.p[name][at] -= 2e-3
        down = network.gradients(x, mask, y, weight)[0]
        network.p[name][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4)


def brute_logit(network, words):
    """The logit of one window, word by word and number by number."""
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    size = toxicity.HIDDEN
    xs = []
    for w in map(toxicity.normal, words):
        marked = f"^{w}$"
        hashed = lambda g: int(toxicity.hashes(toxicity.code_points(g), len(g))[-1] % toxicity.BUCKETS)
        beginnings = [marked[:n] for n in toxicity.BEGINNINGS if len(marked) >= n]
        inner = [marked[i : i + n] for n in toxicity.INNER for i in range(len(marked) - n + 1)]
        means = [np.mean([p["char"][hashed(g)] for g in [*grams, marked[-2:]]], axis=0) for grams in (beginnings, inner)]
        xs.append(np.concatenate([p["word"][network.words.get(w, 0)], *means]))
    states = {}
    for way, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
        h = np.zeros(size)
        for i in order:
            x = xs[i] @ p[f"w{way}"] + p[f"b{way}"]
            z = 1 / (1 + np.exp(-(x[:size] + h @ p[f"u{way}"][:, :size])))
            r = 1 / (1 + np.exp(-(x[size : 2 * size] + h @ p[f"u{way}"][:, size : 2 * size])))
            c = np.tanh(x[2 * size :] + (r * h) @ p[f"u{way}"][:, 2 * size :])
            h = (1 - z) * h + z * c
            states[way, i] = h
    both = [np.concatenate([states["f", i], states["b", i]]) for i in range(len(xs))]
    weights = np.exp([np.tanh(s @ p["attend"] + p["attend_b"]) @ p["attend_v"] for s in both])
    return sum(w * s for w, s in zip(weights / weights.sum(), both, strict=True)) @ p["out"] + p["out_b"][0]


def test_toxicity_scores_against_brute_force(spark):
    rows = noisy(4, 150)
    network = toxicity.train([t for _, t, _ in rows], [k for *_, k in rows], rounds=1)
    texts = [t for _, t, _ in noisy(5, 12)] + [" ".join(f"w{i}" for i in range(n)) for n in (1, 31, 32, 33, 48, 49, 200)] + ["Vileword, (vilewords) ünïcode! \u6f22\u5b57"]
    found = {r.i: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), network).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if len(words) > toxicity.WINDOW else [0]
        logits = [brute_logit(network, words[s : s + toxicity.WINDOW]) for s in starts]
        assert found[i].windows == len(logits)
        assert found[i].score == pytest.approx(1 / (1 + np.exp(-(network.scale * max(logits) + network.shift))), abs=1e-4)


def test_toxicity_query_uses_no_label_that_is_held_out(spark, small, tmp_path):
    query = registry.QUERIES["op1_toxicity"]
    first = {r.doc_id: (r.held_out, r.score, r.predicted) for r in query(spark, small).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= s <= 1 and p == int(s >= 0.7) for i, (h, s, p) in first.items())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{small}/labels.parquet").withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    again = {r.doc_id: (r.held_out, r.score, r.predicted) for r in query(spark, str(tmp_path)).collect()}
    assert {i: (h, round(s, 5)) for i, (h, s, _) in again.items()} == {i: (h, round(s, 5)) for i, (h, s, _) in first.items()}


def test_toxicity_of_odd_input(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, None)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels) is None  # one kind only: the null text teaches nothing
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    rows = spark.createDataFrame(noisy(3, 60), "doc_id long, text string, toxic int")
    network = toxicity.fit(rows, rows, train_chars=5_000)
    assert toxicity.score(odd, network).count() == 9 and toxicity.score(nothing, network).count() == 0
    assert toxicity.fit(rows.limit(0), rows) is None


# ---- 2


def test_mixing_clamps_and_reshares(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a"] * 60 + ["b"] * 2 + [None] * 38)], "doc_id long, text string, source string")
    rows = mixing.mix_plan(docs).collect()
    target = {r.source: r.target for r in rows}
    assert target["b"] == 60 and target["a"] == pytest.approx(940 / 4) and target[None] == pytest.approx(940 * 3 / 4)
    for source in ("a", "b", None):
        assert abs(sum(r.taken for r in rows if r.source == source) - target[source]) <= 10
    assert all(r.taken <= 3 * r["size"] for r in rows)


def test_mixing_of_odd_input(odd, nothing):
    assert mixing.mix_plan(odd).count() == 9 and mixing.mix_plan(nothing).count() == 0
    plan, mixed = mixing.mix_plan(odd).agg(F.sum("copies")).first()[0], mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == plan


# ---- 3


def brute_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = raw.split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows):
    """rows (doc_id, fingerprint) -> least doc_id in reach of each row."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[i + 1 :]:
            if (f ^ g).bit_count() <= 4:
                root[find(g)] = find(f)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in rows]


def test_simhash_against_brute_force(spark, small, documents):
    want = [(d.doc_id, brute_fingerprint(d.text)) for d in documents]
    component = brute_components(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op3_simhash"](spark, small).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(want, component, strict=True)}


@pytest.mark.parametrize("crowd", [2048, 1])
def test_links_of_random_fingerprints(spark, crowd, monkeypatch):
    """Chains at every distance up to the radius, buckets above a block's size, more tables when crowded."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(crowd)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    unique = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.u: r.root for r in simhash.components(simhash.links(unique, crowd=crowd)).collect()}
    want = brute_components(list(enumerate(fps)))
    groups = lambda names: sorted(sorted(i for i in range(len(fps)) if names[i] == n) for n in set(names))
    assert groups([roots.get(s, s) for s in signed]) == groups(want)


def test_simhash_of_odd_input(odd, nothing):
    rows = [(r.doc_id, r.fp) for r in simhash.near_duplicates(odd).collect()]
    assert len(rows) == 9 and simhash.near_duplicates(nothing).count() == 0
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect() if r.doc_id}
    assert component[1] == component[2] == component[7] == 1 and component[8] == component[9] == 8
    assert [r.doc_id for r in simhash.keep_first(odd).orderBy("doc_id").collect()] == [None, None, 1, 3, 8]


# ---- 4


def test_pii_against_brute_force(spark, small, documents):
    got = {r.doc_id: r for r in registry.QUERIES["op4_pii"](spark, small).collect()}
    for d in documents:
        spans = base(d.text)
        assert got[d.doc_id].base_sha256 == digest(spans)
        assert [got[d.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_pii_of_random_texts(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "x.y@c-d.e.f", "1.2.3.4", "256.1.1.1", "001.0255.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 1234567", "+1", ".", " ", "-", "@", "9", "12", "é", "😀", "\n", "(", "+"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    texts += ["9" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+" + "1 " * 20_000, "@" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in pii.BASE] == base(r.text), r.text[:200]


def test_pii_kinds_of_the_method_and_redaction(spark, odd, nothing):
    text = "iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789; é DE89 3704 0044 0532 0130 01. a@b.co 000-12-3456"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spans = {(s.kind, text[s.start : s.end]) for s in pii.find_pii(docs).first().pii_spans}
    assert spans == {("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("email", "a@b.co")}
    many = " ".join(f"u{i}@m{i % 7}.example é 10.0.{i % 256}.1 +49 30 {1000000 + i}" for i in range(3000))
    row = pii.find_pii(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.end) for s in row.pii_spans if s.kind in pii.BASE] == base(many) and len(row.pii_spans) > 8000
    assert pii.redact(spark.createDataFrame([(1, many)], "doc_id long, text string")).first().text.count("é [IP]") == 3000
    clean = [r.text for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert clean == ["iban [IBAN], ssn [SSN]; é DE89 3704 0044 0532 0130 01. [EMAIL] 000-12-3456", None]
    assert pii.redact(odd).columns == odd.columns and pii.find_pii(odd).count() == 9 and pii.redact(nothing).count() == 0


# ---- 5


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library(spark, small, documents, library):
    got = {r.doc_id: r for r in registry.QUERIES["op5_byte_bpe"](spark, small).collect()}
    for d in documents:
        ids = library.encode_ordinary(d.text)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_bpe_of_random_texts(library):
    rng, codec = random.Random(3), bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    alphabet = "abc ABC 0123 \n\t  éñß漢字😀\u200d\x00'sll<|endoftext|>.,;" + chr(0x10FFFF)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)] + ["", "a" * 5000, " " * 999, "<|endoftext|>"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode_bytes(ids) == text.encode() and "".join(codec.decode_text(ids)) == text
        spans = np.frombuffer(codec.offsets(text, ids), "<u4").reshape(-1, 2).tolist()
        assert all(a < b <= len(text) for a, b in spans) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(text)))
    assert codec.decode_text(codec.encode(["😀"])[0][:4]) == ["", "\ufffd"]


def test_bpe_of_odd_input(odd, nothing):
    rows = bpe.encode(odd, decoded=True, offsets=True).collect()
    assert len(rows) == 9 and {len(r.ids) for r in rows if r.doc_id in (1, 2)} == {0}
    assert bpe.decode(bpe.encode(odd)).count() == 9 and bpe.encode(nothing).count() == 0


# ---- 6


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    rows = [(1, 0, "user", [("text", "see <|turn|> & [x]", None, None), ("image", None, "u://1", None), ("audio", None, "u://2", 7)]), (1, 1, "assistant", [("text", "é\n<|end|>", None, None)]), (1, 2, "user", None)]
    chats = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"))
    row = chats.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in row.turns] == [("user", "see <|turn|> & [x]<|image_1|><|audio_2|>"), ("assistant", "é\n<|end|>"), ("user", "")]
    assert row.loss == "é\n<|end|>" and row.expanded_tokens == 263 and [(a.type, a.ref, a.place) for a in row.attachments] == [("image", "u://1", 1), ("audio", "u://2", 2)]
    assert row.formatted.count(chat.TURN) == 3
    rows = [(1, 0, "user", [("video", None, "u://3", 9), (None, "x", None, None), ("text", "y", None, None)])]
    row = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert "<|part_1|><|part_2|>y" in row.formatted and row.expanded_tokens == 9 and [(a.type, a.ref) for a in row.attachments] == [("video", "u://3"), (None, None)]


def test_chat_of_odd_input(spark):
    rows = [(None, None, None, None), (5, 1, "a\nb&#10;", "x" * 300_000), (5, 1, "a\nb&#10;", "x" * 300_000), (5, None, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.coalesce("text", F.lit(""))))
    got = {r.conv_id: [(t.role, len(t.text)) for t in r.turns] for r in chat.format_chats(turns).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {None: [("", 0)], 5: [("assistant", 0), ("a\nb&#10;", 300_000), ("a\nb&#10;", 300_000)]}
    assert chat.format_chats(turns.limit(0)).count() == 0
    clash = turns.where("conv_id IS NULL").union(turns.where("conv_id IS NULL")).select("*", *(F.lit(1).alias(c) for c in ("own", "body", "head", "h", "b", "start", "formatted", "n_turns")))
    assert [(r.conv_id, r.n_turns) for r in chat.format_chats(clash).collect()] == [(None, 1)] * 2


# ---- 7


def test_sharding_laws(spark, small, documents):
    query = registry.QUERIES["op7_sharding"]
    rows = {r.doc_id: r for r in query(spark, small).collect()}
    assert len(rows) == len(documents) and {r.doc_id: r for r in query(spark, small).collect()} == rows
    for d in documents:
        raw = (d.text or "").encode()
        assert (rows[d.doc_id]["size"], rows[d.doc_id].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    slots = {}
    for r in rows.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_of_odd_input(spark, odd, nothing, tmp_path):
    rows = sharding.shuffle_into_shards(odd, shards=2, bucket_rows=2).collect()
    assert sorted(r.slot for r in rows if r.shard == 0) == [0, 1, 2, 3, 4] and len(rows) == 9
    assert sharding.shuffle_into_shards(nothing).count() == 0
    many = spark.range(3000).select((F.col("id") % 3).alias("id"))
    assert sharding.shuffle_into_shards(many, bucket_rows=100).groupBy("shard").count().where("count <> 125").count() == 0
    sharding.write_shards(spark.range(50), str(tmp_path / "s"), shards=5)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().where("count <> 10").count() == 0


def test_sharding_of_columns_with_the_names_of_results(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, i, i, i) for i in range(20)], "count long, shard long, slot long, n long, record long")
    found = sharding.shuffle_into_shards(rows, shards=3).collect()
    assert sorted(r.record["count"] for r in found) == list(range(20)) and sorted(r.slot for r in found if r.shard == 0) == list(range(7))
    sharding.write_shards(rows, str(tmp_path / "c"), shards=3)
    assert sorted(r.record.slot for r in spark.read.parquet(str(tmp_path / "c")).collect()) == list(range(20))


def test_sharding_does_not_depend_on_partitions(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")).drop("id")
    found = []
    try:
        for n, coalesce in ((3, "false"), (8, "false"), (5, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", coalesce)
            found.append(sorted((r.record.text, r.shard, r.slot) for r in sharding.shuffle_into_shards(rows.repartition(n), shards=5, bucket_rows=300).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] == found[1] == found[2]
    assert [(s, k) for _, s, k in found[0]] != sorted((s, k) for _, s, k in found[0])


def test_sharding_places_by_hash_and_shuffle(spark):
    """Every bucket is the rows of its hash, laid on the places behind the buckets before it."""
    import textloom.llm.sharding as own

    rows = spark.range(500).select(F.col("id").cast("string").alias("text"))
    place = {r.record.text: r.slot * 4 + r.shard for r in own.shuffle_into_shards(rows, shards=4, bucket_rows=64).collect()}
    buckets = -(-500 // 64)
    bucket = F.pmod(F.xxhash64(F.xxhash64(F.lit(42), "text"), F.xxhash64(F.lit(43), "text"), F.lit(0).cast("long"), F.lit(44)), F.lit(buckets))
    piles = {}
    for r in rows.select("text", bucket.alias("b"), F.xxhash64(F.lit(42), "text").alias("h")).orderBy("h").collect():
        piles.setdefault(r.b, []).append(r.text)
    start = 0
    for b in sorted(piles):
        got = [place[t] for t in piles[b]]
        assert sorted(got) == list(range(start, start + len(got))) and got != sorted(got)
        start += len(got)


# ---- 8


def test_language_models(spark, small, documents, odd, nothing):
    rows = registry.QUERIES["op8_language_id"](spark, small).collect()
    lang = {d.doc_id: d.lang for d in documents}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.95
    models = langid.fit(spark.createDataFrame([("the cat sat on that mat", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)], "text string, lang string"))
    found = {r.doc_id: r.lang_pred for r in langid.identify(odd, models).collect() if r.doc_id}
    assert found[1] == found[2] == found[7] == "und" and found[3] in ("de", "en") and langid.identify(nothing, models).count() == 0
    assert langid.fit(nothing) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def plain_kneser_ney(texts):
    """text list -> function of a word: its log probability, by the published recursion over dictionaries."""
    raw = {}
    for gram in (g for t in texts for g in langid.grams(t)):
        raw.setdefault(len(gram), {}).setdefault(gram, 0)
        raw[len(gram)][gram] += 1
    counts = {langid.ORDER: dict(raw.get(langid.ORDER, {}))}
    for n in range(langid.ORDER - 1, 0, -1):
        counts[n] = dict(raw.get(n, {}))  # grams at a word's start, which nothing precedes
        before = {}
        for gram in counts[n + 1]:
            if not gram[1:].startswith(langid.START):
                before.setdefault(gram[1:], set()).add(gram[0])
        for gram, kinds in before.items():
            counts[n][gram] = counts[n].get(gram, 0) + len(kinds)

    def probability(gram, floor):
        n = len(gram)
        if n == 0:
            return floor
        lower = probability(gram[1:], floor)
        own = counts[n]
        ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = {g: c for g, c in own.items() if g[:-1] == gram[:-1]}
        if not same:
            return lower
        return max(own.get(gram, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * lower

    def word(w, floor):
        marked = langid.START + w + langid.END
        return sum(np.log(max(probability(marked[max(0, i - langid.ORDER + 1) : i + 1], floor), 1e-12)) for i in range(1, len(marked)))

    return word


def test_language_models_against_plain_kneser_ney():
    texts = {"en": ["the cat sat on that mat", "then the hat"], "de": ["der hund und die katze", "dann der hut und das haus"]}
    counts = {lang: {} for lang in texts}
    for lang, own in texts.items():
        for gram in (g for t in own for g in langid.grams(t)):
            counts[lang][gram] = counts[lang].get(gram, 0) + 1
    models = langid.Models(counts)
    words = ["the", "hund", "mat", "xyz", "a", "dasselbe", "hat"]
    got = models.word_scores(words)
    for column, lang in enumerate(models.langs):
        plain = plain_kneser_ney(texts[lang])
        assert got[:, column] == pytest.approx([plain(w, models.floor) for w in words])


def test_language_ties_go_to_the_first_name(spark):
    models = langid.fit(spark.createDataFrame([("same words here", "b"), ("same words here", "a")], "text string, lang string"))
    row = langid.identify(spark.createDataFrame([("same words",)], "text string"), models).first()
    assert row.lang_pred == "a" and row.score == pytest.approx(0.5)


def test_language_probabilities_sum_to_one():
    counts = {"a": {}, "b": {}}
    for lang, text in (("a", "abab abba baab abc"), ("b", "ccac cab")):
        for gram in langid.grams(text):
            counts[lang][gram] = counts[lang].get(gram, 0) + 1
    models = langid.Models(counts)
    ends = ["a", "b", "c", langid.END]
    for before in ("", "a", "ab", "b"):
        total = 0
        for c in ends:
            word = langid.START + before + c
            value = np.full(2, models.floor)
            for n in range(1, langid.ORDER + 1):
                if len(word) - 1 >= max(1, n - 1):
                    gram = word[-n:]
                    context = np.array([langid._hash(gram[:-1]) if n > 1 else 0], dtype=np.uint64)
                    value = models._rows(models.terms[n], np.array([langid._hash(gram)], dtype=np.uint64))[0] + models._rows(models.weights[n], context)[0] * value
            total = total + value
        assert np.all(total <= 1 + 1e-9) and np.all(total > 0.7)


# ---- 9


def test_quality_of_odd_input(spark, odd, nothing):
    rows = quality.annotate(odd).collect()
    assert len(rows) == 9 and {r.kept for r in rows if r.doc_id in (1, 2, 7, 8)} == {False}
    assert {(r.n_words, r.n_repeat_words) for r in rows if r.doc_id == 3} == {(60_000, 0)}
    assert quality.keep_good(odd).columns == odd.columns and quality.annotate(nothing).count() == 0
    prose = "The quick brown fox jumps over the lazy dog and then it runs to the river where another animal waits quietly for rain. " * 1
    repeated = spark.createDataFrame([(1, prose), (2, prose * 3)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.annotate(repeated).collect()} == {1: True, 2: False}


# ---- 10


def brute_top_k(rows, k, asked):
    """rows (vec_id, whole-number vector); asked: which rows are queries."""
    out = []
    for i, (query, q) in enumerate(rows):
        if asked(query):
            scores = [(min(max(sum(a * b for a, b in zip(q, v, strict=False)), topk.LONG[0]), topk.LONG[1]), -c) for j, (c, v) in enumerate(rows) if i != j]
            out += [(query, rank, -c, s) for rank, (s, c) in enumerate(sorted(scores, reverse=True)[:k], 1)]
    return sorted(out, key=repr)


def test_top_k_ties_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (60, 5)) / 16
    vectors[::4, 1:] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(60, None), (61, [1.0, None]), (62, [float("nan")]), (None, [1.0]), (64, [float("inf")])]
    # empty and short vectors, ids that share or repeat a vector, queries among them
    rows += [(80, []), (63, []), (20, vectors[3].tolist()), (20, vectors[3].tolist()), (7, vectors[7].tolist()), (7, vectors[7].tolist()), (100, [3.0])]
    whole = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = rows_of(topk.top_k(whole, whole.where("vec_id % 20 = 0"), 6).collect(), ["query_id", "rank", "vec_id", "score"])
    taken = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert got == brute_top_k(taken, 6, lambda i: i % 20 == 0)
    assert topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_top_k_of_numbers_beyond_a_long(spark):
    rows = [(0, [10**17, 3]), (1, [10**17, 5]), (2, [-(10**17), 7]), (3, [1, 1]), (4, [2**62, -(2**63)])]
    whole = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert rows_of(topk.top_k(whole, whole, 3).collect(), ["query_id", "rank", "vec_id", "score"]) == brute_top_k(rows, 3, lambda i: True)


# ---- pipeline


def test_pipeline_against_brute_force(spark, small, duck, documents, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, small)
    good = {r[0] for r in duck.execute(f"WITH {quality.metrics_sql('documents')} SELECT doc_id FROM judged WHERE kept").fetchall()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == columns
    unique = corpus_pipeline.near_duplicates_stage(spark, kept, small)
    left = [d for d in documents if d.doc_id in good]
    component = brute_components([(d.doc_id, brute_fingerprint(d.text)) for d in left])
    firsts = {d.doc_id: d for d, c in zip(left, component, strict=True) if d.doc_id == c}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(firsts)
    clean = corpus_pipeline.personal_data_stage(spark, unique, small)
    for r in clean.collect():
        found = base(firsts[r.doc_id].text)
        assert not base(r.text) and r.n_chars == len(r.text) and (r.text == firsts[r.doc_id].text or found)
    mixed = corpus_pipeline.mixture_stage(spark, clean, small)
    assert mixed.columns == columns
    table = clean.toPandas()  # noqa: F841  DuckDB reads it by name
    duck.register("clean", table)
    copies = dict(duck.execute(f"WITH RECURSIVE {mixing.mix_sql('clean')} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall())
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    texts = dict(zip(table.doc_id, table.text, strict=True))
    for r in corpus_pipeline.tokens_stage(spark, mixed, small).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])
    assert corpus_pipeline.run(spark, small).count() == sum(copies.values())


def test_pipeline_of_odd_input(spark, odd, nothing, library, tmp_path):
    """Nulls, empty texts and white space go by the rules; of equal rows and of copies one stays; a null doc_id stays; a null source is mixed."""
    long = " ".join(f"the word{i} of" for i in range(20_000))
    prose = [f"We {w} the old road to the north and saw that no one was at home, so we sat by the river and waited for the {w} rain to end." for w in ("took", "missed")]
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, long, "en", "s"), (3, long, "en", "s"), (None, prose[0], None, "s"), (None, None, "en", None), (7, "\n \t", "en", "s"), (8, prose[1] + " a@b.co", "en", None), (9, prose[1] + " a@b.co", "en", "s")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, None) for r in rows], columns).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    count = {i: sum(r.doc_id == i for r in got) for i in (3, 8, None)}
    assert (count[3], count[8]) == (1, 3) and count[None] <= 1 and len(got) == sum(count.values())
    for i, text in ((3, long), (8, prose[1] + " [EMAIL]")):
        row = next(r for r in got if r.doc_id == i)
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
