"""SimHash near-duplicates: bit-sliced comparison within buckets, then connected components.

1. A fingerprint for each whole text (Arrow batches, numpy).
2. Distinct fingerprints. Two within RADIUS bits agree on at least blocks - RADIUS of
   `blocks` blocks of bits; each choice of that many blocks is a table and the bits in
   them its key. `blocks` follows the number of fingerprints (more blocks: longer keys,
   more tables), and any choice is exact.
3. A bucket (table, key) with more than BLOCK rows is split into sub-blocks, and each
   pair of sub-blocks is a cell of its own, so no task holds an unbounded bucket.
4. In a task, whole buckets are packed into blocks. A block stores its fingerprints as
   64 bit planes; for a set of probes the distances to all of them grow plane by plane
   in carry-save counters, 64 lanes a word. Words all of whose lanes are past the radius
   are abandoned. Only a spanning forest of the links leaves a block, never all pairs.
5. Connected components by alternating large and small stars, each round a table in the
   shared folder. Keys with very many rows (the fingerprint of empty texts, the centre of
   a large component) are met where their rows lie and not dealt to one task.

Defined results: a null or empty text has fingerprint 0 and links like any other; a
document within reach of no other is a component of itself; component_id is the least
non-null doc_id in reach (null if there is none); repeated rows each get their row; an
empty table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.tables import table
from textloom.scratch import drop, materialize
from textloom.session import ship

RADIUS = 4
SHINGLE = 4
SEED = 42
BLOCK = 2048
#: More blocks of bits once buckets would hold more than this many fingerprints on average.
CROWD = 2048
#: A key with more than 1 / HOT of the rows, and HOT at least, is hot; hot keys are broadcast, fewer than HOT of them.
HOT = 10_000
#: Ids that keep_first() broadcasts at most: some 30 MB.
GONE = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        some = words[at : min(at + (1 << 15), n) + shingle - 1]
        joined = map(b" ".join, zip(*(some[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, fp long")


# ---- bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 planes of len(fps) bits; bits past the end are copies of nothing and masked by the caller."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-n // 64) * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Counters:
    """Carry-save counters of set bits up to `most`, with a sticky mark beyond."""

    def __init__(self, shape, most: int):
        self.most, self.bits = most, [np.zeros(shape, "<u8") for _ in range(max(1, most.bit_length()))]
        self.over = np.zeros(shape, "<u8")

    def add(self, carry: np.ndarray) -> None:
        for i, low in enumerate(self.bits):
            self.bits[i], carry = low ^ carry, low & carry
        self.over |= carry

    def add_two(self, a: np.ndarray, b: np.ndarray) -> None:
        low, half = self.bits[0], a ^ b
        self.bits[0], carry = low ^ half, (a & b) | (low & half)
        for i, x in enumerate(self.bits[1:], 1):
            self.bits[i], carry = x ^ carry, x & carry
        self.over |= carry

    def past(self) -> np.ndarray:
        """Lanes whose count is above `most`: a comparison with a constant, bit by bit from the top."""
        above, equal = self.over.copy(), ~self.over
        for i in reversed(range(len(self.bits))):
            if self.most >> i & 1:
                equal &= self.bits[i]
            else:
                above |= equal & self.bits[i]
                equal &= ~self.bits[i]
        return above

    def take(self, keep: np.ndarray) -> None:
        self.bits, self.over = [x[keep] for x in self.bits], self.over[keep]


def near(fps: np.ndarray, radius: int = RADIUS, probes: int = 256) -> np.ndarray:
    """The bit matrix (n rows, n lanes in words) of fingerprints within radius of each other."""
    n, planes = len(fps), planes_of(fps)
    words = planes.shape[1]
    lanes = np.full(words, ~np.uint64(0), "<u8")
    if n % 64:
        lanes[-1] = np.uint64((1 << n % 64) - 1)
    out = np.zeros((n, words), "<u8")
    for at in range(0, n, probes):
        mine = fps[at : at + probes].astype("<u8")
        flip = np.zeros((64, len(mine)), "<u8")
        for b in range(64):
            flip[b] = np.where(mine >> np.uint64(b) & np.uint64(1), ~np.uint64(0), np.uint64(0))
        row, word = (x.ravel() for x in np.indices((len(mine), words)))
        count = Counters(len(row), radius)
        for b in range(0, 64, 2):
            count.add_two(planes[b][word] ^ flip[b][row], planes[b + 1][word] ^ flip[b + 1][row])
            if b in (22, 30, 46):  # abandon the words without a lane in reach
                alive = (~count.past() & lanes[word]) != 0
                row, word = row[alive], word[alive]
                count.take(alive)
        out[at + row, word] = ~count.past() & lanes[word]
    return out


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct fingerprints: each that is not alone, with the first of its component in this block."""
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    matrix = near(fps, radius)
    left = np.bitwise_count(matrix).sum(axis=1) > 1
    nodes, roots = [], []
    for start in range(n):
        if not left[start]:
            continue
        seen, edge = np.zeros_like(matrix[0]), np.array([start])
        while len(edge):
            reach = np.bitwise_or.reduce(matrix[edge], axis=0) & ~seen
            seen |= reach
            edge = np.flatnonzero(np.unpackbits(reach.view(np.uint8), bitorder="little")[:n])
        members = np.flatnonzero(np.unpackbits(seen.view(np.uint8), bitorder="little")[:n])
        left[members] = False
        nodes.append(fps[members[1:]])
        roots.append(np.repeat(fps[members[:1]], len(members) - 1))
    empty = fps[:0]
    return np.concatenate(nodes or [empty]), np.concatenate(roots or [empty])


def _packed(batches):
    """Blocks of fingerprints, each of whole cells, at most BLOCK rows unless one cell is larger; cells of one row are skipped."""
    kept: list[np.ndarray] = []
    room, rest, rest_key = 0, [], None

    def cells():
        nonlocal rest, rest_key
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            fps = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                if a == b:
                    continue
                if rest and tuple(keys[a]) == rest_key:
                    rest.append(fps[a:b])
                    continue
                if rest:
                    yield rest
                rest, rest_key = [fps[a:b]], tuple(keys[a])
        if rest:
            yield rest

    for cell in cells():
        size = sum(map(len, cell))
        if size < 2:
            continue
        if room + size > BLOCK and kept:
            yield np.unique(np.concatenate(kept))
            kept, room = [], 0
        kept += cell
        room += size
    if kept:
        yield np.unique(np.concatenate(kept))


def _forests(radius: int):
    def run(batches):
        for block in _packed(batches):
            nodes, roots = forest(block.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(roots.view(np.int64))], ["u", "v"])

    return run


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The key bits of each table, as signed numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(unique: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect all within radius, perhaps repeated."""
    ship(unique.sparkSession)
    n, blocks = unique.count(), radius + 1
    while n >> min(64 * (blocks - radius) // blocks, 62) > crowd and blocks < radius + 4:
        blocks += 1
    chosen = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(blocks, radius))))
    rows = unique.select("fp", F.explode(chosen).alias("x")).select("x.t", "x.key", "fp")
    crowded = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = crowded.select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.join(crowded, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("t", "key", "fp", "parts", part.alias("part"), other.alias("other"))
    cell = F.greatest("part", "other").cast("long") * 1_000_000 + F.least("part", "other")
    dealt = dealt.select("t", "key", cell.alias("cell"), "fp").repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell")
    return dealt.mapInArrow(_forests(radius), "u long, v long")


# ---- connected components


def join_hot(rows: DataFrame, small: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with small (one row a key). The keys of hot, few by their definition, are met where their rows lie."""
    if hot is None:
        return rows.join(small, key)
    own = small.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(own), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(small, key))


def hot_keys(counts: DataFrame, key: str, rows: int) -> DataFrame | None:
    """The keys of counts (key, n) with more than rows / HOT rows, of which there are fewer than HOT; None without any."""
    hot = counts.where(F.col("n") > max(rows // HOT, HOT)).select(key)
    return None if hot.isEmpty() else materialize(hot, "hot-keys")


def components(edges: DataFrame) -> DataFrame:
    """u, v (links) -> u, root: each node that has a link, with the least node in reach; roots too."""
    star = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(star)
    while mark[0]:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both, least.drop("n"), "u", hot_keys(least, "u", 2 * mark[0])).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))  # a node has one link a block and table it stood in
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(star)
        drop(least)
        star, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    return star.select("u", F.col("v").alias("root")).union(star.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def _mark(star: DataFrame) -> tuple:
    return tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed) and component_id of each row of docs."""
    marked = materialize(fingerprints(docs, text, doc_id), "fingerprints")
    unique = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "unique")
    rows = unique.agg(F.sum("n")).first()[0] or 0
    roots = components(links(unique.select("fp"), radius))
    linked = materialize(roots.join(unique, roots["u"] == unique["fp"]).select("fp", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    least = materialize(least, "roots")
    named = join_hot(linked, least.drop("n"), "root", hot_keys(least, "root", rows)).select("fp", "component_id")
    known = unique.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return join_hot(marked, known, "fp", hot_keys(unique, "fp", rows)).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component: that of its least doc_id; rows without a doc_id all stay.

    Of several rows with that doc_id the least as a struct of the other columns stays. The
    ids that go, and those of several rows, are broadcast up to GONE of them, so that the
    texts that stay are read and not dealt out; beyond, texts and ids meet in a shuffle.
    """
    found = near_duplicates(docs.select(text, doc_id), text, doc_id, radius).where("doc_id IS NOT NULL")
    each = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n"))
    odd = materialize(each.where("NOT first OR n > 1").select(F.col("doc_id").alias("__id"), "first"), "not-kept-as-they-are")
    few = F.broadcast if odd.count() <= GONE else lambda df: df
    kept = docs.join(few(odd.select("__id")), docs[doc_id] == F.col("__id"), "left_anti")
    several = odd.where("first").select("__id")
    if several.isEmpty():
        return kept
    rest = [c for c in docs.columns if c != doc_id]
    one = docs.join(few(several), docs[doc_id] == F.col("__id"), "left_semi").groupBy(doc_id).agg(F.min(F.struct(*rest)).alias("__row"))
    return kept.unionByName(one.select(*(F.col(c) if c == doc_id else F.col("__row")[c].alias(c) for c in docs.columns)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
