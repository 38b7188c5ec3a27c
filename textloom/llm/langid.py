"""Language identification by interpolated Kneser-Ney character models.

Each word of letters, lower-cased and with a mark at either end, is a sequence of
characters; a language's model gives each character's probability after up to three
others. Counts come from a bounded sample of labelled rows (SAMPLE_CHARS characters a
language, chosen by a seeded hash of the text). The models of all languages share sorted
arrays of gram hashes, one array an order, with a column a language: one binary search
finds the terms of all of them. A text's score for a language is the sum over its
words divided by its characters; lowest cross-entropy wins, ties to the first name.

Calibration on a tenth of the sample kept out of the counts: the sharpness with which
cross-entropies become a probability (least log loss), and the cross-entropy above
which a text is called unlike its language (`accepted` is then false). The query's
lang_pred is the best language all the same, since it must be a learned one.

Defined results: a text that is null or without a letter is `und` with score 0; rows
with null text or lang teach nothing; without any labelled row all texts are `und`;
repeated rows count again; an empty table gives an empty table; only the named
columns are read. Texts are scored whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.hashing import code_points, hashes
from textloom.llm.tables import table
from textloom.session import ship

ORDER = 4
SAMPLE_CHARS = 2_000_000
CALIBRATION_ROWS = 400  # a language, in expectation
SEED = 42
START, END = "\x02", "\x03"
REMEMBER = 300_000
UNKNOWN = "und"
_words = regex.compile(r"\p{L}+").findall


def grams(text: str) -> list[str]:
    """Each character of the text's words with up to ORDER - 1 before it."""
    out = []
    for word in _words(text.lower()):
        marked = START + word + END
        out += [marked[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(marked))]
    return out


def _hash(gram: str) -> int:
    return int(hashes(code_points(gram), len(gram))[-1])


class Models:
    """All languages' models: for each order, sorted hashes of grams (terms) and of contexts (weights)."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        terms = [{} for _ in range(ORDER + 1)]
        weights = [{} for _ in range(ORDER + 1)]
        alphabet = {g[-1] for c in counts.values() for g in c} | {"\x00"}
        for column, lang in enumerate(self.langs):
            levels: list[Counter] = [Counter() for _ in range(ORDER + 1)]
            for gram, n in counts[lang].items():
                levels[len(gram)][gram] += n
            for n in range(ORDER, 1, -1):  # continuation counts: kinds of characters before; grams at a word's start have none and keep their counts
                for gram in levels[n]:
                    if not (len(gram) > 1 and gram[1:].startswith(START)):
                        levels[n - 1][gram[1:]] += 1
            for n in range(1, ORDER + 1):
                values = Counter(levels[n].values())
                discount = values[1] / (values[1] + 2 * values[2]) if values[1] and values[2] else 0.5
                total, kinds = Counter(), Counter()
                for gram, c in levels[n].items():
                    total[gram[:-1]] += c
                    kinds[gram[:-1]] += 1
                for gram, c in levels[n].items():
                    terms[n].setdefault(gram, {})[column] = (c - discount) / total[gram[:-1]]
                for context, k in kinds.items():
                    weights[n].setdefault(context, {})[column] = discount * k / total[context]
        size = len(self.langs)
        self.floor = 1.0 / max(1, len(alphabet))
        self.terms = [self._sorted(x, size, 0.0) for x in terms]
        self.weights = [self._sorted(x, size, 1.0) for x in weights]
        self.sharpness, self.limit = 1.0, float("inf")

    @staticmethod
    def _sorted(found: dict[str, dict[int, float]], size: int, other: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and a row of values for each, with a last row for what isn't there."""
        keys = np.array([_hash(g) if g else 0 for g in found], dtype=np.uint64)
        values = np.full((len(found) + 1, size), other, dtype=np.float64)
        for row, g in enumerate(found):
            for column, value in found[g].items():
                values[row, column] = value
        order = np.argsort(keys)
        values[:-1] = values[:-1][order]
        return keys[order], values

    @staticmethod
    def _rows(table, wanted: np.ndarray) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return values[np.zeros(len(wanted), dtype=np.int64)]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return values[np.where(keys[at] == wanted, at, len(keys))]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability in each language; a word counts len + 1 characters."""
        text = "".join(START + w + END for w in words)
        codes = code_points(text)
        sizes = np.array([len(w) + 2 for w in words])
        starts = np.cumsum(sizes) - sizes
        depth = np.arange(len(codes)) - np.repeat(starts, sizes)  # characters before, within the word
        p = np.full((len(codes), len(self.langs)), self.floor)
        before = {n: hashes(codes, n) for n in range(1, ORDER + 1)}
        for n in range(1, ORDER + 1):
            here = np.flatnonzero(depth >= max(1, n - 1))
            context = np.zeros(len(here), dtype=np.uint64) if n == 1 else before[n - 1][here - 1]
            p[here] = self._rows(self.terms[n], before[n][here]) + self._rows(self.weights[n], context) * p[here]
        logs = np.log(np.maximum(p, 1e-12))
        logs[starts] = 0
        return np.add.reduceat(logs, starts, axis=0)


class Scorer:
    """Cross-entropies of texts, remembering the scores of words."""

    def __init__(self, models: Models):
        self.models, self.place = models, {}
        self.scores = np.zeros((1024, len(models.langs)))
        self.sizes = np.zeros(1024)

    def __call__(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """nats a character in each language, and characters; None without a letter."""
        words = _words((text or "").lower())
        if not words:
            return None, 0
        if len(self.place) > REMEMBER:
            self.place.clear()
        new = [w for w in set(words) if w not in self.place]
        if new:
            first = len(self.place)
            while first + len(new) > len(self.sizes):
                self.scores, self.sizes = np.concatenate([self.scores, self.scores]), np.concatenate([self.sizes, self.sizes])
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                self.scores[first + at : first + at + len(some)] = self.models.word_scores(some)
                self.sizes[first + at : first + at + len(some)] = [len(w) + 1 for w in some]
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
        places = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        n = self.sizes[places].sum()
        return -self.scores[places].sum(axis=0) / n, int(n)


def posterior(entropies: np.ndarray, n: int, sharpness: float) -> np.ndarray:
    x = -(entropies - entropies.min()) * sharpness * np.sqrt(n)
    return np.exp(x) / np.exp(x).sum()


def fit(rows: DataFrame, sample_chars: int = SAMPLE_CHARS, seed: int = SEED) -> Models | None:
    """rows (text, lang) -> models, or None without any. At most about sample_chars characters a language are counted, but at least its text of lowest hash."""
    ship(rows.sparkSession)
    share = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007
    known = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").withColumn("u", share)
    least = F.coalesce(F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("u"))), F.lit(-1.0))
    shares = known.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text").cast("long")).alias("chars"), least.alias("least")).collect()  # one row a language
    if not shares:
        return None
    of = lambda name: F.create_map(*(F.lit(x) for s in shares for x in (s["lang"], s[name])))[F.col("lang")]  # noqa: E731  a join would deal the texts out by language
    picked = known.select("lang", "text", of("rows").alias("rows"), of("chars").alias("chars"), of("least").alias("least"), "u")
    tenth = F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(10)) == 0
    floor = F.col("u") == F.col("least")  # so that few or very long texts give their language a model too
    sample = picked.where(floor | (~tenth & (F.col("u") * F.col("chars") < sample_chars))).select("lang", "text")

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(grams(text))
            flat = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat, strict=True)] if flat else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], ["lang", "gram", "n"])

    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(lang, {})[gram] = n
    if not counts:
        return None
    models = Models(counts)
    held = picked.where(~floor & tenth & (F.col("u") * F.col("rows") < 10 * CALIBRATION_ROWS)).select("lang", "text")
    _calibrate(models, held)
    return models


def _calibrate(models: Models, held: DataFrame) -> None:
    shared = held.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [(lang, *scorer(text)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [x for x in found if x[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([list(x[1]) for x in found], pa.list_(pa.float64())), pa.array([x[2] for x in found], pa.int64())], ["lang", "h", "n"])

    seen = [(models.langs.index(r.lang), np.array(r.h), r.n) for r in held.mapInArrow(score, "lang string, h array<double>, n long").collect() if r.lang in models.langs]
    if len(seen) < 20:
        return
    loss = lambda s: -sum(np.log(max(posterior(h, n, s)[k], 1e-9)) for k, h, n in seen)
    models.sharpness = min((0.25 * 2**i for i in range(9)), key=loss)
    models.limit = float(np.quantile([h[k] for k, h, n in seen], 0.995)) + 0.5


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """All columns of docs but the text, lang_pred, score, accepted and cross_entropy (of the language chosen)."""
    ship(docs.sparkSession)
    results = ("lang_pred", "score", "accepted", "cross_entropy")
    own = [c for c in docs.columns if c != text and c not in results]
    if models is None:
        return docs.select(*own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("cross_entropy"))
    chosen = docs.select(*own, F.col(text).alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1]) + "lang_pred string, score double, accepted boolean, cross_entropy double"
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own_models = shared.value
        scorer = Scorer(own_models)
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1):
                h, n = scorer(text.as_py())
                if h is None:
                    found.append((UNKNOWN, 0.0, False, None))
                else:
                    k = int(h.argmin())
                    found.append((own_models.langs[k], float(posterior(h, n, own_models.sharpness)[k]), bool(h[k] <= own_models.limit), float(h[k])))
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*own, *results])

    return chosen.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    models = fit(docs.where(~held_out).select("text", "lang"))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted", "cross_entropy")
