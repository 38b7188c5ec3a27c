"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a word: an embedding of the word (the words that enough training documents
hold; the rest share one) beside the mean embeddings of its beginnings and of its inner
character runs. Two
recurrent passes over a window of WINDOW words, attention over their states, one
logit. A text is scored by the highest logit of all its windows, which overlap by
half, so each word is read in two contexts.

Fitting uses a bounded sample of labelled rows: about TRAIN_CHARS characters of text
(rows of more than TRAIN_LONGEST characters are left out), half of it kept for rows
labelled 1, chosen by a seeded hash of the text. A label holds for a text and not for
a window, so each round trains on the window of a text that the network finds worst
(at first, the one with the word of the highest smoothed log-odds, with which the
embeddings also start), and one more at random for texts labelled 0. Rows that
share most of their words count as one in those log-odds and in the split that
chooses the round and calibrates the logit.

Defined results: a null or empty text has one window without words and gets the score
of that; labels that are null teach nothing; a text with several labels is toxic if
one says so; without labels of both kinds every score is 0; repeated rows are scored
each time; an empty table gives an empty table; only the named columns are read.
Words are what white space separates, lower-cased, marks at either end removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.hashing import code_points, hashes
from textloom.llm.tables import slices, table
from textloom.scratch import materialize
from textloom.session import ship

WINDOW = 32
STRIDE = 16
TRAIN_CHARS = 12_000_000
TRAIN_LONGEST = 200_000
ROW = 100
VOCABULARY = 20_000
LEAST_DOCUMENTS = 4
PRIOR = 8
WORD, CHARS, HIDDEN, ATTEND = 8, 8, 8, 8
BUCKETS = 1 << 16
BEGINNINGS = (3, 4, 5, 6, 7, 8)
INNER = (3, 5)
ROUNDS = 6
STEPS = 400  # small samples are gone through more often
SEED = 42
THRESHOLD = 0.7
MARKS = ".,;:!?…\"'`´«»()[]{}<>#*$%&|_-–—~^=+/\\"
REMEMBER = 300_000
#: Characters whose windows are held together.
SLICE = 500_000


def normal(word: str) -> str:
    return word.lower().strip(MARKS)


class Grams:
    """Buckets of the words' character grams: beginnings (with the mark) and all inner runs.

    kind 0 has the beginnings of BEGINNINGS characters, kind 1 the runs of INNER
    characters. flat[kind][start[kind][i]:start[kind][i + 1]] are those of word i.
    """

    def __init__(self, words: list[str]):
        marked = [f"^{w}$" for w in words]
        sizes = np.array([len(w) for w in marked], dtype=np.int64)
        codes = code_points("".join(marked))
        starts = np.cumsum(sizes) - sizes
        depth = np.arange(len(codes)) - np.repeat(starts, sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        self.flat, self.start = [], []
        for kind, lengths in enumerate((BEGINNINGS, INNER)):
            own, found = [], []
            for n in lengths:
                at = np.flatnonzero(depth == n - 1 if kind == 0 else depth >= n - 1)
                own.append(word[at])
                found.append((hashes(codes, n)[at] % np.uint64(BUCKETS)).astype(np.int64))
            # every word has one bucket at least: its last character's
            own.append(np.arange(len(words)))
            found.append((hashes(codes, 2)[starts + sizes - 1] % np.uint64(BUCKETS)).astype(np.int64))
            own, found = np.concatenate(own), np.concatenate(found)
            order = np.argsort(own, kind="stable")
            self.flat.append(found[order])
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(words)))]))

    def of(self, some: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words at places some, one after the other, and how many each has."""
        sizes = self.start[kind][some + 1] - self.start[kind][some]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.start[kind][some], sizes)
        return self.flat[kind][at], sizes


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward passes. Word 0 stands for all unknown words."""

    def __init__(self, words: list[str], odds: np.ndarray, gram_odds: np.ndarray | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.words = {w: i + 1 for i, w in enumerate(words)}
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        size = WORD + 2 * CHARS
        self.p = {
            "word": (0.1 * rng.standard_normal((len(words) + 1, WORD))).astype(np.float32),
            "char": (0.1 * rng.standard_normal((BUCKETS, CHARS))).astype(np.float32),  # the mean of a word's grams of each kind goes in
            "attend": scale(2 * HIDDEN, ATTEND), "attend_b": np.zeros(ATTEND, np.float32), "attend_v": scale(ATTEND),
            "out": scale(2 * HIDDEN), "out_b": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p |= {f"w{way}": scale(size, 3 * HIDDEN), f"u{way}": scale(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["word"][0] = 0
        self.p["word"][1:, 0] = odds
        self.known = np.ones(BUCKETS, dtype=bool)  # grams that too few training texts hold say nothing
        if gram_odds is not None:
            self.known = ~np.isnan(gram_odds)
            self.p["char"][:, 0] = gram_odds
            self.p["char"][~self.known] = 0
        self.scale, self.shift = 1.0, 0.0

    # A batch: x (n, t, size) inputs, mask (n, t) of 1 for words. Gates in the order update, reset, candidate.

    def inputs(self, word_ids: np.ndarray, grams: Grams, some: np.ndarray) -> np.ndarray:
        """Input rows of the words at places some of grams."""
        means = []
        for kind in (0, 1):
            flat, sizes = grams.of(some, kind)
            means.append(np.add.reduceat(self.p["char"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32))
        return np.concatenate([self.p["word"][word_ids], *means], axis=1)

    def states(self, projected: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (n, t, HIDDEN) of one direction from projected inputs (n, t, 3 * HIDDEN)."""
        n, t, _ = projected.shape
        u, h = self.p[f"u{way}"], np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, t, HIDDEN), np.float32)
        for i in range(t) if way == "f" else reversed(range(t)):
            m = mask[:, i, None]
            gates = sigmoid(projected[:, i, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(projected[:, i, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((i, h, z, r, c, m))
            h = out[:, i] = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray):
        a = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        e = np.where(mask > 0, a @ self.p["attend_v"], -1e9)
        w = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", w, states)
        return pooled @ self.p["out"] + self.p["out_b"][0], a, w, pooled

    def logits(self, pf: np.ndarray, pb: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.states(pf, mask, "f"), self.states(pb, mask, "b")], axis=2)
        return self.pool(states, mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss (mean weighted cross-entropy), gradients of the dense parameters and of x."""
        kept = {"f": [], "b": []}
        both = [self.states(x @ self.p[f"w{w}"] + self.p[f"b{w}"], mask, w, kept[w]) for w in "fb"]
        states = np.concatenate(both, axis=2)
        logit, a, w, pooled = self.pool(states, mask)
        prob = sigmoid(logit)
        loss = -(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean()
        d_logit = (weight * (prob - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_states = w[:, :, None] * d_pooled[:, None]
        d_w = np.einsum("nh,nth->nt", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
        g["attend_v"] = np.einsum("nt,nta->a", d_e, a)
        d_a = d_e[:, :, None] * self.p["attend_v"] * (1 - a * a)
        g["attend"] = np.einsum("nth,nta->ha", states, d_a)
        g["attend_b"] = d_a.sum(axis=(0, 1))
        d_states = d_states + d_a @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for side, way in enumerate("fb"):
            d_mine, u = d_states[:, :, side * HIDDEN : (side + 1) * HIDDEN], self.p[f"u{way}"]
            d_u, d_proj = np.zeros_like(u), np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(x), HIDDEN), np.float32)
            for i, h, z, r, c, m in reversed(kept[way]):
                d_h = d_h + d_mine[:, i]
                d_c = d_h * m * z * (1 - c * c)
                d_z = d_h * m * (c - h) * z * (1 - z)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], axis=1)
                d_u[:, : 2 * HIDDEN] += h.T @ d_gates
                d_u[:, 2 * HIDDEN :] += (r * h).T @ d_c
                d_proj[:, i] = np.concatenate([d_gates, d_c], axis=1)
                d_h = d_h * (1 - m * z) + d_rh * r + d_gates @ u[:, : 2 * HIDDEN].T
            g[f"u{way}"], g[f"b{way}"] = d_u, d_proj.sum(axis=(0, 1))
            g[f"w{way}"] = np.einsum("nti,ntj->ij", x, d_proj, optimize=True)
            d_x += d_proj @ self.p[f"w{way}"].T
        return loss, g, d_x


class Lexicon:
    """Rows of projected inputs for the surface words met so far; row 0 is padding."""

    def __init__(self, network: Network, remember: int = REMEMBER):
        self.network, self.remember = network, remember
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.forward = np.zeros((1024, 3 * HIDDEN), np.float32)
        self.backward = np.zeros((1024, 3 * HIDDEN), np.float32)

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """Rows of the words of each text."""
        words = [t.split() for t in texts]
        new = sorted({w for own in words for w in own if w not in self.rows})
        for at in range(0, len(new), 20_000):
            self._add(new[at : at + 20_000])
        return [np.fromiter(map(self.rows.__getitem__, own), dtype=np.int64, count=len(own)) for own in words]

    def _add(self, new: list[str]) -> None:
        network, first = self.network, len(self.rows) + 1
        while first + len(new) > len(self.forward):
            self.forward, self.backward = (np.concatenate([x, np.zeros_like(x)]) for x in (self.forward, self.backward))
        plain = [normal(w) for w in new]
        x = network.inputs(np.array([network.words.get(w, 0) for w in plain]), Grams(plain), np.arange(len(plain)))
        self.forward[first : first + len(new)] = x @ network.p["wf"] + network.p["bf"]
        self.backward[first : first + len(new)] = x @ network.p["wb"] + network.p["bb"]
        self.rows.update(zip(new, range(first, first + len(new)), strict=True))

    def windows(self, places: list[np.ndarray], chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of texts given as rows, and where each text's windows start."""
        index, starts = [], []
        n = 0
        for rows in places:
            starts.append(n)
            own = cut(rows)
            index.append(own)
            n += len(own)
        index = np.concatenate(index)
        out = np.empty(len(index), np.float32)
        for at in range(0, len(index), chunk):
            some = index[at : at + chunk]
            mask = (some > 0).astype(np.float32)
            out[at : at + chunk] = self.network.logits(self.forward[some], self.backward[some], mask)
        return out, np.array(starts)


def cut(rows: np.ndarray) -> np.ndarray:
    """All windows of WINDOW rows, STRIDE apart, zero after the end; one at least."""
    n = max(1, -(-(len(rows) - WINDOW) // STRIDE) + 1) if len(rows) > WINDOW else 1
    padded = np.zeros((n - 1) * STRIDE + WINDOW, dtype=np.int64)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


# ---- fitting


def _family(words: list[str]) -> int:
    """The least hash of the text's runs of four words: the same for most near copies."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 3))), default=0)


def train(texts: list[str], labels: list[int], seed: int = SEED, rounds: int = ROUNDS) -> Network | None:
    """A network for texts and labels in memory, or None if the labels are all alike."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    words = [[w for w in map(normal, t.split()) if w] for t in texts]
    families = np.array([_family(w) for w in words], dtype=np.uint64)
    # words by the number of families that hold them
    seen: list[dict[str, set]] = [{}, {}]
    for own, label, family in zip(words, y, families, strict=True):
        for w in set(own):
            seen[label].setdefault(w, set()).add(family)
    counts = [{w: len(f) for w, f in s.items()} for s in seen]
    totals = [len(set(families[y == k])) for k in (0, 1)]
    both = {w: counts[0].get(w, 0) + counts[1].get(w, 0) for w in counts[0] | counts[1]}
    chosen = sorted((w for w in both if both[w] >= LEAST_DOCUMENTS), key=lambda w: (-both[w], w))[:VOCABULARY]
    base = totals[1] / sum(totals)
    log_odds = lambda one, zero: np.clip(np.log((one + PRIOR * base) / (zero + PRIOR * (1 - base)) * (1 - base) / base), -3, 3).astype(np.float32) / 2
    odds = log_odds(*(np.array([counts[k].get(w, 0) for w in chosen], dtype=np.float64) for k in (1, 0)))
    vocabulary = sorted({w for own in words for w in own})
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    grams = Grams(["", *vocabulary])
    docs = [np.array([number[w] for w in own], dtype=np.int64) for own in words]
    by_bucket = np.zeros((2, BUCKETS))
    for i in np.unique(np.stack([families, y.astype(np.uint64)]), axis=1, return_index=True)[1]:
        if len(docs[i]):
            own = np.unique(docs[i])
            by_bucket[y[i], np.unique(np.concatenate([grams.of(own, kind)[0] for kind in (0, 1)]))] += 1
    gram_odds = np.where(by_bucket.sum(axis=0) >= LEAST_DOCUMENTS, log_odds(by_bucket[1], by_bucket[0]), np.nan).astype(np.float32)
    network = Network(chosen, odds, gram_odds, seed)
    ids = np.array([0, *(network.words.get(w, 0) for w in vocabulary)])
    start = network.inputs(ids, grams, np.arange(len(ids)))
    prior = start[:, 0] + start[:, WORD]
    prior[0] = -9
    windows = [cut(d) for d in docs]
    held = families % np.uint64(5) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    worst = [int(prior[w].max(axis=1).argmax()) for w in windows]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step, best = 0, (np.inf, None)
    ones, zeros = np.flatnonzero((y == 1) & ~held), np.flatnonzero((y == 0) & ~held)
    least = STEPS // max(1, 2 * len(zeros) // 128)
    rounds = min(10 * rounds, max(rounds, least))
    for round_ in range(rounds):
        rows = [(windows[i][worst[i]], 1) for i in ones for _ in range(max(1, min(4, len(zeros) // (2 * len(ones)))))]
        rows += [(windows[i][k], 0) for i in zeros for k in (worst[i], rng.integers(len(windows[i])))]
        order = rng.permutation(len(rows))
        weight = np.array([1.0, 1.0])
        for at in range(0, len(order), 128):
            some = [rows[i] for i in order[at : at + 128]]
            step += 1
            _step(network, np.stack([r for r, _ in some]), np.array([k for _, k in some], np.float32), weight, ids, grams, moments, step, 0.01 * (1 - round_ / rounds) + 0.001)
        top = _score_all(network, vocabulary, docs, worst)
        at = held if (y[held] == 1).sum() >= 20 else np.ones(len(y), dtype=bool)
        scale, shift = calibrate(top[at], y[at])
        p = np.clip(sigmoid(scale * top[at] + shift), 1e-6, 1 - 1e-6)
        loss = -np.where(y[at] == 1, np.log(p), np.log(1 - p)).mean()
        if loss < best[0]:
            best = (loss, {k: v.copy() for k, v in network.p.items()}, scale, shift)
    _, network.p, network.scale, network.shift = best
    return network


def _score_all(network: Network, vocabulary: list[str], docs: list[np.ndarray], worst: list[int]) -> np.ndarray:
    """The highest logit of each text; its window goes to worst."""
    lexicon = Lexicon(network)
    for at in range(0, len(vocabulary), 20_000):
        lexicon._add(vocabulary[at : at + 20_000])
    top = np.empty(len(docs))
    for at in range(0, len(docs), 500):
        some = docs[at : at + 500]
        logits, starts = lexicon.windows(some)
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(logits)], strict=True)):
            worst[at + i] = int(logits[a:b].argmax())
            top[at + i] = logits[a + worst[at + i]]
    return top


def _step(network, rows, y, weight, ids, grams, moments, step, rate) -> None:
    """One step of Adam on a batch of windows."""
    distinct, place = np.unique(rows, return_inverse=True)
    place = place.reshape(rows.shape)
    table_x = network.inputs(ids[distinct], grams, distinct)
    mask = (rows > 0).astype(np.float32)
    x = table_x[place] * mask[:, :, None]
    _, g, d_x = network.gradients(x, mask, y, weight[y.astype(int)].astype(np.float32))
    d_x *= mask[:, :, None]
    d_table = np.zeros_like(table_x)
    np.add.at(d_table, place.ravel(), d_x.reshape(-1, d_x.shape[-1]))
    g["word"] = _rows(ids[distinct], d_table[:, :WORD], network.p["word"], np.arange(len(network.p["word"])) > 0)
    parts = []
    for kind in (0, 1):
        flat, sizes = grams.of(distinct, kind)
        parts.append((flat, np.repeat(d_table[:, WORD + kind * CHARS : WORD + (kind + 1) * CHARS] / sizes[:, None].astype(np.float32), sizes, axis=0)))
    g["char"] = _rows(*(np.concatenate(x) for x in zip(*parts, strict=True)), network.p["char"], network.known)
    norm = np.sqrt(sum(float(((v[1] if isinstance(v, tuple) else v) ** 2).sum()) for v in g.values()))
    for k, v in g.items():
        at, v = v if isinstance(v, tuple) else (slice(None), v)
        v = v * min(1.0, 5.0 / max(norm, 1e-9)) + 1e-4 * network.p[k][at]
        m, s = moments[k]
        m[at] += 0.1 * (v - m[at])
        s[at] += 0.001 * (v * v - s[at])
        network.p[k][at] -= (rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(s[at] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _rows(at: np.ndarray, d: np.ndarray, parameter: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a table that a batch touches and may change, and their summed gradients."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    summed = np.add.reduceat(d[order], first, axis=0).astype(parameter.dtype)
    return rows[may[rows]], summed[may[rows]]


def calibrate(logits: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale (above 0) and shift by regularised logistic regression on one variable, Newton's method."""
    mean, spread = logits.mean(), logits.std() + 1e-6
    x = (logits - mean) / spread
    w = np.zeros(2)
    goal = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(min(steps, 50)):
        p = sigmoid(design @ w)
        gradient = design.T @ (p - goal) + 1e-2 * w
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    scale = max(w[0], 1e-3) / spread
    return float(scale), float(w[1] - scale * mean)


def fit(docs: DataFrame, labels: DataFrame, train_chars: int = TRAIN_CHARS, longest: int = TRAIN_LONGEST, seed: int = SEED) -> Network | None:
    """docs (doc_id, text) and labels (doc_id, toxic) -> network, from a sample of about train_chars characters.

    Labels meet the texts' lengths and hashes, not the texts. A row counts ROW characters
    more than it has, so the sample has train_chars / ROW rows at most, give or take the
    spread of a hash; their ids are broadcast and only their texts leave the scan's tasks.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    u = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007
    sized = docs.where(F.length("text") <= longest).select("doc_id", (F.length("text") + ROW).cast("long").alias("chars"), u.alias("u"))
    labelled = materialize(sized.join(known, "doc_id"), "labelled")
    sizes = {r.toxic: r.chars for r in labelled.groupBy("toxic").agg(F.sum("chars").alias("chars")).collect()}
    if len(sizes) < 2:
        return None
    ones = min(sizes[1], max(train_chars // 2, train_chars - sizes[0]))
    share = {1: ones / sizes[1], 0: min(1.0, (train_chars - ones) / sizes[0])}
    chosen = labelled.where(F.col("u") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = sorted((r.text, r.toxic) for r in sample.toLocalIterator())
    return train([t for t, _ in rows], [k for _, k in rows], seed)


# ---- scoring


def score(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """All columns of docs but the text, `score` and `windows`, the number of windows scored."""
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in (text, "score", "windows")]
    if network is None:
        return docs.select(*own, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("windows"))
    chosen = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1]) + "score double, windows long"
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        lexicon = Lexicon(shared.value)
        for whole in batches:
            for start, end in slices(pc.utf8_length(whole.column(whole.num_columns - 1)).to_pylist(), SLICE):
                batch = whole.slice(start, end - start)
                if len(lexicon.rows) > lexicon.remember:
                    lexicon.clear()
                places = lexicon.places(batch.column(batch.num_columns - 1).to_pylist())
                logits, starts = lexicon.windows(places)
                top = np.maximum.reduceat(logits, starts).astype(np.float64)
                p = sigmoid(shared.value.scale * top + shared.value.shift)
                n = np.diff([*starts, len(logits)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array(n, pa.int64())], [*own, "score", "windows"])

    return chosen.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = score(docs.select("doc_id", held_out.alias("held_out"), "text"), fit(docs, labels.where(~held_out)))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "windows")
