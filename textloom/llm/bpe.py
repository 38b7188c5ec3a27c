"""Byte-level BPE with the tokenizers library over Arrow batches.

The vocabulary is a rank file (one base64 token and its rank a line); its path is a
parameter, and the driver alone reads it. From the ranks come the merges, hence a
tokenizers BPE model over the byte-to-character mapping of byte-level vocabularies.
Texts are split by the pattern; each worker encodes a chunk (a word, mostly) once
and keeps its ids in a bounded memory, so that frequent ones cost a look-up. Special
tokens do not exist: their strings are ordinary text.

Decoding reverses the byte table. Tokens may split a character: decode_bytes() is
exact for any ids, and decode_text() carries an unfinished character over to the
next token and replaces what never becomes one.

Defined results: a null text counts as empty; an empty text has no ids; lone
surrogates cannot occur in Spark strings; repeated rows are encoded each time; an
empty table gives an empty table; columns of the input named like a result are
replaced. A text is encoded whole, whatever its length.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from textloom.llm.tables import slices, table
from textloom.session import ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Chunks that a worker remembers in each of two halves; the older half goes when the newer is full.
REMEMBER = 150_000
#: Longer chunks are encoded but not remembered.
LONGEST = 64
#: Characters that are encoded together.
SLICE = 500_000
_odd_space = re.compile(r"\s ").search


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(odd)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of two bytes or more, by rank: what is left when merges of lower rank have been done."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memory of chunks."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
        shown = byte_characters()
        show = lambda token: "".join(shown[b] for b in token)
        # no cache of its own: only chunks that are not remembered reach it
        self.model = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=[(show(a), show(b)) for a, b in merges], cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model.decoder = decoders.ByteLevel()
        self.split = regex.compile(pattern).findall
        self.spaced = pattern == public_tokenizers.PATTERN
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that split as they do within it.

        No match of the public pattern holds a space behind a character that is not white space, nor
        looks back, so a text may be cut before each such space; cutting there is much cheaper than
        splitting. A text with a space behind white space is cut into its pieces.
        """
        if self.spaced and "\0" not in text and not _odd_space(text):
            return text.replace(" ", "\0 ").split("\0")
        return self.split(text)

    def library(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece: all go through the library as one pretokenized sequence."""
        got = self.model.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4").tobytes()
        ends = (4 * np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(1, len(pieces) + 1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > REMEMBER:  # what is used again comes back from the older half
            self.known, self.older = {}, self.known
        known, older, once = self.known, self.older, {}
        parts = list(map(self.chunks, texts))

        def unknown(some: set[str]) -> list[str]:
            some = some.difference(known)
            known.update((c, older[c]) for c in some if c in older)
            return [c for c in some if c not in older]

        new = unknown(set().union(*parts))
        pieces = list(map(self.split, new))
        wanted = unknown(set().union(*pieces))
        for at in range(0, len(wanted), 10_000):
            some = wanted[at : at + 10_000]
            for piece, ids in zip(some, self.library(some), strict=True):
                (known if len(piece) <= LONGEST else once)[piece] = ids
        look = known.__getitem__ if not once else lambda c: once[c] if c in once else known[c]
        for chunk, own in zip(new, pieces, strict=True):
            if len(own) != 1:
                (known if len(chunk) <= LONGEST else once)[chunk] = b"".join(map(look, own))
        look = known.__getitem__ if not once else lambda c: once[c] if c in once else known[c]
        return [b"".join(map(look, chunks)) for chunks in parts]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> bytes:
        """Start and end of each token in characters, as pairs of little-endian unsigned 32-bit numbers.

        A token that holds part of a character spans that character.
        """
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80)  # of byte i, counted from 1
        ends = np.cumsum(self.lengths[np.frombuffer(ids, dtype="<u4")])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if not len(ends):
            return b""
        return np.stack([character[starts] - 1, character[ends - 1]], axis=1).astype("<u4").tobytes()

    def decode_text(self, ids: bytes) -> list[str]:
        """What each token adds to the text; a split character appears with its last token."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        found = [reader.decode(self.bytes_of[i]) for i in np.frombuffer(ids, dtype="<u4").tolist()]
        return [*found, rest] if (rest := reader.decode(b"", True)) else found


@cache
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    ranks = load_ranks(path)
    return Codec(ranks, merges_of(ranks), pattern)


_codecs: dict[str, Codec] = {}


class Shared:
    """A vocabulary read once by the driver and sent to the workers, each of which keeps its codec."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = load_ranks(path)
        self.pattern = pattern
        self.key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.content = spark.sparkContext.broadcast((ranks, merges_of(ranks)))

    def codec(self) -> Codec:
        if self.key not in _codecs:
            _codecs[self.key] = Codec(*self.content.value, self.pattern)
        return _codecs[self.key]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False, offsets: bool = False) -> DataFrame:
    """All columns of docs but the text, n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded (bytes) and offsets."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    results = ["n_tokens", "ids", *["decoded"] * decoded, *["offsets"] * offsets]
    own = [c for c in docs.columns if c != text and c not in results]
    chosen = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    schema += (", " if schema else "") + "n_tokens long, ids binary" + ", decoded binary" * decoded + ", offsets binary" * offsets

    shared = Shared(docs.sparkSession, path)

    def run(batches):
        own_codec = shared.codec()
        for whole in batches:
            for start, end in slices(pc.utf8_length(whole.column(whole.num_columns - 1)).to_pylist(), SLICE):
                batch = whole.slice(start, end - start)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = own_codec.encode(texts)
                columns = [*batch.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(list(map(own_codec.decode_bytes, ids)), pa.binary()))
                if offsets:
                    columns.append(pa.array([own_codec.offsets(t, x) for t, x in zip(texts, ids, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*own, *results])

    return chosen.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of encoded and `decoded`, the bytes; null ids give null."""
    ship(encoded.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    own = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*own).schema.fields) + ", decoded binary"

    shared = Shared(encoded.sparkSession, path)

    def run(batches):
        own_codec = shared.codec()
        for batch in batches:
            found = [None if x is None else own_codec.decode_bytes(x) for x in batch.column(own.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*own, "decoded"])

    return encoded.select(*own).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True))
