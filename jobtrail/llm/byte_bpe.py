"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Every byte is mapped to one printable character, so each token of the vocabulary becomes a piece; its score is
the negative rank and the normaliser is the identity. sentencepiece then merges the best-scored neighbours first
and the leftmost of equals, which is the order of the ranks. Nothing is trained.

A text is cut into pre-tokens by the tokenizer's pattern and each pre-token is encoded alone. Runs of non-space
with at most one space before them are cut off first, as no match of the pattern reaches over their ends: ids of a
run are kept in a bounded table per Python worker, so frequent runs are encoded once.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import slices, texts_of

# Bytes of runs kept per Python worker, and what an entry takes besides its content; others are encoded again.
RUNS_BYTES, ENTRY_BYTES = 48 << 20, 220
RUN = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
# White space beyond these four makes a text go through the pattern as a whole.
OTHER_SPACE = re.compile("[^\\S \t\n\r]|[\x1c-\x1f\x85]")


def byte_characters() -> list[str]:
    """A character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which have to be 0, 1, 2 ..."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [token for _, token in pairs]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, integer or float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary: piece i is token i, the unknown piece comes last."""
    chars = byte_characters()
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
    # Field numbers and enumerations of sentencepiece's model format.
    piece, score, kind, normal, unknown = 1, 2, 3, 1, 2
    model_type, vocab_size, unk_id, bos_id, eos_id, pad_id, unk_piece = 3, 4, 40, 41, 42, 43, 45
    bpe, none = 2, (1 << 64) - 1
    name, dummy_prefix, extra_whitespace, escape_whitespace = 1, 3, 4, 5

    unk = "⁇".encode()
    out = bytearray()
    for rank, token in enumerate(tokens):
        text = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(piece, text) + _field(score, float(-rank)) + _field(kind, normal))
    out += _field(1, _field(piece, unk) + _field(score, float(-len(tokens))) + _field(kind, unknown))
    trainer = {model_type: bpe, vocab_size: len(tokens) + 1, unk_id: len(tokens), bos_id: none, eos_id: none, pad_id: none, unk_piece: unk}
    out += _field(2, b"".join(_field(k, v) for k, v in trainer.items()))
    identity = {name: b"identity", dummy_prefix: 0, extra_whitespace: 0, escape_whitespace: 0}
    out += _field(3, b"".join(_field(k, v) for k, v in identity.items()))
    return bytes(out)


class Encoder:
    """Encodes texts to packed ids (little-endian unsigned 32-bit)."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.to_chars = dict(zip(range(256), byte_characters()))
        # A pre-token that is in the vocabulary as a whole is one token, also where merges would not lead to it.
        found = self.model.encode([self._mapped(t) for t in tokens], out_type=int, num_threads=1)
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens) if found[i] != [i]}
        self.runs: dict[str, bytes] = {}
        self.held = 0
        self._tokens: list[bytes] | None = None

    def _mapped(self, piece: bytes) -> str:
        return piece.decode("latin-1").translate(self.to_chars)

    def _pre_tokens(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text, from its pre-tokens."""
        pre = [[p.encode() for p in self.pattern.findall(t)] for t in texts]
        ids = iter(self.model.encode([self._mapped(p) for ps in pre for p in ps], out_type=int, num_threads=1))
        return [b"".join(self._packed(p, next(ids)) for p in ps) for ps in pre]

    def _packed(self, piece: bytes, ids: list[int]) -> bytes:
        return self.whole.get(piece) or struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = [[t] if OTHER_SPACE.search(t) else RUN.findall(t) for t in texts]
        new = list(set().union(*runs).difference(self.runs))
        packed = dict(zip(new, self._pre_tokens(new)))
        known = self.runs
        if self.held < RUNS_BYTES:
            short = {r: i for r, i in packed.items() if len(r) <= 64}
            known.update(short)
            self.held += sum(ENTRY_BYTES + len(r) + len(i) for r, i in short.items())
        return [b"".join([packed[r] if r in packed else known[r] for r in rs]) for rs in runs]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids: the model's pieces with the characters mapped back to bytes."""
        if self._tokens is None:
            byte_of = {c: b for b, c in self.to_chars.items()}
            pieces = map(self.model.id_to_piece, range(self.model.get_piece_size() - 1))
            self._tokens = [bytes([byte_of[c] for c in p]) for p in pieces]
        tokens = self._tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> tuple[bytes, ...]:
    return tuple(read_ranks(path))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids) per row; ids is binary, little-endian unsigned 32-bit. A null text is an empty one.

    Rows are independent: no shuffle, repeated rows give repeated results, an empty table gives none. ``vocabulary``
    is the path of a rank file on every executor, ``pattern`` the regular expression of the pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = encoder.encode(texts_of(part, "_text"))
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary())], names=[key, "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and decoded, the bytes of ids. Null ids decode to nothing; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [b"".join([tokens[i] for i in np.frombuffer(v or b"", "<u4").tolist()]) for v in part.column("ids").to_pylist()]
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*keep, "decoded"])

    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, "ids").mapInArrow(run, f"{kinds}, decoded binary")


def recode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded) per row: ``encode``, and the bytes the ids decode to, in one Python worker.

    The ids are decoded by the inverse of the model that encoded them, so equal bytes also check the model. Nulls,
    repeated rows and empty tables as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = encoder.encode(texts_of(part, "_text"))
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                decoded = pa.array([encoder.decode(i) for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary()), decoded], names=[key, "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids binary, decoded binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes they decode to."""
    return recode(docs, vocabulary, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
