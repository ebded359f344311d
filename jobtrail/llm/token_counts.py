"""Token counts with a two-tier lookup, without shuffling pre-tokens.

A text is cut at ASCII white space. The tokenizer drops white space, its pattern never matches across it and its
normaliser composes no character with it, so the count of a text is the sum over these pre-tokens.
Tier one is a broadcast table of the most frequent pre-tokens of the corpus; tier two a bounded table that each
Python worker fills with what it had to encode.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import slices, texts_of

# Entries of the broadcast table, and of the summary of one task that it is made from.
FREQUENT = 30_000
SUMMARY = 20_000
# Pre-tokens longer than this are always encoded: the tables stay below a few dozen MB.
LONGEST = 64
WORKER_TABLE = 300_000


class Counts:
    """The lengths of pre-tokens by a tokenizer, given those of the frequent ones."""

    def __init__(self, path: str, frequent: dict[bytes, int]):
        self.library = _library(path)
        self.known = dict(frequent)
        self.limit = len(frequent) + WORKER_TABLE

    def lengths(self, pieces: list[bytes]) -> list[int]:
        return self.library([p.decode() for p in pieces])

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.known))
        found = dict(zip(new, self.lengths(new)))
        out = [sum([found[w] if w in found else self.known[w] for w in words]) for words in split]
        if len(self.known) < self.limit:
            self.known.update((w, n) for w, n in found.items() if len(w) <= LONGEST)
        return out


@lru_cache(maxsize=2)
def _library(path: str):
    """A function from texts to token counts: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        raise ValueError("white space is part of a sentencepiece model's tokens; texts can't be cut there")
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def frequent_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece binary, n bigint): pre-tokens by occurrences, from the largest counts of each task.

    A task counts all its texts, lets go of the rarest half whenever it holds four times SUMMARY pre-tokens, and
    hands on SUMMARY of them: the shuffle is bounded per task and holds no list of occurrences. The table only
    decides what is looked up where, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, "_text"):
                for t in texts_of(part, "_text"):
                    counts.update(t.encode().split())
                if len(counts) > 4 * SUMMARY:
                    counts = Counter(dict(counts.most_common(2 * SUMMARY)))
        top = [(w, n) for w, n in counts.most_common(SUMMARY) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) per row, as the library counts without added special tokens.

    ``tokenizer`` is the path of a tokenizers file on every executor whose pre-tokens hold no white space. A null
    or empty text has 0 tokens; repeated rows give repeated results; an empty table gives none.
    """
    top = frequent_pre_tokens(docs, text).orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()  # at most FREQUENT short rows
    pieces = [bytes(r.piece) for r in top]
    lengths = Counts(tokenizer, {}).lengths(pieces)
    frequent = docs.sparkSession.sparkContext.broadcast(dict(zip(pieces, lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(tokenizer, frequent.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [t.encode() for t in texts_of(part, "_text")]
                sizes, tokens = pa.array(map(len, texts), pa.int64()), pa.array(counts.count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, tokens], names=[key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
