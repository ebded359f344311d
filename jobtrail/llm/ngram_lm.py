"""Language-model scores from an Elias-Fano n-gram trie of words, pairs and triples.

Texts are cut into blocks; a block knows its words by local numbers. Word counts are summed by shards of the
vocabulary, which also number the words, frequent ones first. Each block then sends its distinct triples, of a word,
the one before it (the context) and the one before that (the history), to shards of the context; a shard counts those
of the training texts, builds a trie of them, stores it, and answers from the stored form with quantised probabilities
and back-off weights that the block adds up to scores. Frequent contexts are spread over many shards.

Under each context a trie has two levels, its followers and its histories, and under each history a third one, the
followers met after it. These are not stored as words, but as places among the followers of the context, which need
few bits. Contexts, pointers, followers, histories and triples (each parent's own sorted range, raised by a running
base) are monotone sequences in Elias-Fano form: packed low bits and a unary vector of the high bits. Probabilities
and back-off weights are one byte each. Levels are flat buffers read by offset, without objects per entry: a task maps
its trie's file into memory while it answers. That file is the task's own; the same bytes are stored with the answers in
the shared folder, as a file of one machine would not be seen by others.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import hashed, slices, texts_of, written

FOLDS, HELD_OUT = 7, 2
# Tokens of a block, tokens per shard, and tokens per stored piece of a block.
BLOCK_TOKENS, SHARD_TOKENS, PIECE_TOKENS = 1_500_000, 3_000_000, 150_000
DISCOUNT = 0.75
# A context with more than its share of all tokens is spread over the shards; at most SPREAD contexts can have one. A
# history of it goes to one shard, but is spread as well if both words are among the PAIR_SPREAD most frequent at most.
SPREAD, PAIR_SPREAD = 4096, 256
# Probabilities are stored as one of 255 steps of their logarithm, from 10^-9 to 1; 0 stands for none.
LOWEST = -9.0
# Bits of a sort key; blocks of so many words that three do not fit are sorted by columns.
KEY_BITS = 63
# Values that are searched at once, so that what is made on the way stays in a core's cache.
AT_ONCE = 1 << 16
# No word holds white space, so this can stand for the end of a text, and for the context of its first word.
END = b"\n"


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of their bytes."""
    import zstandard

    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    used = max([i + 1 for i in range(8) if planes[i].any()], default=0)
    body = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())
    return len(values).to_bytes(8, "little") + body


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8) if n else np.empty(0, np.uint8)
    planes = np.zeros((n, 8), np.uint8)
    if len(body):
        planes[:, : len(body) // n] = body.reshape(-1, n).T
    return planes.view("<u8").ravel().astype(np.int64)


@dataclass
class EliasFano:
    """A sorted sequence of integers: ``width`` low bits of each, and the high bits in unary."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    starts: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = values >> width
        unary = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        low = [np.empty(0, np.uint8)]
        for at in range(0, n if width else 0, 1 << 18):
            bits = np.unpackbits(values[at : at + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little")
            low.append(np.packbits(bits.ravel(), bitorder="little"))
        return cls(n, width, np.concatenate((*low, np.zeros(8, np.uint8))), np.packbits(unary, bitorder="little"))

    def _directory(self) -> np.ndarray:
        """Where each value of the high bits begins: made once, when the level is first read."""
        if self.starts is None:
            zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
            ends = np.minimum(zeros - np.arange(len(zeros)), self.n)
            self.starts = np.concatenate(([0], ends))
        return self.starts

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        # Eight bytes from any place on; the buffer ends with eight more.
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        """The whole sequence, read from front to back."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        return (high << self.width) | self._low(np.arange(self.n))

    def access(self, at: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self._directory(), at, "right") - 1 << self.width) | self._low(at)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per value the place of the first element not below it, the end of those with its high bits, and whether
        there can be such."""
        starts = self._directory()
        high = np.minimum(values >> self.width, len(starts) - 2)
        beyond = values >> self.width > high
        low, end = starts[high], starts[high + 1]
        last, want = end.copy(), values & ((1 << self.width) - 1)
        open_ = np.flatnonzero(low < last)
        while open_.size:
            middle = (low[open_] + last[open_]) // 2
            below = self._low(middle) < want[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            last[open_] = np.where(below, last[open_], middle)
            open_ = open_[low[open_] < last[open_]]
        return low, end, beyond

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The place of the first element not below each value; n if there is none."""
        low, _, beyond = self._search(values)
        return np.where(beyond, self.n, low)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of the first element equal to each value; -1 if there is none."""
        out = np.full(len(values), -1)
        for at in range(0, len(values), AT_ONCE):
            part = values[at : at + AT_ONCE]
            low, end, beyond = self._search(part)
            there = np.flatnonzero((low < end) & ~beyond)
            met = there[self._low(low[there]) == part[there] & ((1 << self.width) - 1)]
            out[at + met] = low[met]
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which is faster for many different integers than its hash table."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))]


def raised(first: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """The running base of each child: children of a parent are apart by the number of its followers."""
    followers, children = np.diff(first), np.diff(parents)
    base = np.cumsum(followers * children) - followers * children
    own = np.repeat(np.arange(len(children)), children)
    return base[own] + (np.arange(len(own)) - parents[:-1][own]) * followers[own]


@dataclass
class Trie:
    """Contexts, with pointers to their followers and histories; followers and histories raised by their context's base,
    with a code each; triples, as places among the context's followers raised by their history's base, with a code."""

    contexts: EliasFano
    pointers: EliasFano
    followers: EliasFano
    parents: EliasFano
    histories: EliasFano
    triples: EliasFano
    codes: np.ndarray
    weights: np.ndarray
    triple_codes: np.ndarray
    span: int
    history_span: int
    first: np.ndarray | None = None
    base: np.ndarray | None = None

    @classmethod
    def build(cls, contexts: np.ndarray, followers: np.ndarray, codes: np.ndarray, histories=None, weights=None, triples=None, triple_codes=None) -> Trie:
        """Pairs in order of context and follower, each once; histories as (places of their contexts, words), in this
        order, each once; triples as sorted raised places."""
        none = np.empty(0, np.int64)
        own, first = np.unique(contexts, return_index=True)
        span = int(followers.max()) + 1 if len(followers) else 1
        place = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(contexts))))
        of, words = histories if histories is not None else (none, none)
        history_span = int(words.max()) + 1 if len(words) else 1
        sequences = (own, np.append(first, len(contexts)), place * span + followers, np.searchsorted(of, np.arange(len(own) + 1)), of * history_span + words, none if triples is None else triples)
        bytes_ = [(none if c is None else c).astype(np.uint8) for c in (codes, weights, triple_codes)]
        return cls(*map(EliasFano.encode, sequences), *bytes_, span, history_span)

    def _pointers(self) -> np.ndarray:
        """Where the followers of each context begin: read once, when first needed."""
        if self.first is None:
            self.first = self.pointers.all()
            self.base = raised(self.first, self.parents.all())
        return self.first

    def context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each context (-1: none) and how many followers it has."""
        first, at = self._pointers(), self.contexts.find(contexts)
        return at, np.where(at >= 0, np.append(np.diff(first), 0)[at], 0)

    def _below(self, level: EliasFano, span: int, place: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.full(len(place), -1)
        known = np.flatnonzero((place >= 0) & (words < span))
        out[known] = level.find(place[known] * span + words[known])
        return out

    def follower(self, place: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each follower of the context at a place; -1 without one."""
        return self._below(self.followers, self.span, place, words)

    def history(self, place: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self._below(self.histories, self.history_span, place, words)

    def find(self, place: np.ndarray, followers: np.ndarray) -> np.ndarray:
        """The code of each follower relative to the place of its context; 0 without one."""
        return np.append(self.codes, np.uint8(0))[self.follower(place, followers)]

    def find_triple(self, place: np.ndarray, history: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """The code of each follower (by its place) after a history (by its place) of the context at a place."""
        out = np.zeros(len(place), np.uint8)
        known = np.flatnonzero((history >= 0) & (follower >= 0))
        at = self.triples.find(self.base[history[known]] + follower[known] - self._pointers()[place[known]])
        out[known] = np.append(self.triple_codes, np.uint8(0))[at]
        return out

    def _levels(self):
        return self.contexts, self.pointers, self.followers, self.parents, self.histories, self.triples

    def stored(self) -> bytes:
        codes = (self.codes, self.weights, self.triple_codes)
        numbers = [self.span, self.history_span] + [len(c) for c in codes] + [x for e in self._levels() for x in (e.n, e.width, len(e.low), len(e.high))]
        return np.array(numbers, "<i8").tobytes() + b"".join(e.low.tobytes() + e.high.tobytes() for e in self._levels()) + b"".join(c.tobytes() for c in codes)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie read from a memory-mapped file, which is gone with the trie."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            return cls.view(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def view(cls, data: bytes | mmap.mmap) -> Trie:
        head = np.frombuffer(data, "<i8", 29).tolist()
        at, levels, codes = 29 * 8, [], []
        for n, width, low, high in zip(*[iter(head[5:])] * 4):
            levels.append(EliasFano(n, width, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low)))
            at += low + high
        for n in head[2:5]:
            codes.append(np.frombuffer(data, np.uint8, n, at))
            at += n
        return cls(*levels, *codes, head[0], head[1])


def quantised(p: np.ndarray) -> np.ndarray:
    return 1 + np.rint(254 * (np.clip(np.log10(p), LOWEST, 0) / LOWEST)).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    steps = np.concatenate(([0.0], 10 ** (LOWEST * np.arange(255) / 254)))
    return steps[codes]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


PIECES = "block bigint, shard int, ids array<bigint>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary"


def _pieces(docs: DataFrame, shards: int) -> DataFrame:
    """PIECES: rows with shard null hold texts of a block as word numbers; the others words of a shard with numbers
    (tokens) and occurrences in training texts (counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        rows_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
        block = TaskContext.get().partitionId() << 24
        numbers, counts, total, piece = _Numbers({END: 0}), np.zeros(1 << 16, np.int64), 0, []

        def texts():
            ids, held, tokens = zip(*piece)
            return (block, None, list(ids), list(held), [len(t) for t in tokens], pack(np.concatenate(tokens)), None, None)

        def words():
            by = [([], []) for _ in range(shards)]
            for w, i in numbers.items():
                at = by[xxhash.xxh32_intdigest(w) % shards]
                at[0].append(w)
                at[1].append(i)
            for shard, (ws, at) in enumerate(by):
                if ws:
                    yield (block, shard, None, None, None, pack(np.array(at)), b" ".join(ws), pack(counts[at]))

        for batch in batches:
            for part in slices(batch, "text"):
                for i, held, t in zip(part.column("doc_id").to_pylist(), part.column("held").to_pylist(), texts_of(part)):
                    tokens = t.encode().lower().split()
                    tokens.append(END)
                    tokens = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
                    if not held:
                        if len(numbers) > len(counts):
                            counts = np.concatenate((counts, np.zeros(max(len(counts), len(numbers)), np.int64)))
                        part_counts = np.bincount(tokens)
                        counts[: len(part_counts)] += part_counts
                    elif len(numbers) > len(counts):
                        counts = np.concatenate((counts, np.zeros(max(len(counts), len(numbers)), np.int64)))
                    piece.append((i, held, tokens))
                    total += len(tokens)
                    if sum(len(p[2]) for p in piece[-2:]) > PIECE_TOKENS or len(piece) >= 256:
                        yield rows_of([texts()])
                        piece = []
                    if total >= BLOCK_TOKENS:
                        if piece:
                            yield rows_of([texts()])
                        yield rows_of(list(words()))
                        block, numbers, counts, total, piece = block + 1, _Numbers({END: 0}), np.zeros(1 << 16, np.int64), 0, []
        if piece:
            yield rows_of([texts()])
        if total:
            yield rows_of(list(words()))

    return docs.select("doc_id", "text", "held").mapInArrow(run, PIECES)


COUNTED = "block bigint, tokens binary, counts binary, numbers binary, n bigint, v bigint, n1 bigint, often array<bigint>, often_counts array<bigint>"


def _counted(pieces: DataFrame, shards: int) -> DataFrame:
    """COUNTED: for each block and shard the words' counts over all training texts, and one plus their corpus-wide
    numbers (0: in no training text); one row per shard, with block null, has its totals and the words that may be
    frequent."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        total: dict[bytes, int] = {}
        for words, counts in zip(rows["words"], rows["counts"]):
            for w, n in zip(words.split(b" "), unpack(counts).tolist()):
                total[w] = total.get(w, 0) + n
        known = sorted((-n, w) for w, n in total.items() if n)
        number = {w: rank * shards + shard + 1 for rank, (_, w) in enumerate(known)}
        n = -sum(n for n, _ in known)
        often = [(number[w], -c) for c, w in known if is_frequent(-c, shards, n)]  # the shard's n is below the whole one
        out = [(None, None, None, None, n, len(known), sum(c == -1 for c, _ in known), [x for x, _ in often], [c for _, c in often])]
        for block, tokens, words in zip(rows["block"], rows["tokens"], rows["words"]):
            ws = words.split(b" ")
            out.append((block, tokens, pack(np.array([total[w] for w in ws])), pack(np.array([number.get(w, 0) for w in ws])), None, None, None, None, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COUNTED.split(", ")]).astype({c: "Int64" for c in ("block", "n", "v", "n1")})

    rows = pieces.where("shard IS NOT NULL").select("block", "shard", "tokens", "words", "counts")
    return rows.groupBy("shard").applyInPandas(count, COUNTED)


def is_frequent(count: np.ndarray, shards: int, n: int, most: int | None = None) -> np.ndarray:
    return count * min(4 * shards, most or SPREAD) > n


def is_spread(context: np.ndarray, history: np.ndarray, shards: int, n: int) -> np.ndarray:
    """Whether the followers of a history are spread, by the counts of both words."""
    return is_frequent(np.minimum(context, history), shards, n, PAIR_SPREAD)


@dataclass
class Block:
    """The texts of a block: its words' numbers in order (0: unknown ones) and their counts; per token the place of its
    word there, that of the one before it and that of the one before both (0 also: none)."""

    ids: list
    held: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    word: np.ndarray
    context: np.ndarray
    history: np.ndarray

    @classmethod
    def of(cls, texts: pd.DataFrame, counted: pd.DataFrame) -> Block:
        local = [unpack(t) for t in counted["tokens"]]
        size = max(int(t.max()) for t in local) + 1
        count, number = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for at, c, n in zip(local, counted["counts"], counted["numbers"]):
            count[at], number[at] = unpack(c), unpack(n)
        texts = texts.sort_values("place")
        tokens = np.concatenate([unpack(t) for t in texts["tokens"]])
        sizes = np.concatenate([np.asarray(s, np.int64) for s in texts["sizes"]])
        numbers = distinct(np.append(number, 0))
        place = np.searchsorted(numbers, number)
        counts = np.zeros(len(numbers), np.int64)
        counts[place] = count
        end, word = place[0], place[tokens]  # every text ends with END, whose number is 0 in its block
        context = np.concatenate(([end], word[:-1]))
        history = np.concatenate(([0, end], word[:-2]))[: len(word)]
        history[np.cumsum(sizes)[:-1]] = 0
        ids = [i for piece in texts["ids"] for i in piece]
        held = np.array([h for piece in texts["held"] for h in piece], bool)
        return cls(ids, held, sizes, numbers, counts, word, context, history)

    def entries(self, shards: int, n: int) -> Entries:
        """What the block asks: its distinct triples, and for frequent contexts its distinct pairs, without a history."""
        frequent = is_frequent(self.counts, shards, n)
        asking = np.flatnonzero(self.context)
        apart = np.flatnonzero(frequent[self.context] & (self.context > 0) & (self.history > 0))
        of = np.concatenate((asking, apart))
        v, w = self.context[of], self.word[of]
        u = np.concatenate((self.history[asking], np.zeros(len(apart), np.int64)))
        bits = len(self.numbers).bit_length()
        if 3 * bits <= KEY_BITS:
            key = (v << 2 * bits) | (u << bits) | w
            order = np.argsort(key)
            key = key[order]
            new = key[1:] != key[:-1]
        else:
            order = np.lexsort((w, u, v))
            new = (np.diff(v[order]) != 0) | (np.diff(u[order]) != 0) | (np.diff(w[order]) != 0)
        new = np.concatenate((np.ones(min(len(of), 1), bool), new))
        first = order[new]
        v, u, w = v[first], u[first], w[first]

        mixed = self.numbers[v].astype(np.uint64)
        often, spread = frequent[v], is_spread(self.counts[v], self.counts[u], shards, n)
        with np.errstate(over="ignore"):
            mixed[often] += self.numbers[u[often]].astype(np.uint64) * np.uint64(0x1F3D5B79)
            by_word = often & ((u == 0) | spread)
            mixed[by_word] += self.numbers[w[by_word]].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        shard = (hashed(mixed, 21) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
        by_shard = np.argsort(shard, kind="stable")
        place = np.empty(len(v), np.int64)
        place[by_shard] = np.arange(len(v))
        of_token = np.empty(len(of), np.int64)
        of_token[order] = place[np.cumsum(new) - 1]
        triple = np.full(len(self.word), -1)
        triple[asking] = of_token[: len(asking)]
        pair = triple.copy()
        pair[apart] = of_token[len(asking) :]
        return Entries.of(shard[by_shard].astype(np.int64), v[by_shard], u[by_shard], w[by_shard], triple, pair)


@dataclass
class Entries:
    """What a block asks, by shard, context, history, word (places in the block's numbers); where its groups of one
    history (groups) and of one context (heads, among the groups) begin; per token the entries of its triple and of
    its pair (-1: none)."""

    shard: np.ndarray
    context: np.ndarray
    history: np.ndarray
    word: np.ndarray
    groups: np.ndarray
    heads: np.ndarray
    triple: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, shard, context, history, word, triple, pair) -> Entries:
        some = np.ones(min(len(word), 1), bool)
        head = np.concatenate((some, (np.diff(shard) != 0) | (np.diff(context) != 0)))
        groups = np.flatnonzero(head | np.concatenate((some, np.diff(history) != 0)))
        return cls(shard, context, history, word, groups, np.flatnonzero(head[groups]), triple, pair)

    def by_shard(self):
        """(shard, its entries, its groups, its heads), as slices."""
        at = np.append(np.flatnonzero(np.diff(self.shard, prepend=-1)), len(self.shard))
        group = np.searchsorted(self.groups, at)
        head = np.searchsorted(self.heads, group)
        for i, shard in enumerate(self.shard[at[:-1]].tolist()):
            yield shard, *[slice(x[i], x[i + 1]) for x in (at, group, head)]


def lengths(starts: np.ndarray, within: slice, end: int) -> np.ndarray:
    return np.diff(np.append(starts[within], end))


ASKED = "shard int, block bigint, contexts binary, histories_each binary, histories binary, words_each binary, words binary, counts binary"
ANSWERS = (
    "shard int, block bigint, pairs binary, triples binary, weights binary, kinds binary, trie binary, frequent array<bigint>, followers array<bigint>,"
    " contexts array<bigint>, histories array<bigint>, counts array<bigint>, words array<bigint>"
)
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """SCORES and train_tokens of each row of docs (doc_id, text), learned from the rows of the training folds.

    A null text is an empty one: only its end is scored. A null doc_id belongs to the training texts. Repeated rows
    are repeated texts. An empty table gives no rows; without training texts all probabilities are those of an
    unknown word, 1. base_score adds log10((c + 1) / (N + V + 1)); score uses triples of words, discounted by DISCOUNT
    and filled up with pairs, these with single words, where all unknown words together have the share of words seen
    once. A text's first token follows the end of a text and has no history; an unknown word is no context or history.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(fold, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, size // (5 * SHARD_TOKENS))
    pieces = written(_pieces(rows, shards), "pieces")
    counted = written(_counted(pieces, shards), "counts")
    totals = counted.where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1")]).first()
    n, v = totals.n, totals.v
    unknown = (totals.n1 + 1) / (n + 2)

    texts = pieces.where("shard IS NULL").select("block", "ids", "held", "sizes", "tokens", F.xxhash64("tokens", "ids").alias("place"))
    words = counted.where("block IS NOT NULL").select("block", "tokens", "counts", "numbers")

    frequent = counted.where("block IS NULL").select(F.explode(F.arrays_zip("often", "often_counts")).alias("x")).select("x.*")
    # At most SPREAD words.
    often = np.array(sorted(map(tuple, frequent.where(F.col("often_counts") * min(4 * shards, SPREAD) > n).collect())), np.int64).reshape(-1, 2)

    def count_of(words: np.ndarray) -> np.ndarray:
        """Counts of frequent words, by number; 0 for others."""
        at = np.searchsorted(often[:, 0], words)
        return np.where(np.append(often[:, 0], -1)[at] == words, np.append(often[:, 1], 0)[at], 0)

    def ask(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        block = Block.of(texts, words)
        asks = block.entries(shards, n)
        trained = np.repeat(~block.held, block.sizes)
        counts = np.bincount(asks.triple[trained & (asks.triple >= 0)], minlength=len(asks.word))
        counts += np.bincount(asks.pair[trained & (asks.pair != asks.triple)], minlength=len(asks.word))
        out = []
        for to, entries, groups, heads in asks.by_shard():
            first = asks.groups[groups]
            contexts = block.numbers[asks.context[asks.groups[asks.heads[heads]]]]
            columns = (
                np.diff(contexts, prepend=0), lengths(asks.heads, heads, groups.stop),
                block.numbers[asks.history[first]], lengths(asks.groups, groups, entries.stop),
                block.numbers[asks.word[entries]], counts[entries],
            )
            out.append((to, int(texts["block"].iloc[0]), *map(pack, columns)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ASKED.split(", ")])

    def learn(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[Trie, tuple]:
        """The trie of a shard's counts by context, history and word, and what it has of spread words and histories."""
        own = distinct(v)
        v = np.searchsorted(own, v)
        total = count_of(own)
        is_often = total > 0
        key = v << 40 | w
        pairs = distinct(key)
        follower = np.searchsorted(pairs, key)
        counted = ~is_often[v] | (u == 0)  # pairs of a frequent context are counted apart
        pair_counts = np.bincount(follower[counted], c[counted], len(pairs)).astype(np.int64)
        of = pairs >> 40
        total = np.where(is_often, total, np.bincount(of, pair_counts, len(own)).astype(np.int64))
        codes = np.where(pair_counts > 0, quantised(np.maximum(pair_counts - DISCOUNT, 0.1) / total[of]), 0)
        first = np.searchsorted(of, np.arange(len(own) + 1))

        after = np.flatnonzero(u)
        v, c, follower = v[after], c[after], follower[after]
        key = v << 40 | u[after]
        histories = distinct(key)
        history = np.searchsorted(histories, key)
        parent, word = histories >> 40, histories & ((1 << 40) - 1)
        base = raised(first, np.searchsorted(parent, np.arange(len(own) + 1)))
        key = base[history] + follower - first[v]
        triples = distinct(key)
        counts = np.bincount(np.searchsorted(triples, key), c, len(triples))
        history = np.searchsorted(base, triples, "right") - 1
        in_all, kinds = np.bincount(history, counts, len(histories)), np.bincount(history, minlength=len(histories))
        # Of a spread history only a part is here, so its triples are relative to the context.
        spread = is_spread(total[parent], count_of(word), shards, n)
        relative = np.where(spread, total[parent], in_all)[history]
        weights = np.where(spread, 0, quantised(DISCOUNT * kinds / in_all))
        trie = Trie.build(own[of], pairs & ((1 << 40) - 1), codes, (parent, word), weights, triples, quantised((counts - DISCOUNT) / relative))
        followers = np.bincount(of, pair_counts > 0, len(own)).astype(np.int64)
        parts = (own[is_often], followers[is_often], own[parent[spread]], word[spread], in_all[spread].astype(np.int64), kinds[spread])
        return trie, tuple(x.tolist() for x in parts)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asked = {c: [unpack(x) for x in rows[c]] for c in ("histories_each", "histories", "words_each", "words", "counts")}
        contexts = [np.cumsum(unpack(x)) for x in rows["contexts"]]
        ends = {c: np.cumsum([len(x) for x in asked[c]])[:-1] for c in ("histories", "words")}
        ends["contexts"] = np.cumsum([len(x) for x in contexts])[:-1]
        contexts, asked = np.concatenate(contexts), {c: np.concatenate(asked.pop(c)) for c in list(asked)}
        words_each, words, histories = asked["words_each"], asked["words"], asked["histories"]
        trained = np.flatnonzero(asked["counts"])
        group = np.repeat(np.arange(len(histories)), words_each)[trained]
        trie, parts = learn(np.repeat(contexts, asked["histories_each"])[group], histories[group], words[trained], asked["counts"][trained])
        shard, data = int(rows["shard"].iloc[0]), trie.stored()
        trie = Trie.mapped(data)
        out = [(shard, None, None, None, None, None, data, *parts)]
        place, kinds = trie.context(contexts)
        place = np.repeat(place, asked["histories_each"])
        history = np.where(histories > 0, trie.history(place, histories), -1)
        weights = np.append(trie.weights, np.uint8(0))[history]
        place = np.repeat(place, words_each)
        follower = trie.follower(place, words)
        triples = trie.find_triple(place, np.repeat(history, words_each), follower)
        pairs = np.append(trie.codes, np.uint8(0))[follower]
        answers = (np.split(pairs, ends["words"]), np.split(triples, ends["words"]), np.split(weights, ends["histories"]), np.split(kinds, ends["contexts"]))
        for block, *of_block in zip(rows["block"], *answers):
            out.append((shard, block, *map(pack, of_block), *[None] * 7))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")]).astype({"block": "Int64"})

    asked = texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(ask, ASKED)
    answers = written(asked.groupBy("shard").applyInPandas(answer, ANSWERS), "answers")

    # The followers of a frequent context, and those of a spread history, are counted over all shards: at most SPREAD
    # and PAIR_SPREAD * PAIR_SPREAD sums.
    parts = answers.where("block IS NULL")
    by_context = parts.select(F.explode(F.arrays_zip("frequent", "followers")).alias("x")).groupBy("x.frequent").agg(F.sum("x.followers").alias("n"))
    kinds_often = {r.frequent: r.n for r in by_context.collect()}
    by_history = parts.select(F.explode(F.arrays_zip("contexts", "histories", "counts", "words")).alias("x"))
    by_history = by_history.groupBy("x.contexts", "x.histories").agg(F.sum("x.counts").alias("n"), F.sum("x.words").alias("kinds"))
    # Numbers of frequent words are below 2^32, as words are numbered by falling counts.
    sums = np.array(sorted((r.contexts << 32 | r.histories, r.n, r.kinds) for r in by_history.collect()), np.int64).reshape(-1, 3)

    def add_up(texts: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        block = Block.of(texts, others[others["pairs"].isna()])
        asks = block.entries(shards, n)
        answers = others[others["pairs"].notna()].sort_values("shard")
        pairs, triples, weights, kinds = [
            np.concatenate([unpack(x) for x in answers[c]] + [np.zeros(1, np.int64)]) for c in ("pairs", "triples", "weights", "kinds")
        ]  # a zero for tokens without an entry
        followers = np.zeros(len(block.numbers))
        followers[asks.context[asks.groups[asks.heads]]] = kinds[:-1]
        frequent = np.flatnonzero(is_frequent(block.counts, shards, n) & (block.numbers > 0))
        followers[frequent] = [kinds_often.get(x, 0) for x in block.numbers[frequent].tolist()]
        group = np.repeat(np.arange(len(asks.groups)), lengths(asks.groups, slice(None), len(asks.word)))
        weights = weights[np.append(group, len(asks.groups))][asks.triple]
        after, of = probability(triples)[asks.triple], np.where(weights > 0, probability(weights), 1.0)
        # Triples of spread histories are relative to the context.
        count = block.counts[block.context]
        spread = np.flatnonzero((block.history > 0) & (block.context > 0) & is_spread(count, block.counts[block.history], shards, n))
        if len(spread) and len(sums):
            key = block.numbers[block.context[spread]] << 32 | block.numbers[block.history[spread]]
            at = np.minimum(np.searchsorted(sums[:, 0], key), len(sums) - 1)
            met = sums[at, 0] == key
            spread, at = spread[met], at[met]
            after[spread] *= count[spread] / sums[at, 1]
            of[spread] = DISCOUNT * sums[at, 2] / sums[at, 1]
        own = block.counts[block.word]
        with np.errstate(divide="ignore", invalid="ignore"):
            single = np.where(block.word > 0, (1 - unknown) * own / max(n, 1), unknown if n else 1.0)
            # The weight of single words after a context; all of it after an unknown one.
            weight = np.where(block.context > 0, DISCOUNT * followers[block.context] / count, 1.0)
            total = np.log10(after + of * (probability(pairs)[asks.pair] + weight * single))
            base = np.log10((own + 1) / (n + v + 1))
        starts = np.concatenate(([0], np.cumsum(block.sizes)[:-1]))
        out = {
            "doc_id": pd.array(block.ids, "Int64"), "held_out": block.held, "n_tokens": block.sizes,
            "n_known": np.add.reduceat((block.word > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(total, starts),
        }
        return pd.DataFrame(out)

    answered = ("pairs", "triples", "weights", "kinds")
    given = words.select("block", "tokens", "counts", "numbers", F.lit(None).cast("int").alias("shard"), *[F.lit(None).cast("binary").alias(c) for c in answered])
    known = answers.where("block IS NOT NULL").select("block", *[F.lit(None).cast("binary").alias(c) for c in ("tokens", "counts", "numbers")], "shard", *answered)
    scored = texts.groupBy("block").cogroup(given.union(known).groupBy("block")).applyInPandas(add_up, SCORES)
    return scored.withColumn("train_tokens", F.lit(n).cast("bigint"))
