"""Near-duplicate texts by order MinHash, verified by banded alignment.

The k-mers of a text are its runs of five words, each labelled with how often it occurred before. A sketch takes,
under one hash function, the smallest few labelled k-mers and keeps them in the order of the text: texts share it
if they are alike in content and in order. Texts that share any of their sketches meet in a bucket.

In a bucket each text is compared with the most central one (a star, not all pairs), and so are those that this leaves
outside the largest group, while it pays. What is left between groups is compared in blocks that hold the texts
themselves: an index of their k-mers names the texts that share enough, and only links that join groups leave a block.
Every link is verified: the longest common subsequence of the two k-mer sequences within a band, as a share of all
their k-mers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import hashed, slices, texts_of, written
from jobtrail.llm.graph import components

K = 5
SIMILAR = 0.8
# Sketches per text and k-mers per sketch: texts of similarity 0.8 share no sketch once in 100,000 times.
SKETCHES, PICKED = 16, 3
# K-mers of a block: a bucket of more is compared block by block.
BLOCK = 500_000
WORDS_KEPT = 400_000
# K-mers after which the window of an alignment moves on, and places of a k-mer that are set bit by bit.
STEPS, FEW = 1024, 8


class WordHashes(dict):
    """A 64-bit hash of each word, kept for those met so far up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) < 64:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text is one run. Text without words has none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = hashed(out ^ words[i : len(words) - k + 1 + i], i)
    return out


def labelled(values: np.ndarray) -> np.ndarray:
    """Each k-mer with its occurrence number mixed in: copies of a k-mer differ."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    seen = np.empty(len(values), np.uint64)
    seen[order] = (np.arange(len(values)) - starts).astype(np.uint64)
    return values if first.all() else hashed(values ^ (seen << np.uint64(32)), 77)


def sketches(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per sketch of a text's labelled k-mers."""
    count = min(PICKED, len(values))
    seeds = hashed(np.arange(SKETCHES, dtype=np.uint64), 100)
    h = hashed(values[None, :] ^ seeds[:, None], 7)
    picked = np.sort(np.argpartition(h, count - 1, axis=1)[:, :count], axis=1)  # in the order of the text
    chosen = np.take_along_axis(h, picked, axis=1)
    keys = seeds
    for i in range(count):
        keys = hashed(keys ^ chosen[:, i], 5)
    return keys


FEATURES = "doc_id bigint, same string, n_kmers bigint, keys array<bigint>"
WORDS = "doc_id bigint, same string, words binary"


def _per_text(docs: DataFrame, schema: str, row: Callable[[np.ndarray], tuple]) -> DataFrame:
    """doc_id, same, and the columns that ``row`` makes of a text's word hashes; nulls where a text has no words.

    same is equal for texts of equal words.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"same": pa.string(), "n_kmers": pa.int64(), "keys": pa.list_(pa.int64()), "words": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for t in texts_of(part):
                    words = table.of(t)
                    rows.append((xxhash.xxh3_128_hexdigest(words.tobytes()), *row(words)) if len(words) else (None,) * (len(names) - 1))
                columns = [pa.array(list(c), kinds[n]) for c, n in zip(zip(*rows), names[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of each row: the number of its k-mers and a key per sketch."""

    def row(words: np.ndarray) -> tuple:
        values = labelled(kmers(words))
        return len(values), sketches(values).view(np.int64)

    return _per_text(docs, FEATURES, row)


def packed_words(docs: DataFrame) -> DataFrame:
    """WORDS of each row: 32-bit hashes of its words, in order."""
    return _per_text(docs, WORDS, lambda words: ((words >> np.uint64(32)).astype("<u4").tobytes(),))


def _kmers_of(packed: pa.BinaryScalar) -> np.ndarray:
    return kmers(np.frombuffer(packed.as_buffer(), "<u4").astype(np.uint64))


def similarity(a: np.ndarray, b: np.ndarray, band: int) -> float:
    """Common k-mers in order, within the band, as a share of all k-mers of both texts.

    Bit-parallel longest common subsequence: the bit of k-mer j of a is 0 where it ends a longer match. Only the bits
    within the band are held, so memory grows with the texts and not with their square.
    """
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - (short - head) :][::-1] != b[len(b) - (short - head) :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    common = head + tail
    if len(x) and len(y):
        order = np.argsort(x, kind="stable")  # the places of each k-mer, in rising order
        starts, ends = (np.searchsorted(x[order], y, side).tolist() for side in ("left", "right"))
        # The state holds the bits of the window of the next STEPS k-mers of b. Bits below it are final, those above it 1.
        full = (1 << (2 * band + 1 + STEPS)) - 1
        base, state = -band, full
        for i, (start, end) in enumerate(zip(starts, ends)):
            if i - band - base >= STEPS:
                common += STEPS - (state & (1 << STEPS) - 1).bit_count()
                state = state >> STEPS | full ^ full >> STEPS
                base += STEPS
            if start == end:
                continue
            places = order[start:end]
            if end - start > 1:
                places = places[np.searchsorted(places, i - band) : np.searchsorted(places, i + band, "right")]
            elif abs(int(places[0]) - i) > band:
                continue
            if len(places) > FEW:
                bits = np.zeros(int(places[-1]) - base + 1, np.uint8)
                bits[places - base] = 1
                met = state & int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            else:
                met = 0
                for j in places.tolist():
                    met |= 1 << j - base
                met &= state
            if met:
                state = (state + met | state - met) & full
        common += full.bit_length() - state.bit_count()
    return common / (len(a) + len(b) - common)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    # What is similar enough differs by a fifth of its k-mers at most, and so no match lies farther off.
    band = max(len(x), len(y)) // 4 + K
    return min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)) and similarity(x, y, band) >= SIMILAR


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, doc_id) whose texts are similar, as links (a, b).

    The words of a text travel with its pair to the hub; those of the hub are sent once.
    """
    words = texts.select("doc_id", "words")
    both = pairs.join(words, "doc_id").join(words.select(F.col("doc_id").alias("hub"), F.col("words").alias("hub_words")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for h, x, y in zip(batch.column("a").to_pylist(), batch.column("hub_words"), batch.column("words")):
                if h != last:
                    last, hub = h, _kmers_of(x)
                keep.append(_alike(hub, _kmers_of(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "hub_words", "words").mapInArrow(run, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of equal keys from batches sorted by them; a group may reach over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(c).to_numpy() for c in by]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        ends = change.tolist()
        for start, end in zip([0, *ends[:-1]], ends):
            yield {c: table.column(c).slice(start, end - start) for c in table.column_names}
        held = table.slice(ends[-1] if ends else 0).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield {c: table.column(c) for c in table.column_names}


def _in_parts(places: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The places of buckets that hold several parts, with part and main, the part of most rows of the bucket.

    Before there are parts each text is one, and none is main.
    """
    if parts is None:
        return places.withColumns({"part": F.col("doc_id"), "main": F.lit(None).cast("bigint")})
    labels = parts.select(F.col("id").alias("doc_id"), "component")
    now = places.join(labels, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    counts = now.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return now.join(main, "bucket")


def _to_hubs(apart: DataFrame) -> DataFrame:
    """(hub, doc_id): in each bucket each row outside the main part with the most central of those rows."""
    rest = apart.where("main IS NULL OR part <> main")
    hub = rest.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "part"), F.struct("central", -F.col("doc_id"))).alias("hub"))
    met = rest.join(hub, "bucket").where(F.col("part") != F.col("hub.part"))
    return met.select(F.col("hub.doc_id").alias("hub"), "doc_id").distinct()


def _between_parts(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join parts: each pair of different parts, not both main, in the first bucket that it shares.

    A bucket is cut into blocks of about BLOCK k-mers, by a hash; each block of rows outside the main part meets every
    block. In a pair of blocks an index of the labelled k-mers gives the exact number that two texts share; pairs that
    share enough are aligned, the most alike first, unless links found before already join their parts. So a task
    gives fewer links than it has parts.
    """
    minor = (F.col("part") != F.col("main")).cast("int")
    blocks = F.ceil(F.sum("n_kmers") / BLOCK).cast("int")
    cut = apart.groupBy("bucket", minor.alias("minor")).agg(blocks.alias("n"))
    cut = cut.groupBy("bucket").agg(F.max(F.when(F.col("minor") == 0, F.col("n"))).alias("_mains"), F.max(F.when(F.col("minor") == 1, F.col("n"))).alias("_minors"))
    # Blocks of the main part have numbers below 0. x is a block outside the main part, y the same, a later one, or one of the main part.
    own = F.pmod(F.xxhash64("doc_id"), F.when(minor == 1, F.col("_minors")).otherwise(F.col("_mains"))).cast("int")
    rows = apart.join(cut, "bucket").withColumn("mine", F.when(minor == 1, own).otherwise(-1 - own))
    minors = F.sequence(F.lit(0), F.col("_minors") - 1)
    mains = F.transform(F.sequence(F.lit(1), F.col("_mains")), lambda b: -b)
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    met = F.when(minor == 0, F.transform(minors, lambda b: pair(b, F.col("mine")))).otherwise(
        F.concat(
            F.transform(mains, lambda b: pair(F.col("mine"), b)),
            F.transform(minors, lambda b: pair(F.least("mine", b), F.greatest("mine", b))),
        )
    )
    spread = rows.select("bucket", "doc_id", "part", "mine", F.explode(met).alias("_met")).select("bucket", "_met.x", "_met.y", "mine", "doc_id", "part")
    spread = spread.join(texts.select("doc_id", "keys", "words"), "doc_id").select("bucket", "x", "y", "mine", "doc_id", "part", "keys", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "x", "y"]):
            x, y = group["x"][0].as_py(), group["y"][0].as_py()
            ids, parts, mine = (group[c].to_numpy() for c in ("doc_id", "part", "mine"))
            keys = np.stack(group["keys"].to_pylist())
            values = [_kmers_of(w) for w in group["words"].combine_chunks()]
            a, b = _links(ids, parts, keys, values, group["bucket"][0].as_py(), mine == x, mine == y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return spread.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _links(ids, parts, keys, values, bucket, left, right) -> tuple[list[int], list[int]]:
    """Links between rows of left and of right that join parts; see _between_parts."""
    marked = [labelled(v) for v in values]
    sizes = np.array([len(v) for v in values])
    flat, owner = np.concatenate(marked), np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    joined: dict[int, int] = {}

    def root(part: int) -> int:
        while part in joined:
            part = joined[part]
        return part

    a, b = [], []
    for i in np.flatnonzero(left).tolist():
        starts, ends = (np.searchsorted(flat, marked[i], side) for side in ("left", "right"))
        lengths = ends - starts
        places = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[places], minlength=len(ids))
        ok = right & (parts != parts[i]) & (shared >= SIMILAR * (sizes[i] + sizes - shared) - 1e-9)
        if right[i]:  # a block with itself
            ok[:i] = False
        found = np.flatnonzero(ok)
        if not len(found):
            continue
        same = keys[found] == keys[i]
        found = found[same.any(axis=1) & (keys[i][same.argmax(axis=1)] == bucket)]
        likeness = shared[found] / (sizes[i] + sizes[found] - shared[found])
        for j in found[np.argsort(-likeness, kind="stable")].tolist():
            mine, other = root(int(parts[i])), root(int(parts[j]))
            if mine != other and _alike(values[i], values[j]):
                joined[max(mine, other)] = min(mine, other)
                a.append(min(int(ids[i]), int(ids[j])))
                b.append(max(int(ids[i]), int(ids[j])))
    return a, b


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, exact_id) of each document: class_id is the smallest doc_id of its near-duplicate class.

    A class is a connected component of pairs with similarity SIMILAR or more; exact_id is the smallest doc_id with
    the same words (A-Z as a-z). Texts without words (null, empty) form no class with others. Rows that repeat a
    doc_id count as one document, the one of smallest text hash; rows with a null doc_id are left out.
    """
    once = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    rows = written(features(once), "features")
    repeated = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if repeated:
        least = rows.groupBy("doc_id").agg(F.min(F.coalesce("same", F.lit(""))).alias("_least"))
        rows = rows.join(least, "doc_id").where(F.coalesce("same", F.lit("")) == F.col("_least")).drop("_least")
        rows = written(rows.dropDuplicates(["doc_id"]), "features")
    exact = written(rows.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("exact_id")), "exact")
    first = rows.join(exact.select(F.col("exact_id").alias("doc_id")), "doc_id", "left_semi")

    # Keys that two texts share, and the texts that hold one. A text whose buckets are large is alike to many.
    held = written(first.select("doc_id", "n_kmers", F.explode("keys").alias("bucket")), "held")
    shared = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    places = written(held.join(shared, "bucket"), "places")
    central = places.groupBy("doc_id").agg(F.sum("size").alias("central"))
    places = written(places.drop("size").join(central, "doc_id"), "places")
    met = first.join(places.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "same", "keys")
    again = once.join(met.select("doc_id"), "doc_id", "left_semi")
    texts = packed_words(again).join(met, ["doc_id", "same"]).select("doc_id", "keys", "words")
    texts = written(texts.dropDuplicates(["doc_id"]) if repeated else texts, "texts")

    links, parts = None, None
    while True:
        pairs = written(_to_hubs(_in_parts(places, parts)), "pairs")
        found = written(_verified(pairs, texts), "links")
        links = found if links is None else written(links.union(found), "links")
        parts = components(links)
        # Another round pays while many of the rows it compares find their hub; what is left is compared exactly.
        if found.count() * 4 < pairs.count() or pairs.isEmpty():
            break
    more = written(_between_parts(written(_in_parts(places, parts), "apart"), texts), "links")
    parts = components(links.union(more))
    classes = exact.join(parts, exact.exact_id == parts.id, "left").select("same", "exact_id", F.coalesce("component", "exact_id").alias("class_id"))
    return rows.select("doc_id", "same").join(classes, "same", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("exact_id", "doc_id").alias("exact_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without the later members of each class, with all their columns; null doc_ids stay."""
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
