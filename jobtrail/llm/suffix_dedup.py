"""Repeated passages by sparse suffix arrays.

A passage of PASSAGE words that equals one at an earlier place (smaller doc_id, then position) is a later copy.
Of all suffixes only those are kept that start at a minimiser: in each PASSAGE words the run of ANCHOR words with the
smallest hash. Equal passages choose the same run, so both have a kept suffix at the same offset. The suffixes whose
first ANCHOR words occur once are left out; the others are sorted, neighbours are compared, and the match is extended
to the right and, in a second order by what stands before, to the left. Where both lengths add up to a passage,
all but its first occurrence are later copies. A suffix keeps the words of those passages only that chose it. Whole
texts that equal an earlier one need none of this and are left out first. An anchor that is very frequent is not
sorted in one task: its passages are hashed and reduced by hash instead, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import hashed, slices, texts_of, written

PASSAGE, ANCHOR = 50, 16
AROUND = PASSAGE - ANCHOR  # words kept on either side of an anchor
# Occurrences from which an anchor counts as very frequent, and suffixes that a task sorts at once.
FREQUENT = 1000
SORTED_ROWS = 60_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORDS_KEPT = 400_000


class WordHashes(dict):
    """A 64-bit hash of each word, kept for those met so far up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) < 64:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        words = text.encode().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words (a power of two takes few steps)."""
    out, have = words, 1
    while have < length:
        step = min(have, length - have)
        out = hashed(out[: len(out) - step] * np.uint64(3) ^ hashed(out[step:], 1), 2)
        have += step
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the minimisers, the hashes of their runs, and how many words before and after the run belong to
    passages that choose it."""
    if len(words) < PASSAGE:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int64),) * 2
    h = runs(words, ANCHOR)
    order = hashed(h, 11)
    starts = np.arange(len(order) - AROUND)
    chosen = np.lib.stride_tricks.sliding_window_view(order, AROUND + 1).argmin(axis=1) + starts
    at, first, n = np.unique(chosen, return_index=True, return_counts=True)
    return at, h[at].view(np.int64), at - first, first + n - 1 + AROUND - at


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): rows of equal doc_id and text are one document. Null ids are left out."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


TEXTS = "doc_id bigint, th bigint, same binary, n int, at array<int>, anchor array<bigint>, before array<int>, after array<int>"


def _kept_suffixes(docs: DataFrame) -> DataFrame:
    """TEXTS of each document: a digest of its words, their number, and its minimisers (see anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table, ints = WordHashes(), pa.list_(pa.int32())
        for batch in batches:
            for part in slices(batch, "text"):
                words = [table.of(t) for t in texts_of(part)]
                found = list(zip(*map(anchors, words)))
                columns = [
                    part.column(0), part.column(1), pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary()),
                    pa.array(map(len, words), pa.int32()), pa.array(list(found[0]), ints), pa.array(list(found[1]), pa.list_(pa.int64())),
                    pa.array(list(found[2]), ints), pa.array(list(found[3]), ints),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TEXTS.split(", ")])

    return _identified(docs).mapInArrow(run, TEXTS)


SUFFIX = "anchor bigint, doc_id bigint, th bigint, at int, before int, after int, context binary, passages array<bigint>, mask bigint"


def _suffixes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """SUFFIX of the places (doc_id, th, places array<struct<at, before, after, frequent>>) of each document.

    context holds the words before the anchor, nearest first, and those after it, as 32-bit hashes. For a frequent
    anchor passages holds the hashes of its passages instead, from the one that starts ``before`` words before it;
    those that the text held before are null there and set in mask.
    """
    names = [c.split()[0] for c in SUFFIX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = WordHashes(), []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, th, t, held in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text", "places"))):
                    words = table.of(t or "")
                    small = (words >> np.uint64(32)).astype("<u4")
                    h, seen = runs(words, ANCHOR).view(np.int64), set()
                    whole = runs(words, PASSAGE).view(np.int64) if any(p["frequent"] for p in held) else None
                    for p in sorted(held, key=lambda p: p["at"]):
                        at, before, after = p["at"], p["before"], p["after"]
                        head = (int(h[at]), doc_id, th, at, before, after)
                        if p["frequent"]:
                            mask, fresh = 0, []
                            for i, passage in enumerate(whole[at - before : at + after + ANCHOR - PASSAGE + 1].tolist()):
                                mask |= (passage in seen) << (before - i)
                                fresh.append(None if passage in seen else passage)
                                seen.add(passage)
                            rows.append((*head, None, fresh, mask))
                        else:
                            around = np.concatenate((small[at - before : at][::-1], small[at + ANCHOR : at + ANCHOR + after]))
                            rows.append((*head, around.tobytes(), None, 0))
                        if len(rows) >= 20_000:
                            yield flush()
                            rows.clear()
        if rows:
            yield flush()

    joined = _identified(docs).join(places, ["doc_id", "th"]).select("doc_id", "th", "text", "places")
    return joined.mapInArrow(run, SUFFIX)


def _classes(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each row and each length 0 .. AROUND, the class of rows with the same anchor and as many equal words.

    The rows are sorted by anchor and words; equal lengths of neighbours bound the classes.
    """
    text = np.empty((len(anchor), AROUND + 2), ">u4")
    text[:, 0], text[:, 1] = anchor >> np.uint64(32), anchor & np.uint64(0xFFFFFFFF)
    text[:, 2:] = side
    order = np.argsort(text.view(f"S{4 * (AROUND + 2)}").ravel(), kind="stable")
    ranked = text[order]
    equal = ranked[1:] == ranked[:-1]
    common = np.cumprod(equal, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64) - 2  # below 0: another anchor
    common = np.concatenate(([-1], common))
    out = np.empty((AROUND + 1, len(anchor)), np.int64)
    for length in range(AROUND + 1):
        out[length, order] = np.cumsum(common < length)
    return out


def later_copies(anchor: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A bit mask per row: bit a is set if the passage that starts a words before the anchor is a later copy."""
    rows = np.lexsort((at, th, doc))
    anchor, doc, th, at, before, after, context = (v[rows] for v in (anchor, doc, th, at, before, after, context))
    left, right = _classes(anchor, context[:, 0]), _classes(anchor, context[:, 1])
    mask = np.zeros(len(rows), np.int64)
    for a in range(AROUND + 1):
        has = np.flatnonzero((before >= a) & (after >= AROUND - a))
        if len(has) < 2:
            continue
        code = left[a, has] * (len(rows) + 1) + right[AROUND - a, has]
        order = np.argsort(code, kind="stable")  # rows stay in the order of the documents
        ranked = code[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        first = has[order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]]
        mine = has[order]
        later = (doc[first] != doc[mine]) | (th[first] != th[mine]) | (at[first] != at[mine])
        mask[mine[later]] |= 1 << a
    out = np.empty(len(rows), np.int64)
    out[rows] = mask
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by anchor as tables of SORTED_ROWS rows or so that no anchor is split over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SORTED_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("anchor").to_numpy()
            change = np.flatnonzero(keys[1:] != keys[:-1])
            if len(change):
                yield table.slice(0, change[-1] + 1)
                held = table.slice(change[-1] + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sorted_copies(suffixes: DataFrame) -> DataFrame:
    """(doc_id, th, at, mask) of the suffixes with later copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(b for b in batches if b.num_rows):
            v = {c: table.column(c).to_numpy() for c in ("anchor", "doc_id", "th", "at", "before", "after")}
            flat = np.append(np.frombuffer(b"".join(table.column("context").to_pylist()), "<u4"), np.zeros(AROUND, "<u4"))
            size = np.stack((v["before"], v["after"]), axis=1).astype(np.int64)
            first = np.cumsum(size.ravel()).reshape(-1, 2) - size
            inside = np.arange(AROUND) < size[:, :, None]
            context = np.where(inside, flat[np.minimum(first[:, :, None] + np.arange(AROUND), len(flat) - 1)], 0)
            mask = later_copies(v["anchor"].view(np.uint64), v["doc_id"], v["th"], v["at"], v["before"], v["after"], context)
            some = mask != 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (v["doc_id"], v["th"], v["at"], mask)], names=["doc_id", "th", "at", "mask"])

    rows = suffixes.where("context IS NOT NULL").select("anchor", "doc_id", "th", "at", "before", "after", "context")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id bigint, th bigint, at int, mask bigint")


def _hashed_copies(suffixes: DataFrame) -> DataFrame:
    """The same for frequent anchors: passages reduced by hash, each with the place of its first occurrence."""
    frequent = suffixes.where("passages IS NOT NULL")
    rows = frequent.select("doc_id", "th", (F.col("at") - F.col("before")).alias("_from"), F.posexplode("passages").alias("_i", "passage")).where("passage IS NOT NULL")
    place = F.struct("doc_id", "th", (F.col("_from") + F.col("_i")).alias("at"))
    rows = rows.select("passage", place.alias("place"))
    first = rows.groupBy("passage").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("passage", "first")
    later = rows.join(first, "passage").where("place <> first").select("place.*").withColumn("mask", F.lit(1).cast("bigint"))
    return later.unionByName(frequent.where("mask <> 0").select("doc_id", "th", "at", "mask"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans): runs of words (first, last; from 0) that lie in passages equal to earlier ones.

    Only documents with such runs are returned; th is xxhash64 of the text. Null and short texts have none. Earlier
    means a smaller doc_id, then text hash, then position, so the first occurrence of a passage stays.
    """
    texts = written(_kept_suffixes(docs), "texts").where(F.col("n") >= PASSAGE)
    first = texts.groupBy("same").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    texts = texts.join(first, "same").withColumn("copy", F.struct("doc_id", "th") != F.col("first"))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last")))
    copies = texts.where("copy").select("doc_id", "th", whole.alias("spans"))
    zipped = F.arrays_zip("at", "anchor", "before", "after")
    rows = written(texts.where("NOT copy").select("doc_id", "th", F.explode(zipped).alias("s")).select("doc_id", "th", "s.*"), "anchors")
    repeated = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.struct("at", "before", "after", (F.col("n") > FREQUENT).alias("frequent"))
    places = rows.join(repeated, "anchor").groupBy("doc_id", "th").agg(F.collect_set(place).alias("places"))
    suffixes = written(_suffixes(docs, places), "suffixes")
    found = _sorted_copies(suffixes).unionByName(_hashed_copies(suffixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(p["at"], p["mask"]) for p in held]) for held in batch.column("found").to_pylist()]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind)], names=["doc_id", "th", "spans"])

    per_doc = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("found"))  # at most the text's words
    found = per_doc.select("doc_id", "th", "found").mapInArrow(run, "doc_id bigint, th bigint, spans array<struct<first:int,last:int>>")
    return found.unionByName(copies.distinct())


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The words covered by the passages of (anchor, mask), as runs."""
    starts = sorted({at - a for at, mask in found for a in range(AROUND + 1) if mask >> a & 1})
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], s + PASSAGE - 1)
        else:
            out.append((s, s + PASSAGE - 1))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the runs of words, each with the white space after it."""
    data = text.encode()
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(data[at : starts[first]])
        at = starts[last + 1]
    return b"".join([*kept, data[at:]]).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with later copies of passages cut from their texts, with all their columns.

    A document of which no word is left goes; n_chars, where there is one, follows the text.
    """
    spans = repeated_spans(docs).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    names = docs.columns
    both = docs.join(spans, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left").select(*names, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for part in slices(batch, "text"):
                texts, keep = [], []
                for t, s in zip(part.column(at).to_pylist(), part.column("_spans").to_pylist()):
                    new = t if s is None else cut(t, [(p["first"], p["last"]) for p in s])
                    texts.append(new)
                    keep.append(s is None or bool(new.split()))
                columns = [part.column(i) if i != at else pa.array(texts, part.schema.field(at).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = both.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, spans) of every document; a document without later copies has no spans."""
    found = repeated_spans(docs).groupBy("doc_id").agg(F.max("spans").alias("spans"))
    counted = found.select("doc_id", "spans", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1).alias("n_removed"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    none = F.expr("array()").cast("array<struct<first:int,last:int>>")
    return ids.join(counted, "doc_id", "left").select("doc_id", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", none).alias("spans"))
