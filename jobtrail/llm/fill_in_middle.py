"""Fill-in-the-middle training texts: a text is cut in three and its middle moves to the end.

Where to cut and which form to take are Spark expressions on hashes of the document's id. Cutting and joining is a
pipeline of Arrow kernels over whole batches: the code points of the texts as a list array, flattened with the
row each belongs to, numbered within the row, filtered by role (prefix, middle, suffix), rebuilt into lists and joined.
The kernels see at most WINDOW bytes of text at a time, also of a single long text, so that their memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
SEED = "1:"
# Of a hundred hash values, those that stay plain and, of the others, those with the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
# Bytes of text whose code points are arrays at once: some 60 bytes of arrays a code point.
WINDOW = 1 << 20


def cut_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n, form, first, second): code points, form, and the ends of prefix and middle in code points."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    shown = docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n"), digest.alias("_digest"))
    h1, h2, h3, h4 = (F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("text").rlike(MARKS) | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return shown.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))


def _windows(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of UTF-8 bytes at code points, WINDOW bytes each."""
    begin = 0
    while begin < len(data):
        end = min(begin + WINDOW, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield begin, end
        begin = end


def three_parts(texts: pa.StringArray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its code points before ``first``, before ``second``, and the rest."""
    rows = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32, rows + 1, 4 * texts.offset).astype(np.int64)
    base, bounds = int(bounds[0]), bounds - bounds[0]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[base : base + int(bounds[-1])] if held and bounds[-1] else np.empty(0, np.uint8)
    cuts = pa.array(first, pa.int64()), pa.array(second, pa.int64())
    pieces: list[list[pa.Array]] = [[], [], []]
    counts = np.zeros(rows, np.int64)  # pieces of each row
    done = np.zeros(rows, np.int64)  # code points of each row before the window
    for begin, end in _windows(data):
        low = int(np.searchsorted(bounds, begin, "right")) - 1
        high = int(np.searchsorted(bounds, end, "left"))
        starts = begin + np.flatnonzero((data[begin:end] & 0xC0) != 0x80)
        ends = pa.py_buffer((np.append(starts, end) + base).astype(np.int32))
        units = pa.StringArray.from_buffers(len(starts), ends, held)
        offsets = np.searchsorted(starts, np.clip(bounds[low : high + 1], begin, end))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), units)

        parent = pc.list_parent_indices(lists)
        flat = pc.list_flatten(lists)
        ordinal = pc.add(pc.subtract(pa.array(np.arange(len(flat))), pc.take(pa.array(offsets[:-1]), parent)), pc.take(pa.array(done[low:high]), parent))
        before, until = (pc.less(ordinal, pc.take(c.slice(low, high - low), parent)) for c in cuts)
        role = pc.if_else(before, 0, pc.if_else(until, 1, 2))
        for k in range(3):
            mine = pc.equal(role, k)
            sizes = np.bincount(pc.filter(parent, mine).to_numpy(), minlength=high - low)
            rebuilt = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pc.filter(flat, mine))
            pieces[k].append(pc.binary_join(rebuilt, ""))
        counts[low:high] += 1
        done[low:high] += np.diff(offsets)
    spans = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    # Windows go on through the rows, so the pieces of a row are neighbours and in order.
    whole = [pa.concat_arrays(p) if p else pa.array([], pa.string()) for p in pieces]
    return [pc.binary_join(pa.ListArray.from_arrays(spans, w), "") for w in whole]


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row.

    Prefix ends after the smaller of two hash values modulo n + 1, middle after the larger. plain: the text as it is;
    psm: prefix, suffix, middle behind their marks; spm: suffix, prefix, middle. A text that is null, empty or holds a
    mark stays plain, and so does a share of the others by hash; prefix_chars and middle_chars are null then. A null
    doc_id counts as an empty one. Rows are independent: no shuffle, repeated rows give repeated results, columns besides
    doc_id and text are left out, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.string())
                form = part.column("form")
                prefix, middle, suffix = three_parts(texts, part.column("first").to_numpy(), part.column("second").to_numpy())
                psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
                spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
                output = pc.if_else(pc.equal(form, "psm"), psm, pc.if_else(pc.equal(form, "spm"), spm, texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), output], names=[*names, "output"])

    names = ["doc_id", "n", "form", "first", "second"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = cut_columns(docs).mapInArrow(run, f"doc_id {kind}, n bigint, form string, first bigint, second bigint, output string")
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.col("first")).alias("prefix_chars"),
        F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of. A moved text holds no mark, so the marks cut it in three."""
    parts = F.split(output, MARKS, -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """The transform's columns with digests of the output and of the text rebuilt from it."""
    return transform(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
  FROM documents
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR regexp_matches(text, '{MARKS}') OR h[3] % 100 >= {PLAIN_FROM} THEN 'plain'
      WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
