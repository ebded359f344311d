"""Embedding near-duplicates by sorted projection passes.

Each pass gives a vector a key of concatenated random hashes, the signs of its projections on random directions,
and orders all vectors by it; a vector is compared with the next WINDOW ones. Verified pairs of all passes are united
to components. How many links the passes find falls with the table's size and density, so it is measured: QUERIES
vectors are compared with all rows, and batches of passes with fresh directions follow until the components hold
RECALL of their links. The links that the measurement sees are kept, so up to QUERIES vectors the result is exact.
A component can be far larger than the windows, so its links are then counted as a whole: angles to
the component's mean direction prove most pairs by the triangle inequality, and those they don't prove are compared
in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import written
from jobtrail.llm.graph import components

COSINE = 0.95
PASSES, BITS, WINDOW = 16, 48, 24
# Vectors compared with all rows, and the share of their links that must lie in components.
QUERIES, RECALL = 4096, 0.99
# Angles to the mean are counted in steps of 1/STEPS radian; rows of a component compared at once.
STEPS = 2000
BLOCK = 512
_VECTOR = "array<double>"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit): valid vectors scaled to length 1, in double precision.

    Null, empty, zero vectors and those with null or non-finite components are left out; of rows that repeat a vec_id
    the one of smallest hash stays.
    """
    wide = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast(_VECTOR).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Scaled by the largest component first, as squares of large components overflow.
    top = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    scaled = wide.where(fine).withColumn("_top", top).where("_top > 0").select("vec_id", F.transform("v", lambda x: x / F.col("_top")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = scaled.withColumn("_length", length).select("vec_id", F.transform("v", lambda x: x / F.col("_length")).alias("unit"))
    return unit.groupBy("vec_id").agg(F.min_by("unit", F.xxhash64("unit")).alias("unit"))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in column]


def _keys(units: DataFrame, seed: int) -> DataFrame:
    """(pass, key, vec_id, unit): each vector once per pass; vectors of another length get other directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                vectors = _matrix(part.column("unit"))
                keys = np.empty((len(vectors), PASSES), np.int64)
                for size in {len(v) for v in vectors}:
                    if size not in directions:
                        directions[size] = np.random.default_rng([seed, size]).standard_normal((size, PASSES * BITS))
                    rows = [i for i, v in enumerate(vectors) if len(v) == size]
                    signs = np.stack([vectors[i] for i in rows]) @ directions[size] > 0
                    keys[rows] = signs.reshape(len(rows), PASSES, BITS) @ weights
                for p in range(PASSES):
                    columns = [pa.array([p] * len(keys), pa.int32()), pa.array(keys[:, p]), part.column("vec_id"), part.column("unit")]
                    yield pa.RecordBatch.from_arrays(columns, names=["pass", "key", "vec_id", "unit"])

    return units.select("vec_id", "unit").mapInArrow(run, f"pass int, key bigint, vec_id bigint, unit {_VECTOR}")


def _near(passes: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray], fresh: int = 0) -> tuple[list[int], list[int]]:
    """Pairs within WINDOW places, in the same pass, at COSINE or above; one of the two at ``fresh`` or later."""
    a, b = [], []
    if len({len(v) for v in vectors}) > 1:  # lengths are mixed: compare only equal ones
        for size in {len(v) for v in vectors}:
            rows = [i for i, v in enumerate(vectors) if len(v) == size]
            x, y = _near(passes[rows], ids[rows], [vectors[i] for i in rows])
            a, b = a + x, b + y
        return a, b
    m = np.stack(vectors)
    for d in range(1, min(WINDOW, len(m) - 1) + 1):
        low = max(0, fresh - d)
        close = np.einsum("ij,ij->i", m[low : len(m) - d], m[low + d :]) >= COSINE
        at = np.flatnonzero(close & (passes[low : len(m) - d] == passes[low + d :])) + low
        a += ids[at].tolist()
        b += ids[at + d].tolist()
    return a, b


def linked_pairs(units: DataFrame, seed: int = 0) -> DataFrame:
    """(a, b): the pairs that the passes find, each verified; a < b, once."""
    parts = max(2, 2 * units.sparkSession.sparkContext.defaultParallelism, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = _keys(units, seed).repartitionByRange(parts, "pass", "key", "vec_id").sortWithinPartitions("pass", "key", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs have border -1; the first and last WINDOW rows of a task go to the borders they touch.
        here, held, head = TaskContext.get().partitionId(), None, []

        def out(border, a, b, passes=None, places=None, vectors=None):
            n = len(a)
            columns = [
                pa.array([border] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                pa.array(passes if passes is not None else [None] * n, pa.int32()), pa.array(places if places is not None else [None] * n, pa.int32()),
                pa.array(vectors if vectors is not None else [None] * n, pa.list_(pa.float64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["border", "a", "b", "pass", "place", "unit"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (batch.column("pass").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("unit")))
            if len(head) < WINDOW:
                head += [(p, i, v) for p, i, v in list(zip(*rows))[: WINDOW - len(head)]]
            fresh = 0
            if held is not None:
                fresh = len(held[1])
                rows = (np.concatenate((held[0], rows[0])), np.concatenate((held[1], rows[1])), held[2] + rows[2])
            yield out(-1, *_near(*rows, fresh))
            held = tuple(r[-WINDOW:] for r in rows)
        if held is not None:
            p, i, v = zip(*head)
            yield out(here, list(i), [1] * len(i), list(p), list(range(len(i))), list(v))
            yield out(here + 1, held[1].tolist(), [0] * len(held[1]), held[0].tolist(), list(range(len(held[1]))), list(held[2]))

    found = written(keyed.mapInArrow(run, f"border int, a bigint, b bigint, pass int, place int, unit {_VECTOR}"), "windows")

    def at_border(rows):
        import pandas as pd

        rows = rows.sort_values(["b", "place"])  # the end of one task, then the start of the next
        a, b = _near(rows["pass"].to_numpy(), rows["a"].to_numpy(), [np.asarray(v) for v in rows["unit"]])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    borders = found.where("border >= 0").groupBy("border").applyInPandas(at_border, "a bigint, b bigint")  # 2 * WINDOW rows each
    pairs = found.where("border < 0").select("a", "b").union(borders).where("a <> b")
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _missed(units: DataFrame, parts: DataFrame) -> tuple[DataFrame, bool]:
    """(a, b): links of the query vectors that reach out of their components, one to each other component; and whether that is all.

    It is if every row is a query, or if RECALL of the links lie in components, for queries with 1 to 9 links, with 10 to
    99, and so on: else those of a large group would stand for the rest.
    """
    rows = units.join(parts, F.col("vec_id") == F.col("id"), "left").select("vec_id", "unit", F.coalesce("component", "vec_id").alias("component"))
    asked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(QUERIES).toArrow().combine_chunks()  # so many rows at most
    ids, groups = (asked.column(c).to_numpy() for c in ("vec_id", "component"))
    vectors = [v for chunk in asked.column("unit").chunks for v in _matrix(chunk)]
    at = {size: np.array([i for i, v in enumerate(vectors) if len(v) == size]) for size in {len(v) for v in vectors}}
    of_size = {size: np.stack([vectors[i] for i in places]) for size, places in at.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, found = np.zeros((2, len(ids)), np.int64)

        def out(a, b, n=None, within=None):
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            columns += [pa.array([None] * len(a) if v is None else v, pa.int64()) for v in (n, within)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "within"])

        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                mine, own = (part.column(c).to_numpy() for c in ("vec_id", "component"))
                here = _matrix(part.column("unit"))
                for size in at.keys() & {len(v) for v in here}:
                    i = np.array([i for i, v in enumerate(here) if len(v) == size])
                    j = at[size]
                    close = np.stack([here[k] for k in i]) @ of_size[size].T >= COSINE
                    close &= mine[i][:, None] != ids[j][None, :]
                    same = own[i][:, None] == groups[j][None, :]
                    there[j] += close.sum(axis=0)
                    found[j] += (close & same).sum(axis=0)
                    x, y = np.nonzero(close & ~same)
                    if len(x):
                        _, first = np.unique(np.stack((x, groups[j[y]])), axis=1, return_index=True)
                        yield out(mine[i[x[first]]], ids[j[y[first]]])
        some = np.flatnonzero(there)
        yield out(ids[some], [None] * len(some), there[some], found[some])

    seen = written(rows.mapInArrow(run, "a bigint, b bigint, n bigint, within bigint"), "queries")
    links = seen.where("n IS NULL").select("a", "b")
    by_query = seen.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"), F.sum("within").alias("within"))
    bands = by_query.groupBy(F.length(F.col("n").cast("string"))).agg(F.sum("n").alias("n"), F.sum("within").alias("within")).collect()
    return links, len(ids) < QUERIES or all(r.within >= RECALL * r.n for r in bands)


def _groups(units: DataFrame) -> DataFrame:
    """(id, component) of the linked vectors, from as many batches of passes as RECALL takes."""
    links, seed = linked_pairs(units), 0
    while True:
        parts = components(links)
        missed, enough = _missed(units, parts)
        if enough:
            return parts if missed.isEmpty() else components(links.union(missed))
        seed += 1
        links = written(links.union(linked_pairs(units, seed)).distinct(), "pairs")


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def count_links(members: DataFrame) -> DataFrame:
    """(vec_id, n_links): other members of the same component at COSINE or above, from (component, vec_id, unit)."""
    reach = math.acos(COSINE) - 1e-7
    mean = members.select("component", F.posexplode("unit").alias("_i", "_x")).groupBy("component", "_i").agg(F.avg("_x").alias("_x"))
    mean = mean.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias("mean"))
    length = F.sqrt(_dot(F.col("mean"), F.col("mean")))
    mean = mean.withColumn("_length", length)
    cosine = F.when(F.col("_length") > 1e-6, _dot(F.col("unit"), F.col("mean")) / F.col("_length")).otherwise(-1.0)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    rows = members.join(mean, "component").select("component", "vec_id", "unit", F.ceil((angle + 1e-9) * STEPS).cast("int").alias("step"))
    rows = written(rows.withColumn("sure", F.floor(F.lit(reach * STEPS) - F.col("step")).cast("int")), "angles")

    # At most pi * STEPS counts per component: how many members lie within each step.
    steps = rows.groupBy("component", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("component").orderBy("step")
    steps = steps.select("component", F.col("step").alias("_from"), F.sum("n").over(upto).alias("upto"), F.lead("step", 1, 1 << 30).over(upto).alias("_to"))
    wide = rows.groupBy("component").agg(F.max("step").alias("_high"), F.min("sure").alias("_sure"), F.count(F.lit(1)).alias("_n"))
    proven = rows.join(steps, "component").where((F.col("sure") >= F.col("_from")) & (F.col("sure") < F.col("_to")))
    proven = proven.select("vec_id", (F.col("upto") - F.when(F.col("step") <= F.col("sure"), 1).otherwise(0)).alias("n"))

    # Pairs that the angles don't prove: rows that reach too little, against rows that lie too far out.
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    open_rows = rows.join(wide.where("_high > _sure"), "component").withColumn("_mine", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = open_rows.where("sure < _high").select("component", "vec_id", "unit", "step", "sure", F.col("_mine").alias("x"), every.alias("y"), F.lit(0).alias("side"))
    right = open_rows.where("step > _sure").select("component", "vec_id", "unit", "step", "sure", every.alias("x"), F.col("_mine").alias("y"), F.lit(1).alias("side"))

    def block(rows):
        import pandas as pd

        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": []}, dtype="int64")
        ok = np.stack(left["unit"].to_list()) @ np.stack(right["unit"].to_list()).T >= COSINE
        ok &= right["step"].to_numpy()[None, :] > left["sure"].to_numpy()[:, None]
        ok &= right["vec_id"].to_numpy()[None, :] != left["vec_id"].to_numpy()[:, None]
        return pd.DataFrame({"vec_id": left["vec_id"].to_numpy(), "n": ok.sum(axis=1)}, dtype="int64")

    compared = left.union(right).groupBy("component", "x", "y").applyInPandas(block, "vec_id bigint, n bigint")
    return proven.union(compared).groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.

    Vectors that unit_vectors leaves out link with nothing and are components of their own; vectors of different
    lengths never link. Rows that repeat a vec_id give one row; a null vec_id gives one row without links.
    """
    units = written(unit_vectors(vectors), "units")
    parts = written(_groups(units), "parts")
    members = units.join(parts, F.col("vec_id") == F.col("id")).select("component", "vec_id", "unit")
    links = count_links(members)
    found = parts.join(links, F.col("id") == F.col("vec_id"), "left").select(F.col("id").alias("_id"), "component", "n_links")
    out = vectors.select("vec_id").distinct().join(found, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
