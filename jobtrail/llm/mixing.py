"""Mix sources to target weights with hash-threshold histograms; DataFrame functions only.

A source whose target is r times its size is taken floor(r) times as a whole, and once more where a document's hash
lies below a threshold. The threshold is found from histograms of words by source and hash bucket: the bucket in
which the budget ends is refined into finer buckets until one hash value is left, and no rows are ever sorted.
What the last document did not fit is offered again to smaller ones, with a threshold of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import SPACE, written
from jobtrail.operators.ranking import rank_rows

WEIGHTS = (1, 2, 3)
MOST = 3  # times its size that a source, and a document, is taken at most
HASH_BITS, LEVEL_BITS = 60, 12
# Thresholds per source: each leaves less than the smallest document it could not fit. The first FRESH give a document
# one copy beyond those of the whole source at most, the others as many as MOST allows.
PASSES, FRESH = 4, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^"))), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, h): see word_count and _hash."""
    return docs.select(F.col(key).alias(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _hash(F.col(key)).alias("h"))


def _hash(key: Column) -> Column:
    """HASH_BITS bits of a hash of the key; a null key counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, target): the words each source should give.

    Sources in order of their names (code points, null last) weigh ``weights``, repeating, and share ``share`` times
    all words. A target stops at ``most`` times its source; the excess goes to the others by weight, until none is
    above. Each round is one sum over the sources.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_rows(per_source, [], [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    ranked = written(ranked.withColumn("weight", weight), "sources")
    wide = lambda c: c.cast("decimal(19,0)")
    full = F.col("source_size") * most
    budget = ranked.agg(F.sum("source_size").alias("n")).first().n or 0
    budget = budget if share == 1.0 else int(budget * share)
    left, open_weight, capped = budget, None, F.lit(False)
    while True:
        held = ranked.agg(F.sum(F.when(capped, full)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        now = (budget - (held.full or 0), held.weight or 0)
        if now == (left, open_weight):
            break
        left, open_weight = now
        if not open_weight:
            break
        capped = wide(F.col("weight")) * wide(F.lit(left)) > wide(full) * wide(F.lit(open_weight))
    share_of = (F.col("weight") * left).cast("double") / F.lit(float(max(1, open_weight or 0)))
    return ranked.select("source", "source_size", F.when(capped, full.cast("double")).otherwise(share_of).alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below, got): the largest hash so that the rows below it hold no more words than the budget.

    rows (source, size, h), budgets (source, budget). Level by level only the rows of the boundary bucket are read
    on, until it holds one hash value only; the state, a row per source, is written after each level.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("got"), F.lit(True).alias("open"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    for done in range(0, HASH_BITS, LEVEL_BITS):
        rest = HASH_BITS - done - LEVEL_BITS
        boundary = state.where("open").select(F.col("source").alias("_source"), "budget", "got", F.shiftright("below", rest + LEVEL_BITS).alias("_prefix"))
        inside = rows.join(boundary, same).where(F.shiftright("h", rest + LEVEL_BITS) == F.col("_prefix"))
        sums = [F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("budget").alias("budget"), F.first("got").alias("got")]
        histogram = inside.groupBy("source", F.shiftright("h", rest).alias("bucket")).agg(*sums)
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) + F.col("got")  # 2^LEVEL_BITS buckets at most
        over = F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("got"), "low", "high"))
        found = histogram.withColumn("upto", upto).groupBy(F.col("source").alias("_source")).agg(F.min(over).alias("edge"), F.max("upto").alias("all"))
        edge, still = F.col("edge").isNotNull(), F.col("open")
        refine = F.col("edge.low") < F.col("edge.high")
        start = F.when(refine, F.shiftleft(F.col("edge.bucket"), rest)).otherwise(F.col("edge.low"))
        state = written(
            state.join(found, same, "left").select(
                "source",
                "budget",
                # No bucket goes over the budget: all rows fit.
                F.when(still, F.when(edge, start).otherwise(F.lit(1 << HASH_BITS))).otherwise(F.col("below")).alias("below"),
                F.when(still, F.coalesce(F.when(edge, F.col("edge.got")).otherwise(F.col("all")), F.lit(0))).otherwise(F.col("got")).alias("got"),
                (still & edge & refine).alias("open"),
            ),
            "state",
        )
        if state.where("open").isEmpty():
            break
    return state.select("source", "below", "got")


def _fitted(rows: DataFrame, weights: Sequence[int]) -> DataFrame:
    """A row per source: source_size, target, copies of the whole source, and (gap, below) of each pass."""
    sources = written(source_targets(rows, weights), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = sources.withColumn("copies", whole.cast("bigint")).withColumn("gap", F.col("target") - F.col("copies") * F.col("source_size"))
    for step in range(PASSES):
        free = _with_plan(rows, plan).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (_extra(step) < _limit(step)))
        found = _threshold(free.select("source", "size", "h"), plan.select("source", F.col("gap").alias("budget")))
        found = found.select(F.col("source").alias("_of"), F.col("below").alias(f"below{step}"), "got")
        plan = plan.join(found, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
        plan = written(plan.withColumn(f"gap{step}", F.col("gap")).withColumn("gap", F.col("gap") - F.col("got")).drop("got"), "plan")
    return plan


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    renamed = plan.withColumnRenamed("source", "_of")
    return rows.join(renamed, rows["source"].eqNullSafe(renamed["_of"]))


def _limit(step: int) -> Column:
    return F.lit(1) if step < FRESH else F.lit(MOST) - F.col("copies")


def _extra(passes: int) -> Column:
    """How often a document of (size, h) is taken beyond the copies of its whole source."""
    taken = F.lit(0)
    for step in range(passes):
        fits = (F.col("size") <= F.col(f"gap{step}")) & (F.col("h") < F.col(f"below{step}")) & (taken < _limit(step))
        taken = taken + F.when(fits, 1).otherwise(0)
    return taken


def _taken() -> Column:
    return F.col("size") * (F.col("copies") + _extra(PASSES))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(key, size, source_size, target, taken) of each row: taken is size times the copies the mix takes.

    A null text has size 0 and is taken 0 words; a null source is a source of its own, the last. Rows that repeat a
    key share its hash, so their last copies are taken together or not. A source of size 0 has target 0. Reruns agree.
    """
    rows = written(sized(docs, key, source, text), "sizes")
    return _with_plan(rows, _fitted(rows, weights)).select(key, "size", "source_size", "target", _taken().alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The documents (doc_id, source, text and others) as often as the mix takes them; texts without words go.

    The texts are not shuffled: each meets its source's row of the plan.
    """
    plan = _fitted(written(sized(docs), "sizes"), weights)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source", word_count(F.col("text")).alias("size"), _hash(F.col("doc_id")).alias("h"))
    times = F.when(F.col("size") > 0, (_taken() / F.col("size")).cast("int")).otherwise(0)
    return _with_plan(rows, plan).select("_row", times.alias("_times")).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")


def _pass_sql(step: int) -> str:
    return f"""
    f{step} AS (
      SELECT r.*, g.gap{step}, r.size > 0 AND r.size <= g.gap{step} AND r.extra < {"1" if step < FRESH else f"{MOST} - r.copies"} AS free
      FROM r{step} r JOIN g{step} g ON r.source IS NOT DISTINCT FROM g.source
    ),
    e{step} AS (
      SELECT * EXCLUDE (gap{step}),
             free AND sum(CASE WHEN free THEN size ELSE 0 END)
               OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) <= gap{step} AS took
      FROM f{step}
    ),
    g{step + 1} AS (
      SELECT g.source, g.gap{step} - coalesce(x.n, 0) AS gap{step + 1}
      FROM g{step} g LEFT JOIN (SELECT source, sum(size) AS n FROM e{step} WHERE took GROUP BY source) x
        ON g.source IS NOT DISTINCT FROM x.source
    ),
    r{step + 1} AS (SELECT * EXCLUDE (took, free, extra), extra + took::INT AS extra FROM e{step})"""


def _oracle() -> str:
    passes = ",".join(map(_pass_sql, range(PASSES)))
    return rf"""
WITH sizes AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h
      FROM documents
    ),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
      FROM sizes GROUP BY source
    ),
    filled AS (
      SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_words,
             sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
      FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    capped AS (SELECT *, weight * left_words > 3 * source_size * left_weight AS full_up FROM filled),
    rest AS (
      SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (full_up), 0) AS words,
             sum(weight) FILTER (NOT full_up) AS weight FROM capped
    ),
    goals AS (
      SELECT source, source_size,
             CASE WHEN full_up THEN (3 * source_size)::DOUBLE ELSE (c.weight * rest.words)::DOUBLE / rest.weight::DOUBLE END AS target
      FROM capped c, rest
    ),
    r0 AS (
      SELECT sizes.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies, 0 AS extra
      FROM sizes JOIN goals ON sizes.source IS NOT DISTINCT FROM goals.source
    ),
    g0 AS (SELECT DISTINCT source, target - copies * source_size AS gap0 FROM r0),
    {passes}
SELECT doc_id, size, source_size, target, size * (copies + extra) AS taken FROM r{PASSES}
"""


ORACLE_SQL = _oracle()
