"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import written

# Most groups are stars or nearly so and need two or three plain rounds.
JUMP_AFTER = 3


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in links (a, b).

    Each round a node takes the smallest label among its neighbours and itself; after JUMP_AFTER rounds also the label
    of that label, so that labels travel along a chain in growing steps. Rounds go on until no label changes. Links and labels are written
    each round: a lost executor costs one round. Hot nodes are reduced before they are shuffled.
    """
    pairs = links.select("a", "b").where("a <> b").distinct()
    both = written(pairs.union(pairs.select("b", "a")), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    rounds = 0
    while True:
        lower = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("_id")).agg(F.min("label").alias("_low"))
        step = labels.join(lower, F.col("id") == F.col("_id")).select("id", F.col("label").alias("old"), F.least("label", "_low").alias("label"))
        if rounds >= JUMP_AFTER:
            ahead = labels.select(F.col("id").alias("_at"), F.col("label").alias("_next"))
            step = step.join(ahead, F.col("label") == F.col("_at"), "left").select("id", "old", F.least("label", F.coalesce("_next", "label")).alias("label"))
        step = written(step, "labels")
        labels, rounds = step.select("id", "label"), rounds + 1
        if step.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
