"""Row numbers in a sort order for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.session import ensure_checkpoint_dir


def rank_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    """Add the 1-based position of each row within its group.

    A window would bring a whole group into one task. Here the rows are range-partitioned by
    group and order, so a large group spans many tasks; each task numbers its own rows and adds
    what came before. ``order`` must be total. The partitioned rows are checkpointed because the
    two passes over them have to see the same range borders.
    """
    ensure_checkpoint_dir(df.sparkSession)
    groups = list(groups)
    keys = [F.col(g).asc() for g in groups] + list(order)
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .checkpoint()
    )
    cells = ranged.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *groups, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return (
        ranged.join(cells, [*groups, "_part"])
        .withColumn(rank, (F.col("_row") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, rank)
    )
