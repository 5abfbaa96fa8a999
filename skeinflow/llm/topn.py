"""The N best rows of every group by partition lower bounds.

Within a part of the rows, the N-th best row of a group is a lower bound of the group's overall N-th best: at least N rows are
as good. Rows are ranked within (part, group), the best bound of all parts is joined to each group, rows under the bound are
dropped before anything is shuffled by group, and only the survivors of a group, few more than N of them, are ranked together.
No task ever holds a whole large group. Bounds are whole sort keys, so a group of equal scores is cut as sharply as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, group: str, score: str, ties: list[Column], n: int = 10, part: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``score`` descending, then by ``ties`` ascending.

    Rows whose score is null or not a number never count; a null group is a group of its own; a null tie comes first. ``ties``
    should end with a unique column: rows that are equal in all of it are interchangeable. Fewer than ``n`` rows in a group are
    all kept, an empty input gives an empty result, repeated rows count as often as they occur. Columns stay as they are.

    ``part`` names a column that the rows are partitioned by already (see ``parted``), so that ranking within parts needs no
    exchange of its own; without it the partitions the rows lie in are the parts, and each sends at most ``n`` rows of a group.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = rows.columns
    # Longer than any column's name, so none of them is one.
    own, place, key, bound, of = (f"_{x}_" + "_" * max(map(len, names)) for x in ("part", "place", "key", "bound", "group"))
    usable = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    usable = usable.withColumn(own, F.col(part) if part else F.spark_partition_id()).withColumn(key, F.struct((F.lit(0) - F.col(score)).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(ties)]))
    local = usable.withColumn(place, F.row_number().over(Window.partitionBy(own, group).orderBy(key))).filter(F.col(place) <= n)
    bounds = local.filter(F.col(place) == n).groupBy(F.col(group).alias(of)).agg(F.min(key).alias(bound))
    kept = local.join(bounds, F.col(group).eqNullSafe(F.col(of)), "left").filter(F.col(bound).isNull() | (F.col(key) <= F.col(bound)))
    ranked = kept.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col(place) <= n)
    return ranked.select(*names)


def parted(rows: DataFrame, by: str, name: str, parts_per_task: int = 16) -> DataFrame:
    """``rows`` with the column ``name``, a part by the hash of ``by``, and partitioned by it.

    What is then grouped by (``name``, ``by``), or ranked within ``name``, is in place without another exchange.
    """
    n = parts_per_task * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn(name, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).repartition(name)
