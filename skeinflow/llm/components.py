"""Connected components of pairs by label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(cluster, near): the smallest member of the component of every end of the pairs (a, b)."""
    edges = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = cut_lineage(edges.groupBy(F.col("a").alias("cluster")).agg(F.least("cluster", F.min("b")).alias("near")))
    for _ in range(max_rounds):
        around = edges.join(known, F.col("b") == F.col("cluster")).groupBy("a").agg(F.min("near").alias("least"))
        # The label's own label as well, so long chains need few rounds.
        jumped = known.select(F.col("cluster").alias("at"), F.col("near").alias("further"))
        new = known.join(around, F.col("cluster") == F.col("a")).join(jumped, F.col("near") == F.col("at"))
        new = cut_lineage(new.select("cluster", F.least("near", "least", "further").alias("near"), (F.least("least", "further") < F.col("near")).alias("moved")))
        known = new.select("cluster", "near")
        if new.filter("moved").isEmpty():
            return known
    raise RuntimeError(f"components not found after {max_rounds} rounds")
