"""Reachability, and joins of places in files: enclosing and nearest definitions, bases, pairs of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def closure(starts: DataFrame, steps: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(start, name): everything reachable from each ``start`` over ``steps`` (src, dst), the start included.

    The frontier is joined until nothing new comes; each round is written to the checkpoint folder, so plans stay short
    and a lost executor costs one round. Cycles end, as known pairs never enter the frontier again.
    """
    known = cut_lineage(starts.select("start", F.col("start").alias("name")).filter("start is not null").distinct())
    edges = cut_lineage(steps.select("src", "dst").filter("dst is not null").distinct())
    frontier = known
    for k in range(max_rounds):
        step = frontier.join(edges, F.col("name") == F.col("src")).select("start", F.col("dst").alias("name")).distinct()
        frontier = cut_lineage(step.join(known, ["start", "name"], "left_anti"))
        if frontier.isEmpty():
            return known
        # The parts are written already; they are gathered now and then, so plans stay short.
        known = known.unionByName(frontier) if k % 16 < 15 else cut_lineage(known.unionByName(frontier))
    raise RuntimeError(f"not closed after {max_rounds} rounds")


def enclosing(points: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """(file, line, name): for each point the span of its file that holds its line and starts last; null without one.

    ``points`` has (file, line), ``spans`` (file, name, line_start, line_end). Spans are cut into buckets of ``bucket``
    lines, so the range join is an equality join on (file, bucket) and no file meets all of its spans at once.
    """
    cells = spans.filter("line_start <= line_end").withColumn("b", F.explode(F.sequence(F.floor(F.col("line_start") / bucket), F.floor(F.col("line_end") / bucket))))
    keyed = points.select("file", "line").distinct().withColumn("b", F.floor(F.col("line") / bucket))
    joined = keyed.join(cells, ["file", "b"], "left")
    inside = (F.col("line_start") <= F.col("line")) & (F.col("line") <= F.col("line_end"))
    best = F.max(F.when(inside, F.struct("line_start", (-F.col("line_end")).alias("e"), "name")))
    return joined.groupBy("file", "line").agg(best.alias("s")).select("file", "line", F.col("s.name").alias("name"))


def nearest_before(points: DataFrame, marks: DataFrame) -> DataFrame:
    """(file, line, name): for each point the mark of its file on its line or before it, the nearest; null without one.

    An as-of join as one sorted pass over the union of both sides. ``marks`` has (file, line, name); of marks on one line
    the largest name counts.
    """
    own = marks.groupBy("file", "line").agg(F.max("name").alias("name")).withColumn("is_point", F.lit(0))
    asked = points.select("file", "line").distinct().withColumn("name", F.lit(None).cast("string")).withColumn("is_point", F.lit(1))
    order = Window.partitionBy("file").orderBy("line", "is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = own.unionByName(asked).withColumn("name", F.last("name", ignorenulls=True).over(order))
    return filled.filter("is_point = 1").select("file", "line", "name")


def single_bases(classes: DataFrame) -> DataFrame:
    """(file, name, base_file): the class each class inherits from, where that is certain.

    ``classes`` has (file, name, base): the base in the same file, else the only other file that has a class of that name;
    no base, the class itself, and names of several files give null.
    """
    unique = classes.select(F.col("name").alias("base"), F.col("file").alias("f")).distinct()
    here = unique.select("base", F.col("f").alias("file"), F.lit(True).alias("same"))
    there = unique.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("other"))
    joined = classes.join(here, ["base", "file"], "left").join(there, "base", "left")
    found = F.when(F.col("base") == F.col("name"), None).when(F.col("same"), F.col("file")).when((F.col("n") == 1) & (F.col("other") != F.col("file")), F.col("other"))
    return joined.select("file", "name", found.alias("base_file"))


def inherited(capabilities: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, name, caps): each class's own capabilities with those of its base, one level up."""
    own = capabilities.select("file", "name", "caps")
    bases = single_bases(classes).join(classes.select("file", "name", "base"), ["file", "name"])
    base_caps = own.select(F.col("file").alias("base_file"), F.col("name").alias("base"), F.col("caps").alias("more"))
    return own.join(bases, ["file", "name"], "left").join(base_caps, ["base_file", "base"], "left").select("file", "name", F.array_sort(F.array_union("caps", F.coalesce("more", F.array().cast("array<string>")))).alias("caps"))


def pair_counts(nodes: DataFrame, left: str, right: str) -> DataFrame:
    """(file, n_left, n_right, n_pairs) of the nodes of two kinds by their file: the pairs of one file, counted and not made."""
    rows = nodes.filter("file is not null").groupBy("file").agg(F.count_if(F.col("kind") == left).alias("n_left"), F.count_if(F.col("kind") == right).alias("n_right"))
    return rows.filter("n_left > 0 and n_right > 0").withColumn("n_pairs", F.col("n_left") * F.col("n_right"))
