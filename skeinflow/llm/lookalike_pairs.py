"""Documents that look the same but are stored differently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .lookalikes import look_key_column


def look_classes(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, look, stored) of every document with a non-empty text: keys of its consistent form and of its stored text."""
    rows = documents.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(id).alias("doc_id"), F.col(text).alias("_t"))
    return spread(rows).select("doc_id", look_key_column(F.col("_t")).alias("look"), F.md5("_t").alias("stored"))


def _spellings(classes: DataFrame, per_part: int) -> DataFrame:
    """(look, stored, n, total, n_spellings, parts) of the looks that have several spellings; counts are made before any join."""
    counts = classes.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"))
    looks = counts.groupBy("look").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_spellings")).filter("n_spellings > 1")
    return counts.join(looks, "look").withColumn("parts", F.ceil(F.col("n") / per_part).cast("int"))


def same_look_pairs(classes: DataFrame, per_part: int = 1000) -> DataFrame:
    """(doc_a, doc_b) with doc_a < doc_b, of equal ``look`` and different ``stored``.

    Spellings are paired first, one row per pair of different stored forms, and then joined to their documents, so copies
    of one spelling never meet each other. Looks with one spelling, as almost all are, leave before any join. A spelling of
    many documents is cut into parts of about ``per_part``, and a task joins a part to a part, so no look is too hot for one.
    A repeated row of a document gives its pairs once.
    """
    classes = cut_lineage(classes)  # several steps read it, and the forms are made by Python once
    spellings = cut_lineage(_spellings(classes, per_part))
    rows = classes.join(spellings.select("look", "stored", "parts"), ["look", "stored"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    cells = spellings.select("look", "stored", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = cells.select("look", F.col("stored").alias("a"), F.col("part").alias("pa"))
    pairs = first.join(cells.select("look", F.col("stored").alias("b"), F.col("part").alias("pb")), "look").filter("a < b")
    left = rows.select("look", F.col("stored").alias("a"), F.col("part").alias("pa"), F.col("doc_id").alias("x"))
    right = rows.select("look", F.col("stored").alias("b"), F.col("part").alias("pb"), F.col("doc_id").alias("y"))
    return pairs.join(left, ["look", "a", "pa"]).join(right, ["look", "b", "pb"]).filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def same_look_members(classes: DataFrame) -> DataFrame:
    """(doc_id, look, n_spellings, n_links): the class of every document, in how many spellings its look is stored, and how
    many documents show the same in another spelling. Nothing is paired; a look of one spelling has no links."""
    classes = cut_lineage(classes)
    spellings = _spellings(classes, 1).select("look", "stored", "n_spellings", (F.col("total") - F.col("n")).alias("n_links"))
    joined = classes.join(spellings, ["look", "stored"], "left")
    return joined.select("doc_id", "look", F.coalesce("n_spellings", F.lit(1)).alias("n_spellings"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
