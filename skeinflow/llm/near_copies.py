"""Clusters of near copies: texts whose sets of five-word shingles are similar, by a prefix-filtered set join.

Texts of equal words are one cluster from the start and are compared once. The shingles of every text are put into one order
for all texts, those that many texts have last; of ``n`` shingles only the first ``n - ceil(similarity * n) + 1`` (the
prefix) are joined, as two texts of at least that similarity have one of them in common. The join counts how many they have in
common: up to where the first of two prefixes ends nothing else is shared, so the count bounds the overlap, and most pairs
that share a phrase are dropped by it. The rest is verified on the whole sets of the few texts that are in a pair, and
clusters are the components of the pairs. Which shingles come last is taken from a sample of the texts; it changes the cost
and never the result.

A shingle that very many texts have in their prefix would join all of them to each other. There each text is first compared
to one of them only, in a few rounds with another one each; what that links is one component, and the join that follows pairs
texts of different components alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import union_all
from ..session import cut_lineage
from .components import components
from .leaks import shingles, words_of


def word_cluster(words: list[str]) -> int:
    """One number for all texts of these words."""
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True)


def prefix_of(codes: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, similarity: float) -> list[int]:
    """The codes, each once, that a text of at least this similarity must share one of. ``frequent`` is sorted."""
    n = len(codes)
    if not n:
        return []
    rank = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, codes), len(frequent) - 1)
        rank = np.where(frequent[at] == codes, ranks[at], 0)
    return codes[np.lexsort((codes, rank))][: n - math.ceil(similarity * n - 1e-9) + 1].tolist()


def frequent_codes(texts: DataFrame, one_of: int = 16, least: int = 3, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, ranks from 1 by rising frequency) of at most ``most`` shingles that many texts of a sample have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"codes": [np.unique(shingles(words_of(t))) for t in pdf["text"]]})

    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0).dropDuplicates(["text"]).select("text").mapInPandas(run, "codes array<bigint>")
    found = sample.select(F.explode("codes").alias("code")).groupBy("code").count().filter(F.col("count") >= least).orderBy(F.col("count").desc(), "code").limit(most).collect()
    codes, ranks = np.array([r[0] for r in found], dtype=np.int64), np.arange(len(found), 0, -1)
    order = np.argsort(codes)
    return codes[order], ranks[order]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [words_of(t) for t in pdf["text"]]
        yield pd.DataFrame({"cluster": [word_cluster(w) for w in words], "codes": [np.unique(shingles(w)) for w in words]})


def _verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of clusters whose whole sets are similar."""
    wanted = pairs.select(F.col("a").alias("cluster")).unionByName(pairs.select(F.col("b").alias("cluster"))).distinct()
    docs = marks.join(wanted, "cluster", "left_semi").groupBy("cluster").agg(F.first(F.struct("doc_id")).alias("d")).select(F.col("d.doc_id").alias("wanted_id")).distinct()
    sets = texts.join(docs, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text").mapInPandas(_sets, "cluster bigint, codes array<bigint>").dropDuplicates(["cluster"])
    both = pairs.select("a", "b").join(sets.select(F.col("cluster").alias("a"), F.col("codes").alias("codes_a")), "a").join(sets.select(F.col("cluster").alias("b"), F.col("codes").alias("codes_b")), "b")
    shared = F.size(F.array_intersect("codes_a", "codes_b"))
    return cut_lineage(both.filter(shared >= similarity * (F.size("codes_a") + F.size("codes_b") - shared) - 1e-9).select("a", "b"))


def _sizes_allow(similarity: float) -> Column:
    return F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9


def near_clusters(marks: DataFrame, texts: DataFrame, similarity: float, hot: int = 1000, max_rounds: int = 8) -> DataFrame | None:
    """(cluster, near): for every word cluster that is similar to another the smallest of its component; None without any.

    ``marks`` has (doc_id, cluster, n_codes, prefix) of each text, ``texts`` (doc_id, text). Shingles in the prefixes of more
    than ``hot`` components are treated as the module says.
    """
    posted = cut_lineage(marks.filter("n_codes > 0").dropDuplicates(["cluster"]).select("cluster", F.col("n_codes").alias("n"), F.explode("prefix").alias("code")).withColumn("label", F.col("cluster")))
    found: list[DataFrame] = []
    for k in range(max_rounds):
        many = cut_lineage(posted.select("code", "label").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("code"))
        if many.isEmpty():
            break
        crowd = posted.join(many, "code")
        centre = crowd.groupBy("code").agg(F.min_by(F.struct("cluster", "n", "label"), F.xxhash64("cluster", F.lit(k))).alias("c")).select("code", F.col("c.cluster").alias("b"), F.col("c.n").alias("m"), F.col("c.label").alias("other"))
        stars = crowd.join(centre, "code").filter((F.col("label") != F.col("other")) & _sizes_allow(similarity)).select(F.col("cluster").alias("a"), "b").distinct()
        linked = _verified(cut_lineage(stars), marks, texts, similarity)
        if linked.isEmpty():
            break
        found.append(linked)
        labels = components(union_all(found))
        posted = cut_lineage(posted.drop("label").join(labels, "cluster", "left").select("cluster", "n", "code", F.coalesce("near", "cluster").alias("label")))
    many = posted.select("code", "label").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("k"))
    crowded = F.col("k") > hot if found else F.lit(False)
    rows = posted.join(many, "code") if found else posted.withColumn("k", F.lit(0))
    other = rows.filter(~crowded).select("code", F.col("cluster").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))
    joined = rows.filter(~crowded).join(other, "code").filter((F.col("cluster") < F.col("b")) & (F.col("label") != F.col("other")) & _sizes_allow(similarity)).select(F.col("cluster").alias("a"), "n", "b", "m")
    if found:
        # Components meet first, then their texts, so texts of one component never do.
        heads = rows.filter(crowded).select("code", "label").distinct()
        meet = heads.join(heads.withColumnRenamed("label", "other"), "code").filter("label < other")
        left, right = rows.filter(crowded).select("code", "label", F.col("cluster").alias("a"), "n"), rows.filter(crowded).select("code", F.col("label").alias("other"), F.col("cluster").alias("b"), F.col("n").alias("m"))
        far = meet.join(left, ["code", "label"]).join(right, ["code", "other"]).filter(_sizes_allow(similarity))
        swap = F.col("a") > F.col("b")
        joined = joined.unionByName(far.select(F.least("a", "b").alias("a"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m")))
    # Up to the end of the first prefix to end, the common shingles are those counted; behind it there are at most as many
    # as the text has there.
    overlap = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9)
    behind = F.ceil(similarity * F.greatest("n", "m") - 1e-9) - 1
    pairs = joined.groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") + behind >= overlap).select("a", "b")
    found.append(_verified(cut_lineage(pairs), marks, texts, similarity))
    near = union_all(found)
    return None if near.isEmpty() else components(near)
