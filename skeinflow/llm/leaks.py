"""Evaluation items whose passages occur in a corpus, by a shingle join.

Words are compared in their consistent look and without case, so spelling with other characters, line breaks and marks
do not matter. Items become sets of five-word shingles. Items of equal words are one item, and items whose shingle sets have a
Jaccard similarity of 0.8 or more are one family: what one family repeats is its own, and shingles that several families
share (instruction sentences) belong to none. A passage is a run of five or more words of an item; an edited word ends one
passage and the next begins behind it.

The join is filtered by prefixes. An item's shingles are ordered by rarity, those that other families of items have last; every
row of the items counts for this. The longest tail of this order whose words together fall short of the share cannot make a case, so a case has a
shingle of the rest, the prefix. One pass over the corpus looks up prefix shingles only. For what they hit, a length bound (the
document has enough words) and a position bound (the item's places that the prefix hits cover, and those that the tail could
still cover) come before the exact check, which lays windows of the item's size over the document and unites what they hold.
Documents are never shuffled, and only cases leave the pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .components import components
from .lookalikes import canonical

#: Words of a shingle.
SHINGLE = 5
_WORD = re.compile(r"[^\W_](?:\w*[^\W_])?")
_BASE = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    """The words of a text in their consistent look, without case; none for null."""
    return _WORD.findall(canonical(text)[0].casefold()) if text else []


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def shingles(words: list[str]) -> np.ndarray:
    """A signed 64-bit code of every run of ``SHINGLE`` words, by position."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        total += codes[k : k + n] * _BASE[k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total.view(np.int64)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [words_of(t) for t in pdf["text"]]
        codes = [shingles(w) for w in words]
        yield pd.DataFrame({"item_id": pdf["item_id"], "word_key": [xxhash.xxh3_128_hexdigest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words], "n_words": list(map(len, words)), "codes": codes})


def own_shingles(items: DataFrame, item: str, text: str, shared_by: int = 2, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rep, code, pos, n_words) of the shingles that at most ``shared_by`` families of items have, and (rep, item_id).

    ``rep`` stands for all items of the same words. Items without a shingle have no rows. An item stored with several texts has
    a ``rep`` for each, all of one family.
    """
    read = items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).filter("text is not null").distinct()
    rows = cut_lineage(read.mapInPandas(_words, f"item_id {items.schema[item].dataType.simpleString()}, word_key string, n_words int, codes array<bigint>").filter(F.size("codes") > 0))
    members = rows.select(F.col("word_key").alias("rep"), "item_id").distinct()
    one = rows.groupBy(F.col("word_key").alias("rep")).agg(F.first("n_words").alias("n_words"), F.first("codes").alias("codes"))
    places = cut_lineage(one.select("rep", "n_words", F.posexplode("codes").alias("pos", "code")))
    versions = members.join(members.groupBy("item_id").agg(F.min("rep").alias("a")), "item_id").filter(F.col("rep") > F.col("a")).select("a", F.col("rep").alias("b"))
    families = _families(places, versions, similarity)
    few = places.select("rep", "code").distinct()
    named = few if families is None else few.join(families, "rep", "left").select(F.coalesce("family", "rep").alias("rep"), "code").distinct()
    own = named.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= shared_by)
    return places.join(own, "code").select("rep", "code", "pos", "n_words", F.col("n").alias("n_families")), members


def _families(places: DataFrame, versions: DataFrame, similarity: float) -> DataFrame | None:
    """(rep, family) of the items that are similar to another or in the pairs (a, b) of ``versions``; None without any.

    By prefixes in the order of rarity.
    """
    counts = places.select("rep", "code").distinct()
    rare = counts.join(counts.groupBy("code").agg(F.count(F.lit(1)).alias("k")), "code").filter("k > 1")
    sizes = counts.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    # Codes of one item only cannot be shared; they come first in the order, so the shared ones begin after them.
    ranked = rare.join(sizes, "rep").join(rare.groupBy("rep").agg(F.count(F.lit(1)).alias("m")), "rep").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("k", "code")) + F.col("n") - F.col("m"))
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("rep", "n", "code")
    other = prefix.select(F.col("rep").alias("b"), F.col("n").alias("m"), "code")
    alike = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    pairs = cut_lineage(prefix.join(other, "code").filter((F.col("rep") < F.col("b")) & alike).select(F.col("rep").alias("a"), "b", "n", "m").distinct())
    left, right = rare.select(F.col("rep").alias("a"), "code"), rare.select(F.col("rep").alias("b"), "code")
    shared = pairs.join(left, "a").join(right, ["b", "code"]).groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("s"))
    near = cut_lineage(shared.filter(F.col("s") >= similarity * (F.col("n") + F.col("m") - F.col("s")) - 1e-9).select("a", "b").unionByName(versions))
    return None if near.isEmpty() else components(near).select(F.col("cluster").alias("rep"), F.col("near").alias("family"))


class Index:
    """The prefixes of a block of items, and what checks their cases. ``rows`` are (rep, code, pos, n_words, frequency)."""

    def __init__(self, rows: pd.DataFrame, share: float) -> None:
        self.share = share
        self.reps: list[str] = []
        self.words: list[int] = []
        self.need: list[int] = []  # own places that a case covers
        self.codes: list[np.ndarray] = []  # own shingles in the order of their places
        self.places: list[np.ndarray] = []
        self.tails: list[np.ndarray] = []  # places that shingles behind the prefix cover
        looked_up: dict[int, list[int]] = {}
        for rep, own in rows.sort_values(["rep", "pos"]).groupby("rep", sort=True):
            codes, places = own["code"].to_numpy(np.int64), own["pos"].to_numpy(np.int64)
            covers = np.zeros(int(places[-1]) + SHINGLE, dtype=bool)
            for k in range(SHINGLE):
                covers[places + k] = True
            need = max(1, math.ceil(share * int(covers.sum()) - 1e-9))
            # Rarest first, in steps of a factor of two; within a step in the order of the item, so tails hold together.
            step = np.log2(1 + own["frequency"].to_numpy(np.float64)).astype(np.int64)
            order = np.lexsort((places, step))
            tail = np.zeros(len(covers), dtype=bool)
            size, cut = 0, len(order)
            while cut:
                fresh = [p for p in range(places[order[cut - 1]], places[order[cut - 1]] + SHINGLE) if not tail[p]]
                if size + len(fresh) >= need:
                    break
                tail[fresh] = True
                size, cut = size + len(fresh), cut - 1
            number = len(self.reps)
            self.reps.append(rep)
            self.words.append(int(own["n_words"].iloc[0]))
            self.need.append(need)
            self.codes.append(codes)
            self.places.append(places)
            self.tails.append(tail)
            for code in set(codes[order[:cut]].tolist()):
                looked_up.setdefault(code, []).append(number)
        self.prefix = np.array(sorted(looked_up), dtype=np.int64)
        self.items = [looked_up[c] for c in self.prefix.tolist()]
        self.own = [int(sum(self._cover(i, self.places[i]))) for i in range(len(self.reps))]

    def _cover(self, item: int, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.tails[item]), dtype=bool)
        for k in range(SHINGLE):
            out[places + k] = True
        return out

    def cases(self, words: list[str]) -> list[tuple[str, float, float]]:
        """(rep, share, window share) of the items of which the document carries the share."""
        if len(words) < SHINGLE or not len(self.prefix):
            return []
        found = shingles(words)
        at = np.minimum(np.searchsorted(self.prefix, found), len(self.prefix) - 1)
        hits = np.unique(at[self.prefix[at] == found])
        if not len(hits):
            return []
        met: dict[int, list[int]] = {}
        for h in hits.tolist():
            for item in self.items[h]:
                met.setdefault(item, []).append(h)
        known = None
        out = []
        for item, of in met.items():
            if len(words) < self.need[item]:  # length
                continue
            at_prefix = self.places[item][np.isin(self.codes[item], self.prefix[of])]
            if int((self._cover(item, at_prefix) | self.tails[item]).sum()) < self.need[item]:  # position
                continue
            if known is None:
                order = np.argsort(found, kind="stable")
                known = found[order]
            share, best = self._verify(item, known, order)
            if share >= self.share - 1e-9:
                out.append((self.reps[item], share, best))
        return out

    def _verify(self, item: int, known: np.ndarray, order: np.ndarray) -> tuple[float, float]:
        """The share of the item's own words in the document's windows of the item's size, united, and in the best of them."""
        codes, places = self.codes[item], self.places[item]
        low, high = np.searchsorted(known, codes, "left"), np.searchsorted(known, codes, "right")
        met = high > low
        share = int(self._cover(item, places[met]).sum()) / self.own[item]
        if share < self.share - 1e-9:
            return share, 0.0
        spots = sorted((int(order[k]), int(p)) for lo, hi, p in zip(low[met], high[met], places[met]) for k in range(lo, hi))
        counts = np.zeros(len(self.tails[item]), dtype=np.int64)
        best = size = first = 0
        for d, p in spots:
            size += int((counts[p : p + SHINGLE] == 0).sum())
            counts[p : p + SHINGLE] += 1
            while d + SHINGLE - spots[first][0] > max(self.words[item], SHINGLE):
                q = spots[first][1]
                counts[q : q + SHINGLE] -= 1
                size -= int((counts[q : q + SHINGLE] == 0).sum())
                first += 1
            best = max(best, size)
        return share, best / self.own[item]


def _lookup(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = index.value
        for pdf in batches:
            yield pd.DataFrame([(doc, *case) for doc, text in zip(pdf["doc_id"], pdf["text"]) for case in known.cases(words_of(text))], columns=["doc_id", "rep", "share", "window_share"])

    return run


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", share: float = 0.5, shared_by: int = 2, block: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, share, window_share) of every document that has at least ``share`` of an item's own words as passages.

    An item's own words are those in shingles of at most ``shared_by`` families of items; items of equal words, and items of
    one family, keep what they have in common, so an item that many suites repeat is found for each. ``window_share`` is the
    largest share within one window of the item's size: it is smaller where the item's parts stand apart. Items with no shingle
    of their own (under five words, or nothing but shared sentences) leak nowhere; null and empty documents and items leak
    nothing. A repeated document row gives its cases once, as does a repeated item row; an item stored with several texts has the
    cases of each.

    Item shingles are broadcast in blocks of at most about ``block`` shingles (some forty bytes each); more items mean more passes
    over the corpus, never fewer results.
    """
    spark = documents.sparkSession
    own, members = own_shingles(items, item, text, shared_by)
    item_type, doc_type = items.schema[item].dataType.simpleString(), documents.schema[doc].dataType.simpleString()
    source = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    ordered = cut_lineage(own.select("rep", "code", "pos", "n_words", (F.col("n_families") - 1).alias("frequency")))
    blocks = -(-ordered.count() // block)
    if not blocks:
        return spark.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}, share double, window_share double")
    parts = []
    for k in range(blocks):
        rows = ordered.filter(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == k).toPandas()
        if len(rows):
            index = spark.sparkContext.broadcast(Index(rows, share))
            parts.append(spread(source).mapInPandas(_lookup(index), f"doc_id {doc_type}, rep string, share double, window_share double"))
    found = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "rep").agg(F.max("share").alias("share"), F.max("window_share").alias("window_share"))
    return found.join(members, "rep").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("window_share").alias("window_share"))
