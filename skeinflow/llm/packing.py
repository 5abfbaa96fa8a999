"""Packing texts into containers of a fixed number of tokens by conflict-constrained best fit.

Texts are sized, and cut where they exceed the capacity, in one pass over the corpus. Pieces are spread over blocks of
bounded size by a hash, whatever their source, and every block is packed on its own: pieces that are large or have many
conflicts first (by size times members of the source), each into the fullest open container that has room and no conflict. Open containers are kept in order of their residual room; the search
begins at the first with enough room and goes on to the next until a compatible one is found, so the tightest compatible
container always wins. Each container carries a bitmap of the sources and one of the duplicate clusters in it.

Two texts of one duplicate cluster, or of one source, conflict. Only a source or a cluster with more pieces than a block's
expected containers, which no packing could keep apart, is split into as few parts as are no larger than that, and texts of
one part conflict.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .leaks import shingles, words_of
from .near_copies import frequent_codes, near_clusters, prefix_of, word_cluster

#: The tokenizer file used throughout: byte-level BPE as ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that public tokenizer divides text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(path: str = TOKENIZER):
    """The tokenizer of a rank file."""
    with open(path, "rb") as f:
        return _encoding(f.read())


@lru_cache(maxsize=2)
def _encoding(ranked: bytes):
    """The tokenizer of what a rank file holds."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranked.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, tokens: list[int], lengths: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) in characters of the pieces of a text: whole if it fits, else as full as characters allow.

    A cut never divides a character, so a piece may end up to three tokens early. Capacities under four tokens could not
    hold every character and are refused by ``pack``.
    """
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    data = text.encode("utf-8", "surrogatepass")
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n)
    pieces, at, char = [], 0, 0
    while at < len(tokens):
        stop = min(len(tokens), at + capacity)
        while stop < len(tokens) and data[ends[stop]] & 0xC0 == 0x80:
            stop -= 1
        size = len(data[ends[at] : ends[stop]].decode("utf-8", "surrogatepass"))
        pieces.append((char, char + size, stop - at))
        at, char = stop, char + size
    return pieces


def _sizer(capacities: dict, ranked, frequent: tuple[np.ndarray, np.ndarray], similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranked.value)
        for pdf in batches:
            rows = []
            for doc, text, source in zip(pdf["doc_id"], pdf["text"], pdf["source"]):
                text = text.encode("utf-8", "replace").decode() if not text.isascii() else text
                tokens = encoding.encode_ordinary(text)
                words = words_of(text)
                cluster, codes = word_cluster(words), np.unique(shingles(words))
                mark = len(codes), prefix_of(codes, *frequent, similarity)
                lengths = [len(encoding.decode_single_token_bytes(t)) for t in tokens] if len(tokens) > min(capacities.values()) else []
                for budget, capacity in capacities.items():
                    for k, piece in enumerate(cuts(text, tokens, lengths, capacity)):
                        rows.append((budget, capacity, doc, source, cluster, k, *piece, *mark))
                        mark = 0, None  # once for each text
            yield pd.DataFrame(rows, columns=["budget_id", "capacity", "doc_id", "source", "cluster", "piece", "start", "end", "n_tokens", "n_codes", "prefix"])

    return run


def _parts(keys: list, containers: int) -> list[tuple]:
    """For each key its (key, part): one part, or as few as have no more members each than there are containers."""
    members: dict = {}
    for k in keys:
        members[k] = members.get(k, 0) + 1
    split = {k: math.ceil(n / containers) for k, n in members.items()}
    seen: dict = {}
    out = []
    for k in keys:
        seen[k] = seen.get(k, -1) + 1
        out.append((k, seen[k] % split[k]))
    return out


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, strict: bool = False) -> list[int]:
    """The container number of every piece; sizes must not exceed the capacity. The result depends on the input alone.

    A source or cluster with more pieces than the sizes need containers has to meet itself; ``strict`` opens as many
    containers as it has pieces instead.
    """
    containers = len(sizes) + 1 if strict else max(1, math.ceil(sum(sizes) / capacity))
    parts = _parts(sources, containers), _parts(clusters, containers)
    members = Counter(parts[0])
    # By size alone, small pieces of a large source come last, when no container without that source has room.
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * members[parts[0][i]])
    marks = []
    for group in parts:
        ids: dict = {}
        marks.append([1 << ids.setdefault(key, len(ids)) for key in group])
    least = min(sizes, default=0)
    open_: list[tuple[int, int]] = []  # (residual, container), in order
    has: list[list[int]] = []  # per container its bitmaps
    out = [0] * len(sizes)
    for i in order:
        size, source, cluster = sizes[i], marks[0][i], marks[1][i]
        at = bisect.bisect_left(open_, (size, -1))
        while at < len(open_):
            own = has[open_[at][1]]
            if not own[0] & source and not own[1] & cluster:
                break
            at += 1
        if at < len(open_):
            room, number = open_.pop(at)
            own[0] |= source
            own[1] |= cluster
        else:
            room, number = capacity, len(has)
            has.append([source, cluster])
        out[i] = number
        if room - size >= max(least, 1):
            bisect.insort(open_, (room - size, number))
    return out


def _pack_block(pdf: pd.DataFrame, strict: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    pdf["local"] = best_fit(pdf["n_tokens"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), int(pdf["capacity"].iloc[0]), strict)
    return pdf[["budget_id", "block", "local", "doc_id", "piece", "start", "end", "n_tokens"]]


def pack(documents: DataFrame, budgets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", block_items: int = 20_000, path: str = TOKENIZER, max_budgets: int = 1000, similarity: float = 0.8, strict: bool = False) -> DataFrame:
    """(budget_id, container, doc_id, piece, start, end, n_tokens): where every text, or piece of one, goes.

    For every budget, each document with a non-empty text is in exactly one container, or is cut into pieces of
    characters ``start`` to ``end`` if it has more tokens than the capacity. Containers are numbered from 1 without gaps
    and never hold more than the capacity. Null and empty texts go nowhere; null sources are one source; rows are packed
    as they come, so a repeated row is a duplicate of its own. Null capacities are ignored, capacities under four raise
    ValueError, as do more than ``max_budgets`` budgets. Texts of equal words, and texts whose five-word shingles have a
    Jaccard ``similarity`` of this or more, directly or through others, are one duplicate cluster. Blocks hold about ``block_items`` pieces: only the last few
    containers of each block have much room left. With ``strict`` no two texts of a source or cluster share a container, however
    many containers that takes.
    """
    found = budgets.filter("budget_id is not null and capacity is not null").select("budget_id", "capacity").distinct().limit(max_budgets + 1).collect()
    if len(found) > max_budgets:
        raise ValueError(f"more than {max_budgets} budgets")
    capacities = {r[0]: r[1] for r in found}
    if any(c < 4 for c in capacities.values()):
        raise ValueError("capacities must be at least 4 tokens")
    id_type, budget_type = documents.schema[doc].dataType.simpleString(), budgets.schema["budget_id"].dataType.simpleString()
    if not capacities:
        return documents.sparkSession.createDataFrame([], f"budget_id {budget_type}, container bigint, doc_id {id_type}, piece int, start int, end int, n_tokens int")
    rows = documents.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.xxhash64(F.col(source)), F.lit(0)).alias("source"))
    with open(path, "rb") as f:
        ranked = documents.sparkSession.sparkContext.broadcast(f.read())  # the file is the driver's; executors need none
    sizer = _sizer(capacities, ranked, frequent_codes(rows), similarity)
    sized = cut_lineage(spread(rows).mapInPandas(sizer, f"budget_id {budget_type}, capacity bigint, doc_id {id_type}, source bigint, cluster bigint, piece int, start int, end int, n_tokens int, n_codes int, prefix array<bigint>"))
    pieces = sized.drop("n_codes", "prefix")
    near = near_clusters(sized.filter("prefix is not null").select("doc_id", "cluster", "n_codes", "prefix"), rows.select("doc_id", "text"), similarity)
    if near is not None:
        pieces = pieces.join(near, "cluster", "left").withColumn("cluster", F.coalesce("near", "cluster")).drop("near")
    most = pieces.groupBy("budget_id").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // block_items))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(blocks)).cast("int"))
    packed = cut_lineage(blocked.groupBy("budget_id", "block").applyInPandas(lambda pdf: _pack_block(pdf, strict), f"budget_id {budget_type}, block int, local int, doc_id {id_type}, piece int, start int, end int, n_tokens int"))
    before = Window.partitionBy("budget_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = packed.groupBy("budget_id", "block").agg((F.max("local") + 1).cast("bigint").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return packed.join(offsets.select("budget_id", "block", "offset"), ["budget_id", "block"]).select("budget_id", (F.col("offset") + F.col("local") + 1).alias("container"), "doc_id", "piece", "start", "end", "n_tokens")


def room_left(packed: DataFrame, budgets: DataFrame, documents: DataFrame, doc: str = "doc_id", source: str = "source") -> DataFrame:
    """(budget_id, label, capacity, n_containers, n_pieces, tokens, used, n_same_source): how full the containers of each budget
    are, and how many pieces share one with an earlier piece of their source. ``doc_id`` must be unique for the last."""
    sums = packed.groupBy("budget_id").agg(F.max("container").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("tokens"))
    sources = documents.select(F.col(doc).alias("doc_id"), F.coalesce(F.xxhash64(source), F.lit(0)).alias("source")).dropDuplicates(["doc_id"])
    cells = packed.join(sources, "doc_id").groupBy("budget_id", "container", "source").agg((F.count(F.lit(1)) - 1).alias("more"))
    same = cells.groupBy("budget_id").agg(F.sum("more").alias("n_same_source"))
    return budgets.select("budget_id", "label", "capacity").join(sums, "budget_id").join(same, "budget_id").withColumn("used", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 4))
