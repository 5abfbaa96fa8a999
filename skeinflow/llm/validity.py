"""Source files that do not parse.

Files are read where they are. A file of a language with a lexer of finitely many states is cut into chunks; chunks become
lexer-state maps with bracket summaries, which are reduced associatively, for files of several chunks across partitions.
Files that are balanced, as far as the maps can tell, are then parsed by the language's grammar. YAML and shell files, whose
lexers have no finite set of states, are one chunk and are parsed at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, spread
from .syntax import BY_EXTENSION, JUDGED, fault, lexmap

#: Characters of a chunk, and chunks that one step of the reduction combines.
CHUNK = 8192
FAN_IN = 64


def language_of(language: Column, path: Column) -> Column:
    """The stored language without case and blanks, or, where it is null or blank, the one the path's extension names."""
    stored = F.nullif(F.lower(F.btrim(language)), F.lit(""))
    extension = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair]), extension)
    return F.coalesce(stored, named)


def _cut(size: int):
    """Files to (file_id, path, lang, no, n, bad, chunk): the verdict of files of one chunk, the chunks of larger ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, path, lang, content in zip(pdf["file_id"], pdf["path"], pdf["lang"], pdf["content"]):
                content, parts = bytes(content), []
                if lang in lexmap.LANGUAGES:
                    try:
                        parts = lexmap.chunks(content.decode("utf-8-sig").replace("\r\n", "\n"), size)
                    except UnicodeDecodeError:
                        parts = []  # the grammar says what that means for the language
                if len(parts) > 1:
                    rows += [(file, path, lang, k, len(parts), None, part) for k, part in enumerate(parts)]
                    continue
                unbalanced = bool(parts) and not lexmap.balanced([lexmap.summary(lang, parts[0], True)])
                rows.append((file, path, lang, 0, 1, unbalanced or fault(lang, content, path or "") is not None, None))
            yield pd.DataFrame(rows, columns=["file_id", "path", "lang", "no", "n", "bad", "chunk"])

    return run


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["map"] = [json.dumps(lexmap.summary(lang, chunk, no == 0)) for lang, chunk, no in zip(pdf["lang"], pdf["chunk"], pdf["no"])]
        yield pdf[["file_id", "no", "map"]]


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring maps of one file as one, numbered for the next step."""
    pdf = pdf.drop_duplicates("no").sort_values("no")
    return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "no": [int(pdf["no"].iloc[0]) // FAN_IN], "map": [json.dumps(reduce(lexmap.combine, map(json.loads, pdf["map"])))]})


def _parse(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("no").sort_values("no")
    bad = fault(pdf["lang"].iloc[0], "".join(pdf["chunk"]).encode(), pdf["path"].iloc[0] or "") is not None
    return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "bad": [bad]})


def broken_files(files: DataFrame, file: str = "file_id", path: str = "path", language: str = "language", content: str = "content", chunk: int = CHUNK) -> DataFrame:
    """(file_id, lang, bad) of every file of a judged language, one row per file.

    Files without content, and of languages that are not judged, give no row. Rows of one file are delivered again
    unchanged; any of them is taken. An empty file is judged as its language has it (empty JSON or Go is not valid).
    Chunks of a large file are read wherever they lie, and their maps are combined ``FAN_IN`` at a time, step by step; the
    chunks of a file that is balanced, or that only the grammar can tell, meet in one task for it, as the files of a manifest
    are at most ten megabytes.
    """
    rows = files.select(F.col(file).alias("file_id"), F.col(path).cast("string").alias("path"), language_of(F.col(language), F.col(path)).alias("lang"), F.col(content).alias("content")).filter(F.col("lang").isin(*JUDGED) & F.col("content").isNotNull())
    id_type = files.schema[file].dataType.simpleString()
    cut = cut_lineage(spread(rows).mapInPandas(_cut(chunk), f"file_id {id_type}, path string, lang string, no int, n int, bad boolean, chunk string"))
    single = cut.filter("n = 1").select("file_id", "bad")
    chunked = cut.filter("n > 1").repartition("file_id", "no")
    most = cut.agg(F.max("n")).first()[0] or 1
    maps = chunked.select("file_id", "lang", "no", "chunk").mapInPandas(_summarise, f"file_id {id_type}, no int, map string")
    while most > 1:
        maps = maps.groupBy("file_id", F.floor(F.col("no") / FAN_IN).alias("_step")).applyInPandas(_combine, f"file_id {id_type}, no int, map string")
        most = -(-most // FAN_IN)
    whole = cut_lineage(maps.select("file_id", _balanced("map").alias("balanced")))  # read twice
    parsed = chunked.join(whole.filter("balanced"), "file_id", "left_semi").groupBy("file_id").applyInPandas(_parse, f"file_id {id_type}, bad boolean")
    unbalanced = whole.filter("not balanced").select("file_id", F.lit(True).alias("bad"))
    return single.unionByName(parsed).unionByName(unbalanced).groupBy("file_id").agg(F.max("bad").alias("bad"))


@F.pandas_udf(T.BooleanType())
def _balanced(maps: pd.Series) -> pd.Series:
    return maps.map(lambda m: lexmap.balanced([json.loads(m)]))


def broken(files: DataFrame, skipped: DataFrame, file: str = "file_id") -> DataFrame:
    """(file_id, repo, lang, bad) of the judged files whose (repo, path) is not in ``skipped``; nulls match nothing there."""
    listed = skipped.select("repo", "path").distinct()
    names = files.select(F.col(file).alias("file_id"), "repo", "path", language_of(F.col("language"), F.col("path")).alias("lang")).dropDuplicates(["file_id"]).join(listed, ["repo", "path"], "left_anti")
    return broken_files(files, file).join(names, "file_id").select("file_id", "repo", "lang", "bad")


def broken_rates(judged: DataFrame) -> DataFrame:
    """(repo, lang, n_files, n_broken, rate) of ``broken``."""
    return judged.groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("bad").cast("bigint")).alias("n_broken"), F.round(F.avg(F.col("bad").cast("int")), 6).alias("rate"))
