"""Where results go: the graph as tables, and bundles of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.reports import bundle, group_bundle, markdown


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes a table beside its place and moves it there, so readers see the old or the new one whole."""
    system, path_of = _fs(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}.new")
    system.delete(path_of(f"{path}.old"), True)
    if system.exists(path_of(path)):
        system.rename(path_of(path), path_of(f"{path}.old"))
    system.rename(path_of(f"{path}.new"), path_of(path))
    system.delete(path_of(f"{path}.old"), True)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> dict[str, dict[str, int]]:
    """Merges nodes and edges (with ``seq``, from 1) into the tables of a folder; returns what was added and updated in each."""
    spark = nodes.sparkSession
    out = {}
    for name, rows, upsert in (("nodes", nodes, merge.upsert_nodes), ("edges", edges, merge.upsert_edges)):
        path = f"{folder}/{name}.parquet"
        system, path_of = _fs(spark, path)
        stored = spark.read.parquet(path) if system.exists(path_of(path)) else rows.drop("seq").limit(0)
        counts = merge.write_counts(stored, rows).first()
        _replace(spark, upsert(stored, rows).drop("n_rows"), path)
        out[name] = {"added": counts.added, "updated": counts.updated}
    return out


def write_bundle(folder: str, title: str, tables: dict[str, DataFrame], chains: DataFrame, chain_paths: DataFrame, groups: DataFrame, keep: int = 5, stamp: str = "last") -> None:
    """A bundle below ``folder``: ``report.md``, chains and groups as JSON lines. The bundle before moves to ``archive/stamp``,
    of which the newest ``keep`` by name stay."""
    spark = chains.sparkSession
    system, path_of = _fs(spark, folder)
    current = f"{folder}/current"
    if system.exists(path_of(current)):
        system.mkdirs(path_of(f"{folder}/archive"))
        system.rename(path_of(current), path_of(f"{folder}/archive/{stamp}"))
        old = sorted(f.getPath().getName() for f in system.listStatus(path_of(f"{folder}/archive")))
        for name in old[: max(0, len(old) - keep)]:
            system.delete(path_of(f"{folder}/archive/{name}"), True)
    bundle(chains, chain_paths).select(F.col("json").alias("value")).write.text(f"{current}/chains")
    group_bundle(groups, chain_paths).select(F.col("json").alias("value")).write.text(f"{current}/chain_groups")
    out = system.create(path_of(f"{current}/report.md"), True)
    out.write(bytearray(markdown(title, tables).encode()))
    out.close()
