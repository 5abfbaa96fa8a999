"""Runtime observations as a stream that is merged into the stored edges batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import edge_id, upsert_edges

SCHEMA = "source_id string, target_id string, kind string, host_id string, seen_at timestamp"


def observations(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Observed calls as edge rows, each once within the watermark."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return rows.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["source_id", "target_id", "kind", "host_id"])


def as_edges(rows: DataFrame) -> DataFrame:
    """Observed calls as rows of the edge table, ``runtime`` among their observers; ends that are equal are none."""
    return rows.filter("source_id <> target_id").select(
        edge_id(F.col("source_id"), F.col("target_id"), F.col("kind"), F.col("host_id")).alias("id"),
        "source_id", "target_id", "kind", "host_id",
        F.lit("syntactic").alias("edge_precision"), F.lit("control").alias("flow_kind"), F.lit(None).cast("string").alias("data_flow_confirmed"), F.lit(None).cast("double").alias("identity_confidence"),
        F.lit("{}").alias("attributes"), F.array().cast("array<string>").alias("capabilities"), F.array(F.lit("runtime")).alias("observed_by"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"),
        F.lit(1).cast("long").alias("seq"),
    )


PARTS = 64


def store_edges(edges: DataFrame, store: str) -> None:
    """Writes edges as the first version of a store: a folder per part of the ids."""
    edges.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("part", "version").parquet(store)


def stored_edges(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The edges of a store: of each part its last version (``before`` a batch, if given)."""
    rows = spark.read.parquet(store)
    kept = rows if before is None else rows.filter(F.col("version") <= before)
    newest = kept.groupBy("part").agg(F.max("version").alias("version"))
    return kept.join(F.broadcast(newest), ["part", "version"], "left_semi").drop("part", "version")


def merge_stream(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream to its present end: each batch is merged into the edges of ``store``, as ``store_edges`` writes them.

    A batch rewrites the parts that its edges fall into, as a version of its own that is read from versions before it, so a
    repeated batch overwrites its own result and nothing is merged twice; parts it does not touch are neither read nor written.
    ``vacuum`` drops versions that are superseded.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = as_edges(batch).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).cache()
        touched = [r[0] for r in seen.select("part").distinct().collect()]  # at most PARTS
        if touched:
            rows = spark.read.parquet(store).filter(F.col("part").isin(touched) & (F.col("version") <= number))
            newest = rows.groupBy("part").agg(F.max("version").alias("version"))
            stored = rows.join(F.broadcast(newest), ["part", "version"], "left_semi").drop("part", "version")
            merged = upsert_edges(stored, seen.drop("part")).drop("n_rows")
            out = merged.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).withColumn("version", F.lit(number + 1).cast("long"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(store)
        seen.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, store: str) -> int:
    """Deletes the superseded versions of a store's parts, when no reader needs them any more; returns how many."""
    found = spark.read.parquet(store).select("part", "version").distinct()
    old = found.join(found.groupBy("part").agg(F.max("version").alias("last")), "part").filter("version < last").collect()  # folders, not rows
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in old:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/part={r.part}/version={r.version}"), True)
    return len(old)
