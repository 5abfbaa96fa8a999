"""Session settings shared by tests, the bench and applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, name: str = "skeinflow") -> SparkSession:
    """A local session with the settings every plan here assumes (UTC, adaptive execution, last-wins maps)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder the cluster names in ``spark.checkpoint.dir``.

    The folder is read from the session's settings. Only a local session (tests, a bench) may go without the setting and
    gets a folder below the SQL warehouse directory; on a cluster a missing setting raises RuntimeError, as a folder of one
    machine would be lost with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint(eager)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan for a step that works hard on each: a table in fewer pieces than there are cores is dealt out to all of
    them, any other one stays where it is read. ``rows`` must not need an exchange to be made."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)
