"""Session defaults and the shared scratch folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPREAD_ROWS = 5000  # rows of a spread table in one task


def builder(app: str = "vitrina", master: str | None = None) -> SparkSession.Builder:
    """Settings the library relies on; cluster size and memory stay with the caller."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # wide column lists are built by many small calls; do not record a stack for each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    return b.master(master) if master else b


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only where it is unset and the session is a local one, with no other machine, is a temporary folder made and recorded.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        existing = spark.sparkContext.getCheckpointDir()
        if not existing and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = existing or tempfile.mkdtemp(prefix="vitrina-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Deal a plain file scan to at least one partition per core, and to one per ``rows`` rows, ahead of heavy per-row work.

    A file's splits follow its bytes and its row groups, so one task may get very many small rows. A table of enough splits is
    returned as it is; the count reads file footers only.
    """
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows))
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan
