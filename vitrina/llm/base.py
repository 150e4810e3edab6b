"""Helpers shared by the operators: written intermediates, batch limits, link components."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.session import scratch_path

# white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """For operators with Python workers: the package is sent to them once, and Arrow batches are few rows.

    Few rows keep batches of long texts small in a worker's memory. The archive is made on the driver and served by Spark.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_vitrina_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(context._temp_dir, f"vitrina_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._vitrina_sent = True


def hash60(*parts) -> F.Column:
    """Nonnegative 60-bit number from the md5 of the parts; the same in any SQL engine that has md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def let(value: F.Column, use) -> F.Column:
    """``use(value)`` with the value computed once per row, also where ``use`` puts it into a lambda of its own."""
    return F.element_at(F.transform(F.array(value), use), 1)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``: the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their roots by doubling, and replaces
    the ends of the links by their roots. The links left shrink to none; every step is a join or a partial aggregate, and
    each is written, so nothing gathers a component in one task.
    """
    edges = stored(links.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    whole = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        up = stored(both.groupBy("node").agg(F.min("next").alias("m")).select(
            "node", F.least("node", "m").alias("root")), "cc-up")
        while True:
            parent = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stored(up.join(parent, "root").select("node", F.col("above").alias("root"),
                                                          (F.col("above") != F.col("root")).alias("moved")), "cc-up")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if whole is None:
            whole = up
        else:
            whole = stored(whole.join(up.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
                           .select("node", F.coalesce("above", "root").alias("root")), "cc-all")
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(a, "a").join(b, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-links")
    if whole is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return whole.select("node", F.col("root").alias("component"))
