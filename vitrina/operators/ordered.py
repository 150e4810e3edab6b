"""Lists that leave the engine in their order: dense positions, and files whose parts follow each other.

A list is dealt into key ranges, each sorted on its own and written once to the shared folder, so that positions are read from
fixed data: a part's first position comes from the number of rows before it. No task sorts or holds the whole list.

An exported file is a folder of text parts which, put one after the other by name, are the file. Every run writes a folder of
its own and enters it in the manifest when all its parts stand, so readers never see half a file: a run that breaks off leaves
the last one in place, and a run repeated under its name leaves one file with the same content.

Ties in the given order fall by the remaining columns where ``order`` does not settle them: state an id last. NULLs stand where
the order puts them. An empty list gives a file with its head (and, in JSON, its end).
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import export as EX

ROWS_PER_PART = 1_000_000
MARK = "﻿"
ENDING = {"csv": "\r\n", "json": "\n"}
_PART, _AT = "_part", "_at"
_MANIFEST = "run string, format string, generated_at timestamp, count bigint"


def in_order(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows`` with ``position`` from 1 in ``order``, read back from the shared folder.

    ``parts`` is the number of key ranges (by default that of the session's shuffles); equal keys stay in one range, so the order should
    end with an id.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ordered")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        *[F.col(f"`{c}`") for c in rows.columns], F.spark_partition_id().alias(_PART), local.alias(_AT)
    ).write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    sizes = written.groupBy(_PART).agg(F.count("*").alias("_n"))
    # one row per key range
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return written.join(F.broadcast(starts), _PART).select(
        *[F.col(f"`{c}`") for c in rows.columns], (F.col("_start") + F.col(_AT) + 1).alias("position"))


def first(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, parts: int | None = None) -> DataFrame:
    """``limit`` rows after the first ``offset`` with their ``position``, however large both are."""
    return in_order(rows, order, parts).where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def csv_text(listed: DataFrame, delimiter: str = ";") -> DataFrame:
    """(position, line): the head with the byte-order mark at 0, then the cells of every export row."""
    body = listed.select(
        "position", F.concat_ws(delimiter, *[EX.csv_cell(F.col(c), delimiter) for c in EX.EXPORT_COLUMNS]).alias("line"))
    return _head(listed, MARK + delimiter.join(EX.EXPORT_COLUMNS)).unionByName(body)


def json_text(listed: DataFrame, generated_at: Column, count: int) -> DataFrame:
    """(position, line): one JSON document with its time, its count and a line per export row."""
    cells = F.to_json(F.struct(*EX.EXPORT_COLUMNS), {"ignoreNullFields": "false"})
    body = listed.select("position", F.concat(cells, F.when(F.col("position") < count, ",").otherwise("")).alias("line"))
    stamp = F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = F.concat(F.lit('{"generatedAt":"'), stamp, F.lit(f'","count":{count},"rows":['))
    return _head(listed, head).unionByName(body).unionByName(_head(listed, "]}", count + 1))


def _head(listed: DataFrame, text: str | Column, position: int = 0) -> DataFrame:
    one = listed.sparkSession.range(1)
    return one.select(F.lit(position).cast("bigint").alias("position"), (F.lit(text) if isinstance(text, str) else text).alias("line"))


def write_parts(lines: DataFrame, last: int, path: str, ending: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Text parts in the order of ``position`` (0 to ``last``), each of ``rows_per_part`` consecutive lines.

    A line's part follows from its position, so nothing is sampled and the parts' names rise with their lines.
    """
    part = F.floor(F.col("position") / rows_per_part).cast("int")
    lines.repartitionById(last // rows_per_part + 1, part).sortWithinPartitions("position").select(
        F.col("line").alias("value")).write.mode("overwrite").option("lineSep", ending).text(path)


def export_file(business: DataFrame, findings: DataFrame, contacts: DataFrame, order: list[Column], path: str, generated_at: Column,
                form: str = "csv", delimiter: str = ";", limit: int | None = None, run: str | None = None,
                rows_per_part: int = ROWS_PER_PART) -> str:
    """Write the export rows of ``business`` in ``order`` as one file under ``path``; gives the run's name.

    ``limit`` keeps the first rows of the list, as a caller asks; by default all are written. It is applied to the list, ahead of the
    joins with findings and contacts.
    """
    if form not in ("csv", "json"):
        raise ValueError(f"no such format: {form}")
    run = run or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run) or run in (".", "..", "manifest"):
        raise ValueError(f"not a run's name: {run}")
    listed = in_order(business, order) if limit is None else first(business, order, limit)
    count = listed.count()
    rows = EX.export_rows(listed, findings, contacts, keep=("position",))
    if form == "csv":
        write_parts(csv_text(rows, delimiter), count, f"{path}/{run}", ENDING[form], rows_per_part)
    else:
        write_parts(json_text(rows, generated_at, count), count + 1, f"{path}/{run}", ENDING[form], rows_per_part)
    business.sparkSession.range(1).select(
        F.lit(run).alias("run"), F.lit(form).alias("format"), generated_at.cast("timestamp").alias("generated_at"),
        F.lit(count).cast("bigint").alias("count"),
    ).write.mode("append").json(f"{path}/manifest")
    return run


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, format, generated_at, count) of every complete file under ``path``, newest first."""
    try:
        entered = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)
    return entered.groupBy("run").agg(
        *[F.max_by(c, "generated_at").alias(c) for c in ("format", "generated_at", "count")]
    ).orderBy(F.col("generated_at").desc(), "run")


def file_lines(spark: SparkSession, path: str, run: str, form: str = "csv") -> DataFrame:
    """(part, line) of a written file; the parts' numbers rise as their names do."""
    return spark.read.option("lineSep", ENDING[form]).text(f"{path}/{run}").select(
        F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint").alias("part"), F.col("value").alias("line"))
