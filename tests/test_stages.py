"""Stage tables write only the columns a query needs; heavy scans get tasks by their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.plans import page_queries, stages
from vitrina.plans.fixtures import tables
from vitrina.session import spread

LINKS = "<html><body><a href='https://www.facebook.com/bar1'>FB</a><a href='/contacto'>Contacto</a></body></html>"


def pages(spark, tmp_path):
    rows = [(i, f"https://site{i}.example/", LINKS) for i in range(4)] + [(4, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return tables(spark, str(tmp_path))


def test_a_link_query_writes_links_alone(spark, tmp_path):
    t = pages(spark, tmp_path)
    seen = page_queries._feats(t, "page_id", "links")
    written = {k[2]: v for k, v in stages._WRITTEN.items() if k[1] == str(tmp_path)}
    assert [spark.read.parquet(path).columns for path in written.values()] == [["page_id", "links"]]
    assert sorted(r.page_id for r in seen.collect()) == [0, 1, 2, 3, 4]


def test_columns_come_from_the_whole_table_once_written(spark, tmp_path):
    t = tables(spark, str(tmp_path))
    build = lambda: spark.range(3).selectExpr("id", "id * 2 as twice", "id * 3 as thrice")
    alone = stages.staged(t, "numbers", build, "id", "twice")
    whole = stages.staged(t, "numbers", build)
    again = stages.staged(t, "numbers", build, "id", "twice")
    assert alone.columns == again.columns == ["id", "twice"] and whole.columns == ["id", "twice", "thrice"]
    assert sorted(alone.collect()) == sorted(again.collect())
    assert again.inputFiles() == whole.inputFiles() != alone.inputFiles()


def test_many_rows_in_one_file_get_many_tasks(spark, tmp_path):
    spark.range(1000).select("id", F.lit("x").alias("html")).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    out = spread(table, rows=50)
    sizes = [len(p) for p in out.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 60 and sum(sizes) == 1000
    assert spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
