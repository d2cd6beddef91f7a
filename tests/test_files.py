"""Files that tasks write, list and read, however many there are."""

from pathlib import Path

from pyspark.sql import functions as F

from gridweave.plans import source_queries
from gridweave.sources import completions, files


def test_tasks_write_and_list_markers(spark, tmp_path):
    n = 5000  # more than one task writes and lists
    names = F.when(F.col("id") % 3 == 0, F.array(F.lit("FAIL"), F.lit("SUCCESS"))).otherwise(F.array(F.lit("FAIL")))
    each = spark.range(n).select("id", F.explode(names).alias("name"))
    marks = each.select(F.concat(F.lit(f"{tmp_path}/o/s"), "id", F.lit("/marks/"), "name").alias("path"), F.lit(None).cast("string").alias("value"))
    assert files.write_files(marks, "path", "value") == n + -(-n // 3)
    (tmp_path / "o/s0/marks/other").touch()
    (tmp_path / "o/stray").touch()
    assert (tmp_path / "o/s3/marks/SUCCESS").stat().st_size == 0
    got = {r.job_id: r.status for r in completions.scan_markers(spark, str(tmp_path / "o")).collect()}
    assert got == {f"s{i}": "Failed" if i % 3 else "Succeeded" for i in range(n)}
    assert completions.scan_markers(spark, str(tmp_path / "none")).count() == 0


def test_a_file_is_written_whole_by_its_path(spark, tmp_path):
    rows = [(f"{tmp_path}/w/{i % 7}/d.csv", f"{i:03}") for i in range(100)] + [(None, "lost"), (f"{tmp_path}/w/0/d.csv", None)]
    given = spark.createDataFrame(rows, "path string, line string")
    assert files.write_files(given, "path", "line", "n") == files.write_files(given.repartition(5), "path", "line", "n") == 7
    for i in range(7):
        assert [p.name for p in Path(f"{tmp_path}/w/{i}").iterdir()] == ["d.csv"] and Path(f"{tmp_path}/w/{i}/d.csv").read_text().split() == ["n", *(f"{k:03}" for k in range(i, 100, 7))]
    got = files.read_files(files.find_files(given.filter("path is not null").select("path").distinct()))
    assert got.count() == 107 and got.rdd.getNumPartitions() == 1


def test_queries_over_many_files_take_no_step_for_each_on_the_driver(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    assert source_queries.a8_scan_markers(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    writes = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.csv", lambda *a, **k: writes.append(a))  # its commit renames each file on the driver
    got = source_queries.a6_load_results(spark, sf_dir)
    none = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 10 = 0").count()
    assert not writes and got.filter("not missing").count() == spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_custkey % 10 > 0").count() and got.filter("missing").count() >= none
