"""The Python data source: partitions, streams with offsets, and writers."""

import pytest

from pipeops import sources


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    sources.register(spark)
    made = spark.range(3000).selectExpr("id", "CAST(id AS STRING) AS s", "if(id % 3 = 0, NULL, id / 2) AS x", "TIMESTAMP_NTZ'2024-01-01' AS t")
    home = str(tmp_path / "table")
    made.repartition(3).write.option("parquet.block.size", 2000).parquet(home)
    return made, home


def test_batch_reading_has_a_partition_per_row_group(spark, table):
    made, home = table
    df = sources.read_generic(spark, "row_groups", {"path": home})
    assert df.schema == made.schema and rows(df) == rows(made)
    used = df.selectExpr("spark_partition_id() AS p").distinct().count()
    assert used >= 3
    assert rows(sources.read_generic(spark, "row_groups", {"path": home}, schema="s string, id long")) == rows(made.select("s", "id"))


def test_writing_appends_and_overwrites(spark, table, tmp_path):
    made, _ = table
    out = str(tmp_path / "out")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        made.repartition(4).write.format("row_groups").mode(mode).save(out)
        assert rows(sources.read_generic(spark, "row_groups", {"path": out}).select("id")) == sorted([(i,) for i in range(3000)] * times)
    assert not list((tmp_path / "out").glob("*.staged"))
    empty = sources.read_generic(spark, "row_groups", {"path": str(tmp_path / "none")}, schema="id long")
    assert empty.count() == 0
    with pytest.raises(Exception, match="give a schema"):
        sources.read_generic(spark, "row_groups", {"path": str(tmp_path / "none")})


def test_stream_takes_new_files_only_and_its_sink_repeats_safely(spark, tmp_path):
    sources.register(spark)
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).write.format("row_groups").mode("append").save(feed)
        df = sources.read_generic(spark, "row_groups", {"path": feed}, streaming=True)
        query = df.writeStream.format("row_groups").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert rows(sources.read_generic(spark, "row_groups", {"path": out})) == [(n,) for n in range(10 * i + 10)]
