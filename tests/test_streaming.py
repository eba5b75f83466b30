"""Streams give what the same rows give as a table."""

from pyspark.sql import functions as F

from gaugewell.operators.columns import ColumnsMissingness
from gaugewell.operators.rows import RowsMissingness
from gaugewell.streaming.missing import column_missingness, row_completeness, windowed_column_missingness


def rows_of(spark):
    n = F.col("id")
    return spark.range(200).select(n.alias("rid"), F.when(n % 3 > 0, n).alias("a"), F.when(n % 5 > 0, n.cast("double")).otherwise(F.lit(float("nan"))).alias("b"), F.timestamp_seconds(n * 60).alias("t"))


def streamed(spark, tmp_path, report, mode, name):
    table = rows_of(spark)
    for k in range(4):
        table.where(f"rid div 50 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = report(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_columns(spark, tmp_path):
    got = {r.column: (r.missing_count, r.n) for r in streamed(spark, tmp_path, column_missingness, "complete", "by_column")}
    assert got == {r.column: (r.missing_count, 200) for r in ColumnsMissingness(rows_of(spark)).summary().df.collect()}


def test_rows(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: row_completeness(s, "rid"), "complete", "by_row")
    assert sorted(map(tuple, got)) == sorted(map(tuple, RowsMissingness(rows_of(spark), "rid").completeness().df.collect()))


def test_windows(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: windowed_column_missingness(s.drop("rid"), "t", "50 minutes", "10 minutes"), "append", "by_window")
    plain = rows_of(spark).groupBy((F.col("rid") / 50).cast("int").alias("w")).agg(F.count_if(F.col("a").isNull()).alias("a"), F.count_if(F.isnan("b")).alias("b"), F.count("*").alias("n"))
    want = {(r.w, c): (r[c], r.n) for r in plain.collect() for c in ("a", "b")}
    first = min(r.start for r in rows_of(spark).select(F.window("t", "50 minutes").start.alias("start")).distinct().collect())
    found = {(int((r.start - first).total_seconds() // 3000), r.column): (r.missing_count, r.n) for r in got}
    assert found and all(want[k] == v for k, v in found.items())
