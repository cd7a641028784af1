"""Excel workbooks: round trips of all kinds of cells, sheets, commits."""

import zipfile
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mercantile.sources import xlsx

SCHEMA = "i long, x double, t string, b boolean, d date, ts timestamp_ntz, m decimal(12,2)"
ROWS = [
    (1, 1.5, "a <b> & \"c\" 'd' é 漢", True, date(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5, 678), Decimal("12.30")),
    (None, None, None, None, None, None, None),
    (-(2**53), 0.1 + 0.2, "", False, date(1970, 1, 1), datetime(1999, 12, 31), Decimal("-0.01")),
    (3, 1e300, " two\n lines\t\r\x00\x0b _x0041_ _x ", True, None, None, None),
    (4, float("inf"), "=1+1", None, None, None, None),
]


def test_round_trip(spark, tmp_path):
    xlsx.use(spark)
    frame = spark.createDataFrame(ROWS * 3, SCHEMA).coalesce(1)
    frame.write.format("xlsx").option("sheetRows", 4).mode("append").save(f"{tmp_path}/x")
    back = spark.read.format("xlsx").schema(SCHEMA).load(f"{tmp_path}/x")
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    book = next(Path(f"{tmp_path}/x").glob("*.xlsx"))
    with zipfile.ZipFile(book) as z:
        assert z.testzip() is None and sum(n.startswith("xl/worksheets/sheet") for n in z.namelist()) == 5


def test_commits(spark, tmp_path):
    xlsx.use(spark)
    path = f"{tmp_path}/x"
    frame = spark.range(10).select("id", F.col("id").cast("string").alias("t"))
    read = lambda: sorted(r[0] for r in spark.read.format("xlsx").schema("id long, t string").load(path).collect())
    frame.where("id < 4").write.format("xlsx").mode("append").save(path)
    with pytest.raises(Exception, match="boom"):
        frame.withColumn("t", F.when(F.col("id") == 7, F.raise_error(F.lit("boom")).cast("string")).otherwise("x")).write.format("xlsx").mode("append").save(path)
    assert read() == [0, 1, 2, 3]
    frame.where("id >= 4").write.format("xlsx").mode("append").save(path)
    assert read() == list(range(10))
    frame.limit(0).write.format("xlsx").mode("overwrite").save(path)
    assert read() == []


def test_column_names():
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.column_number(f"{xlsx.column_name(i)}7") == i for i in range(2000))


def test_rows_are_streamed(tmp_path):
    """A sheet is read without a tree of its rows, whose memory would grow with them."""
    import tracemalloc

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.StringType())])
    writer = xlsx.XlsxWriter(f"file://{tmp_path}", schema, False, xlsx.SHEET_ROWS)
    writer.commit([writer.write((i, f"_x0041_ {i}") for i in range(20_000))])
    reader = xlsx.XlsxReader(f"file://{tmp_path}", schema)
    book = reader.partitions()[0]
    tracemalloc.start()
    try:
        assert all(row == (i, f"_x0041_ {i}") for i, row in enumerate(reader.read(book)))
        assert sum(1 for _ in reader.read(book)) == 20_000
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
