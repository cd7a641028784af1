"""Pages in WARC files: round trips, pushed filters, splits, commits, streams."""

import gzip
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from mercantile.sources import warc

PAGES = [(i, f"http{'s' * (i % 2)}://Host{i % 5}.example/{i}?q=é", f"<p>page {i} é\r\n\r\n" + "x" * (i * 37 % 500)) for i in range(200)]
ODD = [(900, None, "no link"), (901, "not a link\r\nX: y", ""), (None, "http://host1.example", None), (902, "", "\r\n\r\n")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    warc.use(spark)
    path = str(tmp_path_factory.mktemp("warc"))
    spark.createDataFrame(PAGES + ODD, "page_id long, url string, html string").repartition(3).write.format("page_warc").mode("append").save(path)
    return path


def rows(df):
    return sorted(((r["page_id"], r["url"], r["html"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("split", [500, 1 << 26])
def test_round_trip(spark, written, split):
    found = spark.read.format("page_warc").option("splitBytes", split).load(written)
    assert rows(found) == sorted(PAGES + ODD, key=str)
    assert {r["host"] for r in found.collect()} == {None, "", *(f"host{i}.example" for i in range(5))}
    assert found.rdd.getNumPartitions() == (3 if split > 10**6 else len(warc.pieces(warc.committed(written, warc.commits(written)), split)))


def test_filters_reach_the_index(spark, written):
    found = spark.read.format("page_warc").load(written).where("host in ('host1.example', 'host3.example') and page_id < 50")
    assert rows(found) == sorted([p for p in PAGES if p[0] % 5 in (1, 3) and p[0] < 50], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "host IN" not in plan.split("BatchScan")[0]  # nothing above the scan looks at hosts

    def read(filters):
        reader = warc.PageReader(written, 1 << 26)
        left = list(reader.pushFilters(filters))
        out = [x for p in reader.partitions() for x in reader.read(p)]
        return len(left), len(out), reader.records.bytes_read

    every = read([])
    assert every[1] == 204
    one = read([EqualTo(("host",), "host2.example")])
    assert one[:2] == (0, 40) and one[2] <= every[2]
    assert read([In(("host",), ("host1.example", "host2.example")), EqualTo(("host",), "host2.example"), EqualTo(("page_id",), 7)])[:2] == (1, 40)
    assert read([EqualTo(("host",), "none")]) == (0, 0, 0) and read([In(("host",), ())]) == (0, 0, 0)


def test_fewer_bytes(written, monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 0)
    reads = []
    for hosts in (None, ["host2.example"]):
        records = warc.Records(written, hosts)
        for p in warc.pieces(warc.committed(written, warc.commits(written)), 1000):
            list(records.read(p))
        reads.append(records.bytes_read)
    assert reads[1] < 0.3 * reads[0]


def test_commits(spark, tmp_path):
    """What is not committed is not seen; a failed write leaves nothing; overwriting replaces; other tools can read."""
    warc.use(spark)
    path = str(tmp_path)
    frame = spark.createDataFrame(PAGES[:20], "page_id long, url string, html string")
    frame.where("page_id < 5").write.format("page_warc").mode("append").save(path)
    stray = warc.PageWriter(path, ["page_id", "url", "html"], False)
    left = stray.write(iter([{"page_id": 1, "url": "http://a", "html": "b"}]))
    read = lambda: sorted(r["page_id"] for r in spark.read.format("page_warc").load(path).collect())
    assert read() == list(range(5))
    stray.abort([left, None])
    assert not os.path.exists(f"{path}/data/{left.name}")
    with pytest.raises(Exception, match="boom"):
        bad = F.udf(lambda x: 1 / 0 if x == 7 else "boom", "string")
        frame.withColumn("html", F.when(F.col("page_id") == 7, F.raise_error(F.lit("boom")).cast("string")).otherwise(bad("page_id"))).write.format("page_warc").mode("append").save(path)
    assert read() == list(range(5))
    frame.where("page_id >= 5").write.format("page_warc").mode("append").save(path)
    assert read() == list(range(20))
    frame.where("page_id = 9").write.format("page_warc").mode("overwrite").save(path)
    assert read() == [9] and len(warc.commits(path)) == 3
    name = warc.committed(path, warc.commits(path))[0].name
    with gzip.open(f"{path}/data/{name}") as f:
        assert f.read().startswith(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: https://Host4")


def test_stream(spark, tmp_path):
    """Each commit is read once, over restarts."""
    warc.use(spark)
    path, frame = f"{tmp_path}/w", spark.createDataFrame(PAGES[:30], "page_id long, url string, html string")
    for lo in (0, 10, 20):
        frame.where(f"page_id >= {lo} and page_id < {lo + 10}").write.format("page_warc").mode("append").save(path)
        stream = spark.readStream.format("page_warc").load(path).select("page_id", "host")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["page_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(lo + 10))


def test_readers_hand_on_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    """What a reader holds at once follows the size of pages, not their number."""
    warc.use(spark)
    rows = [(i, f"https://h{i % 3}.example/{i}", None if i == 5 else "x" * 100 * (i % 7)) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.format("page_warc").mode("append").save(str(tmp_path))
    monkeypatch.setattr(warc, "BATCH_CHARS", 2000)
    reader = warc.BatchReader(str(tmp_path), warc.SPLIT_BYTES)
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(got) > 5 and all(isinstance(b, pa.RecordBatch) and sum(len(h or "") for h in b.column(3).to_pylist()) < 2000 + 600 for b in got)
    assert sorted((r["page_id"], r["url"], r["html"]) for b in got for r in b.to_pylist()) == rows
