import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import store
from tessera.streaming import ingest


def test_factor_store_replaces_a_range(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = [("20240101", "a", 1.0), ("20240102", "a", 2.0), ("20240103", "a", None)]
    frame = lambda r: spark.createDataFrame(r, "trade_date string, ts_code string, value double")
    store.save_factor(spark, path, "MA", frame(rows), "20240101", "20240131")
    store.save_factor(spark, path, "ROC", frame(rows[:1]), "20240101", "20240131")
    store.save_factor(spark, path, "MA", frame([("20240102", "a", 5.0)]), "20240102", "20240131")
    got = store.read_factors(spark, path, ["MA", "ROC"]).orderBy("trade_date").collect()
    assert [tuple(r) for r in got] == [("20240101", "a", 1.0, 1.0), ("20240102", "a", 5.0, None)]
    with pytest.raises(ValueError):
        store.read_factors(spark, path, ["MA", "MA"])


def test_export(spark, tmp_path):
    path = f"file://{tmp_path}/csv"
    df = spark.createDataFrame([("MA", "a", "20240101", 1.0), ("MA", "a", "20240102", 2.0)], "factor string, ts_code string, trade_date string, value double")
    store.export_csv(df, path)
    got = spark.read.option("header", True).csv(path).orderBy("signal_date").collect()
    assert [(str(r.signal_date), r.available_date and str(r.available_date), r.code) for r in got] == [("20240101", "20240102", "a"), ("20240102", None, "a")]
    with pytest.raises(Exception):
        store.export_csv(df, path)


def test_archives_resume(spark, tmp_path):
    body = "trade_time,open,high,low,close,vol,amount\n2024-01-02 09:31:00,1,2,0.5,1.5,10,15\n"
    with zipfile.ZipFile(tmp_path / "2024.zip", "w") as z:
        z.writestr("2024/000001.SZ.csv", body)
        z.writestr("2024/000002.SZ.csv", body)
    bars = store.read_archives(spark, f"file://{tmp_path}")
    assert sorted(r.ts_code for r in bars.collect()) == ["000001.SZ", "000002.SZ"]
    done = bars.where("ts_code = '000001.SZ'").select("zip_name", "member_path", "crc", "file_size")
    assert [r.ts_code for r in store.read_archives(spark, f"file://{tmp_path}", done).collect()] == ["000002.SZ"]
    changed = done.withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="ingested before"):
        store.read_archives(spark, f"file://{tmp_path}", changed).collect()
    for member, text, message in (("notes.csv", body, "not a CSV"), ("000003.SZ.csv", body.replace("2024", "2023"), "another year"), ("000003.SZ.csv", body.replace("1,2,0.5", "1,2,1.8"), "out of order")):
        folder = tmp_path / message.replace(" ", "-")
        folder.mkdir()
        with zipfile.ZipFile(folder / "2024.zip", "w") as z:
            z.writestr(member, text)
        with pytest.raises(Exception, match=message):
            store.read_archives(spark, f"file://{folder}").collect()


def test_build_and_swap(spark, tmp_path):
    target = f"file://{tmp_path}/table"
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    store.build_and_swap(frame([(1, "a")]), target, ["k"], ["k", "v"])
    for bad in ([(1, "a"), (1, "b")], [(None, "a")], []):
        with pytest.raises(ValueError):
            store.build_and_swap(frame(bad), target, ["k"])
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [(1, "a")]  # what fails its checks changes nothing
    store.build_and_swap(frame([(2, "c")]), target, ["k"])
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [(2, "c")]
    (tmp_path / "table").rename(tmp_path / ".old-table")  # a crash between the two renames
    store.recover(spark, target)
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [(2, "c")]


def test_stream_upserts(spark, tmp_path):
    src, target = f"file://{tmp_path}/src", f"file://{tmp_path}/target"
    schema = "k int, v string"
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(src), target, f"file://{tmp_path}/ck", ["k"]).awaitTermination()
    assert sorted(map(tuple, ingest.latest_version(spark, target).collect())) == [(1, "a"), (2, "c"), (3, "d")]
