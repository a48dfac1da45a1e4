"""The factor store, CSV exports, manifests of archives and resumable ingest."""

from __future__ import annotations

import datetime
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the one that the cluster shares (``spark.checkpoint.dir``); a local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def columns_of(spark: SparkSession, path: str) -> list[str] | None:
    """The columns of a stored table; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path).columns if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Deletes the rows of the stored table that have a value of ``by`` that ``df`` has, and inserts ``df``: whole partitions are replaced, others are not read."""
    df.repartition(by).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def resume_from(staged: DataFrame | None, done: DataFrame | None, first: datetime.date, day: str = "report_date", again: int = 7) -> datetime.date:
    """Where an interrupted download goes on: at the first of the month of the last staged row; without staged rows ``again`` days before the last stored one; else at ``first``."""
    for table, back in ((staged, None), (done, again)):
        last = table.agg(F.max(day)).first()[0] if table is not None else None
        if last is not None:
            return max(first, last.replace(day=1) if back is None else last - datetime.timedelta(days=back))
    return first


def write_constituents(members: DataFrame, path: str) -> None:
    """Index members as one CSV, a row for each date and code, without repeats, sorted."""
    members.select("trade_date", "ts_code").distinct().orderBy("trade_date", "ts_code").coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def swap(spark: SparkSession, built: str, target: str) -> None:
    """Puts the folder ``built`` in the place of ``target``: the old one is renamed, then the new one, and the old one is deleted last. ``recover`` mends what a
    crash between leaves."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = path(_old(target))
    fs.delete(old, True)
    fs.mkdirs(path(target).getParent())
    if fs.exists(path(target)) and not fs.rename(path(target), old):
        raise OSError(f"{target} could not be renamed")
    if not fs.rename(path(built), path(target)):
        fs.rename(old, path(target))
        raise OSError(f"{built} could not be moved to {target}")
    fs.delete(old, True)


def _old(target: str) -> str:
    head, _, tail = target.rpartition("/")
    return f"{head}/.old-{tail}"


def recover(spark: SparkSession, target: str) -> None:
    """After a crash within ``swap``: where the table is missing, its old version is the table again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(target)) and fs.exists(path(_old(target))):
        fs.rename(path(_old(target)), path(target))


def build_and_swap(df: DataFrame, target: str, keys: list[str], columns: list[str] | None = None) -> None:
    """Builds a table beside ``target``, checks it (its columns, rows, null and repeated keys) and only then puts it in the place of ``target``."""
    spark = df.sparkSession
    head, _, tail = target.rpartition("/")
    building = f"{head}/.building-{tail}"
    df.write.mode("overwrite").parquet(building)
    built = spark.read.parquet(building)
    if columns is not None and built.columns != list(columns):
        raise ValueError(f"columns are {built.columns}, not {list(columns)}")
    null = F.coalesce(F.count_if(F.expr(" OR ".join(f"{k} IS NULL" for k in keys))), F.lit(0))
    rows, nulls = built.agg(F.count(F.lit(1)), null).first()
    if not rows or nulls or built.groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError(f"the built table has {rows} rows, {nulls} without a key, or repeated keys")
    recover(spark, target)
    swap(spark, building, target)


def save_factor(spark: SparkSession, path: str, name: str, values: DataFrame, first: str, last: str) -> None:
    """Replaces a factor's values between two dates, others stay; ``values``: ``trade_date, ts_code, value``.

    The store is Parquet partitioned by factor. The new partition is written beside the old one and then takes its place; the old one
    is deleted last.
    """
    target = f"{path}/factor={name}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, target)
    new = values.where(F.col("value").isNotNull() & F.col("trade_date").between(first, last)).select("trade_date", "ts_code", "value")
    if fs.exists(fs_path(target)):
        new = spark.read.parquet(target).where(~F.col("trade_date").between(first, last)).unionByName(new)
    building = f"{path}/.building-{name}"
    new.write.mode("overwrite").parquet(building)
    swap(spark, building, target)


def read_factors(spark: SparkSession, path: str, names: list[str], spine: DataFrame | None = None) -> DataFrame:
    """Factors as columns; on the rows of ``spine`` (``trade_date, ts_code``) if given. Only the named partitions are read."""
    if len(set(names)) != len(names):
        raise ValueError("a factor is named twice")
    long = spark.read.parquet(path).where(F.col("factor").isin(names))
    wide = long.groupBy("trade_date", "ts_code").pivot("factor", names).agg(F.first("value"))
    return wide if spine is None else spine.join(wide, ["trade_date", "ts_code"], "left")


def export_csv(values: DataFrame, path: str) -> None:
    """One folder a factor and stock: signal date, the next date of the range (empty for the last), raw value, neutralised value (empty).

    ``values``: ``factor, ts_code, trade_date, value``. A folder that exists is an error.
    """
    dates = values.select("trade_date").distinct()
    nxt = dates.withColumn("available_date", F.lead("trade_date").over(Window.partitionBy(F.lit(1)).orderBy("trade_date")))  # as many rows as dates
    out = values.join(F.broadcast(nxt), "trade_date").select("factor", F.col("ts_code").alias("code"), F.col("trade_date").alias("signal_date"), "available_date", F.col("value").alias("raw"), F.lit(None).cast("string").alias("neutralization"))
    out.repartition("factor", "code").sortWithinPartitions("factor", "code", "signal_date").write.partitionBy("factor", "code").mode("error").csv(path, header=True)


BARS = "zip_name string, member_path string, crc long, file_size long, ts_code string, trade_time timestamp_ntz, open double, high double, low double, close double, vol double, amount double"


CODE = re.compile(r"\d{6}\.(SH|SZ|BJ)")
FIELDS = ["open", "high", "low", "close", "vol", "amount"]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bars of rows ``path, content, done`` (what the manifest has of the archive)."""
    import numpy as np
    import pandas as pd

    for batch in batches:
        for name, content, known in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            zip_name = name.rsplit("/", 1)[-1]
            done = {x["member_path"]: (x["crc"], x["file_size"]) for x in known or []}
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in z.infolist():
                    if m.is_dir():
                        continue
                    code = m.filename.rsplit("/", 1)[-1].removesuffix(".csv")
                    if not m.filename.endswith(".csv") or not CODE.fullmatch(code):
                        raise ValueError(f"{zip_name}!{m.filename}: not a CSV of a stock's code")
                    if m.filename in done:
                        if done[m.filename] != (m.CRC, m.file_size):
                            raise ValueError(f"{zip_name}!{m.filename}: not what was ingested before")
                        continue
                    f = pd.read_csv(io.BytesIO(z.read(m)))
                    if missing := [c for c in ["trade_time", *FIELDS] if c not in f]:
                        raise ValueError(f"{zip_name}!{m.filename}: no column {missing}")
                    numbers, times = f[FIELDS].to_numpy(float), pd.to_datetime(f["trade_time"])
                    if not np.isfinite(numbers).all() or (numbers < 0).any() or (f["high"] < f[["open", "low", "close"]].max(axis=1)).any() or (f["low"] > f[["open", "high", "close"]].min(axis=1)).any():
                        raise ValueError(f"{zip_name}!{m.filename}: a bar is out of order")
                    if times.duplicated().any():
                        raise ValueError(f"{zip_name}!{m.filename}: a time comes twice")
                    year = zip_name.removesuffix(".zip")
                    if year.isdigit() and len(year) == 4 and (times.dt.year != int(year)).any():
                        raise ValueError(f"{zip_name}!{m.filename}: a time of another year")
                    keys = pd.DataFrame({"zip_name": zip_name, "member_path": m.filename, "crc": m.CRC, "file_size": m.file_size, "ts_code": code, "trade_time": times}, index=f.index)
                    table = pd.concat([keys, f[FIELDS].astype(float)], axis=1)
                    yield pa.RecordBatch.from_pandas(table.astype({"trade_time": "datetime64[us]"}), preserve_index=False)


def read_archives(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Minute bars of the CSV members of zip files; members that ``manifest`` (``zip_name, member_path, crc, file_size``) has are left out.

    A member that has changed since, that is not the CSV of a stock, or whose bars are not in order, is an error. An archive is one file and is read by one task;
    the manifest meets it there by the archive's name, whatever its size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    if manifest is None:
        rows = files.withColumn("done", F.lit(None).cast("array<struct<member_path:string,crc:bigint,file_size:bigint>>"))
    else:
        done = manifest.select("zip_name", F.struct("member_path", F.col("crc").cast("long").alias("crc"), F.col("file_size").cast("long").alias("file_size")).alias("m")).distinct().groupBy("zip_name").agg(F.collect_list("m").alias("done"))
        rows = files.withColumn("zip_name", F.element_at(F.split("path", "/"), -1)).join(done, "zip_name", "left").select("path", "content", "done")
    return rows.mapInArrow(_members, BARS)
