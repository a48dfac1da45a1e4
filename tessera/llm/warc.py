"""WARC archives with revisit records.

``resolve`` shuffles only headers by payload digest: per digest it takes the largest id
(pre-aggregated map-side, so a hot payload is one row per map task) and joins it back; the join is
skew-splittable. ``write_archives`` then makes one WARC/1.1 record per row with fresh headers:
``response`` with the payload as its block, or ``revisit`` without a block and with
``WARC-Refers-To`` naming the response. Archives are gzipped text files written by Spark's text sink, whose line
separator is the blank lines that end a WARC record, so they go to any store Spark can write, and
a lost task's files are not committed. ``read_archives`` reads them by ``Content-Length``, never by searching payloads
for separators, and unzips them piece by piece: a task holds one record at a time besides the zipped file. Archives are cut at the number of records that
has ``FILE_BYTES`` at the mean size.

Defined results: null html is an empty payload; of equal payloads the largest id is the response, and rows without an id refer to it (each
has a random record id of its own; if no row has an id, all are responses); rows that repeat an id and
payload are all written, the largest id's as responses; payloads under ``least`` bytes are
all responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch

END = "\r\n\r\n"
#: Unzipped bytes of an archive file at the mean size of a record.
FILE_BYTES = 32 << 20
# The base32 alphabet and the profile address of a revisit by identical payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload string"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hex string: five hex digits are four base32 digits."""
    parts = []
    for i in range(8):
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def headers(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, url, payload, payload_bytes, payload_digest`` of each row."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"), F.col("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("_sha1")
    )


def resolve(pages: DataFrame, least: int = 0, id_col: str = "page_id") -> DataFrame:
    """Headers and payload with ``record_type`` and ``refers_to``; of equal payloads of ``least`` bytes or more the largest id is the response."""
    rows = headers(pages, id_col)
    slim = rows.select("page_id", "_sha1", "payload_bytes").where(F.col("payload_bytes") >= least)
    original = slim.groupBy("_sha1", "payload_bytes").agg(F.max("page_id").alias("_of"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    revisits = slim.join(original, ["_sha1", "payload_bytes"]).where("NOT page_id <=> _of").groupBy("page_id", "_sha1").agg(F.max("_of").alias("refers_to"))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("_sha1").alias("_of_sha1"), "refers_to")
    out = rows.join(revisits, (F.col("_sha1") == F.col("_of_sha1")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    return out.select(
        "page_id", "url", "payload", "payload_bytes", base32_of_hex(F.col("_sha1")).alias("payload_digest"), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to"
    )


def _urn(page_id: Column) -> Column:
    """A record id that a page id determines: the same record gets the same id when a task is run again. Without a page id it is random; nothing refers to it."""
    h = F.md5(F.coalesce(F.concat(F.lit("page:"), page_id.cast("string")), F.expr("uuid()")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``value``: the whole record as text, without the blank lines that end it."""
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    fields = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", clean)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Profile", F.lit(PROFILE))),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", _urn(F.col("refers_to")))),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("Content-Type", F.lit("text/html;charset=utf-8")),
        line("Content-Length", F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
    ]
    return resolved.select(F.concat(F.concat_ws("\r\n", *fields), F.lit(END), F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")).alias("value"))


def write_archives(resolved: DataFrame, path: str, records_per_file: int = 2_000) -> None:
    """Writes the records to gzipped text files at ``path``, at most ``records_per_file`` in each."""
    records(resolved).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def records_for(pages: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """How many records of the pages' mean size make ``file_bytes``."""
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    return max(1, file_bytes * n // (size + 600 * n)) if n else 1


class _Bytes:
    """The start of what is left of unzipped bytes, read ``piece`` zipped bytes at a time."""

    def __init__(self, data: pa.Buffer | bytes, zipped: bool, piece: int = 1 << 18):
        self.data, self.at, self.piece = memoryview(data), 0, piece
        self.open = zlib.decompressobj(31) if zipped else None
        self.held = bytearray()

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + self.piece]
        self.at += len(part)
        if self.open is None:
            self.held += part
            return True
        while len(part):
            self.held += self.open.decompress(part)
            part = self.open.unused_data
            if self.open.eof:  # another member of the archive follows
                self.open = zlib.decompressobj(31)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is taken too; None at the end."""
        seen = 0
        while (cut := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.held[:cut])
        del self.held[: cut + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: pa.Buffer | bytes, zipped: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, one record at a time."""
    left = _Bytes(data, zipped)
    while (head := left.upto(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = left.take(int(fields["Content-Length"]))
        if left.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.string())])
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for content in batch.column("content"):
            held = 0
            for head, block in parse(content.as_buffer(), zipped=True):
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                to = head.get("X-Refers-To-Page-Id")
                if to is None and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                    raise ValueError(f"record {head['WARC-Record-ID']}: the payload does not have its digest")
                page = head.get("X-Page-Id")
                rows.append((head["WARC-Type"], head["WARC-Record-ID"], None if page is None else int(page), head.get("WARC-Target-URI"), digest, int(head["X-Payload-Length"]), None if to is None else int(to), block.decode() if with_payload and to is None else None))
                held += len(block) * with_payload
                if len(rows) >= 5_000 or held >= FILE_BYTES:
                    yield made()
                    held = 0
    yield made()


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record (``RECORDS``); the digests of all payloads are checked. A revisit has no payload of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(lambda it: _read(it, with_payload), RECORDS)


def archive(pages: DataFrame, path: str | None = None, least: int = 0, id_col: str = "page_id") -> DataFrame:
    """Resolves revisits, writes the archives and returns what they hold, read back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(resolve(pages, least, id_col), path, records_for(pages))
    return read_archives(spark, path)
