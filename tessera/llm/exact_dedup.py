"""Exact deduplication by an extendible-hash index on shared files (DataFrame operations only).

Every text is normalised by deleting ``[\\x20\\x09-\\x0D]``; texts are equal when the
normalised bytes are equal. The index is made in these steps:

1. *Pages.* Copies are collapsed map-side and then by hash: grouping on the 64-bit key, the
   digest, the length and the normalised text itself compares the bytes, so a hot group of copies leaves
   each map task as one row per original length. Texts are dropped after this comparison.
2. *Directory.* A histogram of the first ``max_depth`` bits of the keys (at most
   ``2 ** max_depth`` rows) goes to the driver. The directory starts with one bucket; an
   overfull bucket is split on its next bit, and the directory doubles when the bucket already
   uses every directory bit. A bucket that is still overfull at ``max_depth`` keeps an overflow
   chain: it is longer, nothing is lost.
3. *Index files.* Entries are range-partitioned by (bucket, key), so each owner task holds a range
   of keys, sorted, and chains the entries that collide on a key; it is written as Parquet in the shared folder.
4. *Probe.* Slim rows (no text) of all documents find their bucket through the directory and walk the chain of their key there, by digest.
   Entries whose texts differ though key and digest are equal are marked in the index; only the documents of such an entry are probed with their normalised
   bytes, against the bytes in the overflow file.

Defined results: null text counts as empty; a null ``doc_id`` loses ties against any other and
can stay only when the longest texts of its class have no id; rows that repeat a whole row share its decision
(``deduplicate`` then keeps one of them); an empty table gives an empty table. Other columns are ignored by
``duplicates`` and passed on by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stage, whole

CAPACITY = 65_536
MAX_DEPTH = 16
Hash = Callable[[Column | str], Column]


def build_directory(histogram: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int], list[int]]:
    """Splits overfull buckets and doubles the directory.

    ``histogram`` counts entries by the first ``max_depth`` bits of their key. Returns the global
    depth, the bucket of each directory slot, and each bucket's local depth.
    """
    depth, slots, local, loads = 0, [0], [0], [dict(histogram)]
    todo = [0]
    while todo:
        b = todo.pop()
        if sum(loads[b].values()) <= capacity or local[b] == max_depth:
            continue
        if local[b] == depth:
            slots = [s for s in slots for _ in range(2)]
            depth += 1
        local[b] += 1
        shift = max_depth - local[b]
        new = len(local)
        local.append(local[b])
        loads.append({p: n for p, n in loads[b].items() if p >> shift & 1})
        loads[b] = {p: n for p, n in loads[b].items() if not p >> shift & 1}
        for s in range(len(slots)):
            if slots[s] == b and s >> (depth - local[b]) & 1:
                slots[s] = new
        todo += [b, new]
    return depth, slots, local


def _normal(text_col: str) -> Column:
    return F.regexp_replace(whole(text_col), r"[\x20\x09-\x0D]+", "")


class Index:
    """The index of a table: ``entries`` (``_bucket, _key, _chain, _sha, _keep_id, _keep_len, _n``; ``_chain`` null: see ``overflow``), ``overflow``
    (entries of texts that differ under one digest, with their bytes in ``_norm``; None if there are none), and the directory.

    ``key`` and ``digest`` make a 64-bit key and a digest of normalised bytes.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key: Hash = F.xxhash64, digest: Hash = lambda c: F.sha2(c, 256)):
        self.id_col, self.text_col, self.key, self.digest = id_col, text_col, key, digest
        spark = docs.sparkSession
        pages = (
            self.rows(docs)
            .groupBy("_key", "_sha", "_norm", "_len")
            .agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
            .select("_key", "_sha", F.md5("_norm").alias("_check"), "_len", "_id", "_n")
        )
        pages = stage(pages, "exact-pages")
        prefix = F.shiftrightunsigned("_key", 64 - max_depth)
        histogram = {r[0]: r[1] for r in pages.groupBy(prefix.alias("p")).count().collect()}
        self.depth, self.slots, _ = build_directory(histogram, capacity, max_depth)
        owners = max(len(set(self.slots)), int(spark.conf.get("spark.sql.shuffle.partitions")))
        owned = self.located(pages).repartitionByRange(owners, "_bucket", "_key")
        # Rows of one class differ in the original length only.
        classes = owned.groupBy("_bucket", "_key", "_sha").agg(*self.best(), F.min("_check").alias("_lo"), F.max("_check").alias("_hi"))
        number = F.row_number().over(Window.partitionBy("_bucket", "_key").orderBy("_sha"))
        chain = F.when(F.col("_lo") == F.col("_hi"), number)
        self.entries = stage(classes.select("_bucket", "_key", chain.alias("_chain"), "_sha", F.col("_b._id").alias("_keep_id"), F.col("_b._len").alias("_keep_len"), "_n"), "exact-index")
        self.overflow = None
        mixed = self.entries.where("_chain IS NULL").select("_bucket", "_key", "_sha")
        if mixed.take(1):
            texts = self.located(self.rows(docs)).withColumn("_n", F.lit(1)).join(mixed, ["_bucket", "_key", "_sha"], "left_semi")
            found = texts.groupBy("_bucket", "_key", "_sha", "_norm").agg(*self.best())
            self.overflow = stage(found.select("_bucket", "_key", "_sha", "_norm", F.col("_b._id").alias("_keep_id"), F.col("_b._len").alias("_keep_len"), "_n"), "exact-overflow")

    @staticmethod
    def best() -> list[Column]:
        """The row that stays, and the number of rows."""
        return [F.max_by(F.struct("_id", "_len"), F.struct("_len", F.col("_id").isNotNull(), -F.col("_id"))).alias("_b"), F.sum("_n").alias("_n")]

    def rows(self, docs: DataFrame) -> DataFrame:
        rows = docs.select(F.col(self.id_col).alias("_id"), F.char_length(whole(self.text_col)).cast("long").alias("_len"), _normal(self.text_col).alias("_norm"))
        return rows.withColumns({"_key": self.key("_norm"), "_sha": self.digest("_norm")})

    def located(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket to which the directory sends their key."""
        # At most 2 ** max_depth rows: the bound that allows the broadcast.
        directory = rows.sparkSession.createDataFrame(list(enumerate(self.slots)), "_slot long, _bucket int")
        slot = F.shiftrightunsigned("_key", 64 - self.depth) if self.depth else F.lit(0).cast("long")
        return rows.withColumn("_slot", slot).join(F.broadcast(directory), "_slot").drop("_slot")

    def probe(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The ``columns`` of rows (``_key, _sha, _norm`` and others) with ``_keep_id, _keep_len, _n`` of their entry."""
        here = ["_bucket", "_key", "_sha"]
        found = ["_keep_id", "_keep_len", "_n"]
        sent = self.located(rows)
        out = sent.select(*here, *columns).join(self.entries.where("_chain IS NOT NULL").select(*here, *found), here).select(*columns, *found)
        if self.overflow is None:
            return out
        # Bytes are compared where digests do not tell texts apart.
        return out.unionByName(sent.select(*here, "_norm", *[c for c in columns if c not in here]).join(self.overflow, [*here, "_norm"]).select(*columns, *found))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index: object) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``."""
    made = Index(docs, id_col, text_col, **index)
    rows = made.rows(docs).withColumn("_sha256", F.col("_sha") if "digest" not in index else F.sha2("_norm", 256))
    kept = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_len") == F.col("_keep_len"))
    return made.probe(rows, "_id", "_len", "_sha256").select(
        F.col("_id").alias(id_col), F.col("_keep_id").alias("keep_id"), F.col("_n").alias("group_size"), kept.alias("kept"), F.col("_sha256").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index: object) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names."""
    made = Index(docs, id_col, text_col, **index)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.char_length(whole(text_col)).cast("long").alias("_len"), _normal(text_col).alias("_norm"))
    rows = rows.withColumns({"_key": made.key("_norm"), "_sha": made.digest("_norm")})

    def stays(entries: DataFrame, *columns: str) -> DataFrame:
        keys = ["_key", "_sha", *columns]
        one, two = rows.select("_row", "_id", "_len", *keys).alias("one"), entries.alias("two")
        same = F.col("one._id").eqNullSafe(F.col("two._keep_id")) & (F.col("one._len") == F.col("two._keep_len"))
        for c in keys:
            same &= F.col(f"one.{c}") == F.col(f"two.{c}")
        # At most the repeated rows of one id are left in a class.
        return one.join(two, same, "left_semi").dropDuplicates(keys).select("_row.*")

    out = stays(made.entries.where("_chain IS NOT NULL"))
    return out if made.overflow is None else out.unionByName(stays(made.overflow, "_norm"))
