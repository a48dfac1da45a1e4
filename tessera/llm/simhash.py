"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits; each is the majority over the XXH64 hashes of a text's word shingles.
Fingerprints at ``distance`` k or fewer bits are linked. With the bits split into m > k blocks, a close pair agrees
on at least m - k whole blocks, so it shares one of the C(m, k) keys made of m - k blocks
each: every link is found. m is the number of blocks with the least expected work for the number of distinct
fingerprints; it changes the cost, never the result.

Equal fingerprints are collapsed before the join on blocks. A bucket (the fingerprints under one key) is not
expanded into pairs: a search compares each newly reached fingerprint with those not reached yet and gives at most
one tree link per fingerprint, so a group of near copies costs as many links as it has fingerprints. The open bits of buckets over ``limit`` are
split into blocks in the same way, which makes C(m, k) smaller buckets of each; what is still over it is cut into parts, and every pair of parts is searched by a task of its own, so no task
holds more than two parts and no link is lost. Components of the links come from ``components``.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; a
null id gets a component like any other row and is never a component's id unless the component has no
other id; rows that repeat are each returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.components import components

SEED = 42
DISTANCE = 4
LIMIT = 32_768
FEW = 16


def shingle_hashes(text: str | None, words: int, piece: int = 65_536) -> Iterator[np.ndarray]:
    """XXH64 of the ``words``-word shingles of the whole text in order, A-Z lower-cased, some at a time; none for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    h = xxhash.xxh64_intdigest
    for a in range(0, n, piece):
        yield np.array([h(line[s:e], SEED) for s, e in zip(first[a : a + piece], last[a : a + piece], strict=True)], np.uint64)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The 64 bits that are 1 in over half of all hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, piece: int = 65_536) -> int:
    """SimHash of the ``words``-word shingles of the whole text, A-Z lower-cased."""
    return majority(shingle_hashes(text, words, piece))


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, rows):
            batch = whole.slice(a, rows)
            got = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["id", "fp"])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (the fingerprint's bits as a signed long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _fingerprints(it, words), f"id {kind}, fp long")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The number of blocks with the least expected keys and comparisons a fingerprint."""
    cost = {m: comb(m, distance) * (1 + n / 2 ** (64 * (m - distance) / m)) for m in range(distance + 1, distance + 5)}
    return min(cost, key=cost.get)


def masks(m: int, distance: int = DISTANCE) -> list[int]:
    """A mask of m - distance blocks for each choice of them, as signed longs."""
    edge = [64 * i // m for i in range(m + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:], strict=False)]
    out = [sum(c) for c in combinations(block, m - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected by links among ``fps``: each reached fingerprint and the root of its search."""
    left, right = [], []
    rest = np.sort(fps)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                new = rest[near]
                rest = rest[~near]
                front += list(new)
                left.append(new)
                right.append(np.full(len(new), root))
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all buckets in arrays sorted by key."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(edge)
    left, right = [], []
    # Small buckets together: compare each row with the next, the second next and so on.
    small = np.repeat(size <= FEW, size)
    k, f = keys[small], fps[small]
    step = 1
    while step < len(k):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(f[i] ^ f[i + step]) <= distance]
        left.append(f[i + step])
        right.append(f[i])
        step += 1
    for b in np.flatnonzero(size > FEW):
        a, c = links(fps[edge[b] : edge[b + 1]], distance)
        left.append(a)
        right.append(c)
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by key; the last bucket of a batch waits for the next."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    empty = True

    def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(k, f, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        empty = False
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield out(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if not empty:
        yield out(keys, fps)


def finer(mask: int, m: int, distance: int = DISTANCE) -> list[int]:
    """Masks that split the bits that ``mask`` leaves open: fingerprints that agree under ``mask`` and are close agree under one of them too."""
    bits = [b for b in range(64) if not mask >> b & 1]
    edge = [len(bits) * i // m for i in range(m + 1)]
    block = [sum(1 << b for b in bits[a:z]) for a, z in zip(edge, edge[1:], strict=False)]
    out = [sum(c) for c in combinations(block, m - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _overfull(rows: DataFrame, limit: int) -> DataFrame:
    """``key, parts`` of the buckets over ``limit``."""
    big = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return stage(big.select("key", F.ceil(F.col("n") / limit).alias("parts")), "simhash-big")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, limit: int = LIMIT, blocks: int | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect all within ``distance`` bits."""
    m = blocks or blocks_for(fps.count(), distance)
    of = masks(m, distance)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x))) for i, x in enumerate(of)])
    rows = fps.select(F.explode(keys).alias("key"), "fp")
    big = _overfull(rows, limit)
    if big.take(1):
        hot = fps.select(F.posexplode(keys).alias("mask", "key"), "fp").join(big, "key").select("mask", "key", "fp")
        more = F.array(*[F.array(*[F.lit(x) for x in finer(x % (1 << 64), m, distance)]) for x in of])
        split = F.transform(F.get(more, "mask"), lambda x, j: F.xxhash64("key", j, F.col("fp").bitwiseAND(x)))
        hot = hot.select(F.explode(split).alias("key"), "fp")
        rest = _overfull(hot, limit)
        part = F.pmod(F.xxhash64("fp"), "parts")
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(part, j), F.greatest(part, j)))
        cut = hot.join(rest, "key").select(F.explode(pairs).alias("key"), "fp")
        rows = rows.join(big, "key", "left_anti").unionByName(hot.join(rest, "key", "left_anti")).unionByName(cut)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _search(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = DISTANCE, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component_id`` of every row; the component's id is its smallest id."""
    rows = stage(fingerprints(docs, words, id_col, text_col), "simhash-rows")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    roots = components(fingerprint_links(distinct.select("fp"), distance, limit), "simhash-links")
    of = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = of.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_key``: the id, after all others where it is null, and the text's hash. Equal keys are rows of one id and one text."""
    return docs.withColumn("_key", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates, **kw) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    A row without an id stays only where no row of its component has one; rows that repeat an id stay as one for each component.
    """
    keyed = with_key(docs, id_col, text_col)
    rows = groups(keyed.select("_key", F.col(text_col).alias("text")), id_col="_key", text_col="text", **kw)
    keep = rows.select(F.col("component_id").alias("_key")).distinct()
    return keyed.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
