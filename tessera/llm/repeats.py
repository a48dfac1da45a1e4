"""Removing passages that repeat across documents, by suffix arrays.

A byte goes if a ``least``-byte string that covers it also starts in a document with a smaller id. All strings are
those of the input.

*Distribution.* Every ``least``-byte string is assigned to the smallest hash among its ``GRAM``-byte
substrings (its anchor). Equal strings have equal anchors, so they meet in one owner. Neighbouring strings mostly
share an anchor and travel as one run, so a byte of text costs about 3.4 bytes before compression
instead of the ``least`` bytes of a suffix prefix. A map task sorts its documents by id and sends
a run that it holds several times only for the smallest document; its other documents have their answer at once, so hot
passages and copies are pre-aggregated. There are ``OWNERS`` owners or more, as many as keep an owner's text near ``OWNER_BYTES``.

*Owners.* Runs whose anchor no other run has cannot repeat and are passed by. Equal runs of several
documents answer all but the smallest. The distinct runs of an anchor that has several are joined to one
string, whose suffix array is made by the difference-cover algorithm (``suffix_array``: sort sampled
triples, recurse on names, merge the other suffixes); adjacent suffixes that agree on ``least`` bytes are
one class, and a class tells its runs which smaller document has the string.

*Result.* Covered stretches, a few numbers for each document and owner, are joined to the documents.

Defined results: a null text is empty; a null id is larger than any other; rows that repeat an id
count as one document (they do not cover each other); texts under ``least`` bytes lose nothing; an empty table gives an
empty table; other columns are passed on by ``deduplicate`` and ignored by ``removed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.suffix_array import suffix_array

LEAST = 50
GRAM = 12
OWNER_BYTES = 48 << 20
GROWTH = 3.6
OWNERS = 64
HELD = 12 << 20
LONGEST = 256
NO_ID = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position on (the last ones read zeros)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    u = np.lib.stride_tricks.as_strided(padded, (n + GRAM, 8), (1, 1)).copy().view("<u8").ravel()
    h = u[:n] * np.uint64(0x9E3779B97F4A7C15)
    v = u[GRAM - 8 : n + GRAM - 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= v >> np.uint64(23)
    h += v
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, least: int) -> np.ndarray:
    """The least gram hash within each ``least``-byte string of ``data``."""
    m = gram_hashes(data)[: len(data) - GRAM + 1]
    width, step = least - GRAM + 1, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (width - step)], m[width - step :]) if width > step else m


def runs(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive, in bytes) and anchors of the runs of a text of ``least`` bytes or more."""
    m = anchors(np.frombuffer(text, np.uint8), least)
    new = np.flatnonzero(m[1:] != m[:-1]) + 1
    a, b = np.concatenate([[0], new]), np.concatenate([new, [len(m)]])
    if (b - a).max() > LONGEST:
        parts = -(-(b - a) // LONGEST)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = np.repeat(a, parts) + within * LONGEST, np.minimum(np.repeat(b, parts), np.repeat(a, parts) + (within + 1) * LONGEST)
    return a, b + least - 1, m[a]


def _pack(arrays: list[np.ndarray], text: bytes, level: int = 5) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays], *[a.dtype.itemsize for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays) + text)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    at, out = 8 * (1 + 2 * n), []
    for size, width in zip(head[1 : n + 1], head[n + 1 :], strict=True):
        out.append(np.frombuffer(raw, f"<i{width}", size, at))
        at += int(size * width)
    return out, raw[at:]


SENT = pa.schema([("owner", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("data", pa.binary())])
SENT_SQL = "owner int, id long, mark long, data binary"


class _Sender:
    """Runs of some documents, by owner, and answers that need no owner."""

    def __init__(self, owners: int, least: int):
        self.owners, self.least = owners, least
        self.seen: dict[bytes, int] = {}
        self.docs: list[tuple[int, int]] = []
        self.rows: list[tuple[list[int], list[int], list[bytes]]] = [([], [], []) for _ in range(owners)]
        self.answers: list[tuple[int, int, bytes]] = []

    def add(self, doc: int, mark: int, text: bytes) -> None:
        """Documents must come in the order of their ids."""
        if len(text) < self.least:
            return
        at = len(self.docs)
        self.docs.append((doc, mark))
        spans: list[int] = []
        start, end, anchor = runs(text, self.least)
        owner = (anchor % np.uint64(self.owners)).tolist()
        docs, seen, rows = self.docs, self.seen, self.rows
        for a, b, o in zip(start.tolist(), end.tolist(), owner, strict=True):
            s = text[a:b]
            first = seen.setdefault(s, at)
            if docs[first][0] < doc:
                spans += (a, b)
            else:
                mine = rows[o]
                mine[0].append(at)
                mine[1].append(a)
                mine[2].append(s)
        if spans:
            self.answers.append((doc, mark, np.array(spans, np.int64).tobytes()))

    def flush(self) -> Iterator[pa.RecordBatch]:
        owner, data = [], []
        docs = np.array(self.docs, np.int64).reshape(-1, 2)
        for o, (at, start, text) in enumerate(self.rows):
            if text:
                used, short = np.unique(np.array(at, np.int64), return_inverse=True)
                delta = np.diff(np.array(start, np.int64), prepend=0)  # small within a document
                size = np.fromiter(map(len, text), np.int16, len(text))
                fit = np.int32 if np.abs(delta).max() < 2**31 else np.int64
                owner.append(o)
                data.append(_pack([np.diff(docs[used, 0], prepend=0), docs[used, 1], np.diff(short, prepend=0).astype(np.int16 if len(used) < 2**15 else np.int32), delta.astype(fit), size], b"".join(text)))
                self.rows[o] = ([], [], [])
        empty = [None] * len(owner)
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(empty, pa.int64()), pa.array(empty, pa.int64()), pa.array(data, pa.binary())], schema=SENT)
        if self.answers:
            i, m, b = zip(*self.answers, strict=True)
            to = [(x ^ y) % self.owners for x, y in zip(i, m, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(i, pa.int64()), pa.array(m, pa.int64()), pa.array(b, pa.binary())], schema=SENT)


def _send(batches: Iterator[pa.RecordBatch], owners: int, least: int) -> Iterator[pa.RecordBatch]:
    """Runs of the documents; the documents held at once are those of about ``HELD`` bytes of runs."""
    waiting: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        waiting.sort(key=lambda r: r[0])
        sender = _Sender(owners, least)
        for r in waiting:
            sender.add(*r)
        yield from sender.flush()

    for batch in batches:
        for i, m, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = (t or "").encode("utf-8", "surrogatepass")
            waiting.append((NO_ID if i is None else i, m, text))
            size += len(text)
            if size >= HELD:
                yield from out()
                waiting, size = [], 0
    yield from out()


def repeated(strings: list[bytes], owner: np.ndarray, least: int) -> dict[int, np.ndarray]:
    """For distinct strings with their smallest documents: the starts, within each string, of the
    ``least``-byte strings that a string of a smaller document holds too."""
    text = b"\0".join(strings) + b"\0"
    data = np.frombuffer(text, np.uint8)
    size = np.array([len(s) for s in strings])
    begin = np.cumsum(size + 1) - size - 1
    symbols = data.astype(np.int64) + 2
    symbols[begin + size] = 1  # ends of strings are less than any byte
    order = suffix_array(symbols)
    which = np.searchsorted(begin, order, side="right") - 1
    ok = order + least <= (begin + size)[which]
    order, which = order[ok], which[ok]
    prefix = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - least + 1), least), (1, 1))
    differ = np.ones(len(order), bool)
    for a in range(1, len(order), 65_536):
        here = order[a : a + 65_536]
        differ[a : a + len(here)] = (prefix[here] != prefix[order[a - 1 : a - 1 + len(here)]]).any(axis=1)
    group = np.cumsum(differ) - 1
    smallest = np.full(int(group[-1]) + 1 if len(group) else 0, NO_ID)
    np.minimum.at(smallest, group, owner[which])
    hit = smallest[group] < owner[which]
    out: dict[int, np.ndarray] = {}
    if hit.any():
        w, starts = which[hit], order[hit] - begin[which[hit]]
        by = np.lexsort((starts, w))
        w, starts = w[by], starts[by]
        edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
        out = {int(w[a]): starts[a:b] for a, b in zip(edge, edge[1:], strict=False)}
    return out


def contexts(text: bytes, size: np.ndarray, least: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs that are laid one after the other: their anchors, hashes of what is left and right of the anchor, and whether it comes twice.

    A string of ``least`` bytes around an anchor reaches ``half`` bytes to its left or to its right, so runs that share one
    have the anchor and the ``half`` bytes on one side in common. A side that the run does not have is the run's own number, counted from ``number``.
    """
    begin = np.cumsum(size) - size
    half = (least - GRAM) // 2
    h = gram_hashes(np.frombuffer(text, np.uint8))
    valid = h.copy()
    # Grams that begin in the last bytes of a run reach into the next one.
    valid[((begin + size)[:, None] - np.arange(1, GRAM)).ravel()] = np.iinfo(np.uint64).max
    anchor = np.minimum.reduceat(valid, begin)
    hit = np.flatnonzero(valid == np.repeat(anchor, size))
    run = np.searchsorted(begin, hit, side="right") - 1
    first = np.concatenate([[True], run[1:] != run[:-1]])
    at = hit[first]
    many = np.bincount(run, minlength=len(size)) > 1
    c1, c2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    own = np.arange(number, number + len(size), dtype=np.uint64) * c1

    def side(k: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """A hash of ``half`` bytes from ``k`` on, by grams that cover them (``half`` is at least ``GRAM``)."""
        k = np.where(ok, k, begin)
        out = h[k]
        for step in range(GRAM, half - GRAM + 1, GRAM):
            out = out * c1 ^ h[k + step] * c2
        out = out * c1 ^ h[np.minimum(k + half - GRAM, len(h) - 1)] * c2
        return np.where(ok, out, own)

    left = side(at - half, at - half >= begin)
    right = side(at + GRAM, at + GRAM + half <= begin + size)
    return anchor, left, right, many


def may_repeat(of: np.ndarray, left: np.ndarray, right: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which runs have the context of one side in common with another run of the anchor; all of an anchor that comes twice in a run."""
    out = many.copy()
    key = of.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for x in (left, right):
        _, inverse, count = np.unique(x ^ key, return_inverse=True, return_counts=True)
        out |= count[inverse] > 1
    if many.any():
        out |= np.isin(of, of[many])
    return out


def _own(blobs: list[bytes], least: int, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Answers of one owner: id, mark, and starts and ends of covered stretches."""
    ids, marks, starts, sizes, texts, firsts, lefts, rights, several = [], [], [], [], [], [], [], [], []
    for blob in blobs:
        (doc, mark, short, delta, size), text = _unpack(blob)
        short = np.cumsum(short.astype(np.int64))
        size = size.astype(np.int64)
        anchor, left, right, many = contexts(text, size, least, sum(map(len, firsts)))
        firsts.append(anchor)
        lefts.append(left)
        rights.append(right)
        several.append(many)
        ids.append(np.cumsum(doc)[short])
        marks.append(mark[short])
        starts.append(np.cumsum(delta.astype(np.int64)))
        sizes.append(size)
        texts.append(text)
    _, of, count = np.unique(np.concatenate(firsts), return_inverse=True, return_counts=True)
    left, right, many = np.concatenate(lefts), np.concatenate(rights), np.concatenate(several)
    maybe = may_repeat(of, left, right, many) & (count[of] > 1)
    spans: dict[tuple[int, int], list[int]] = {}
    by_anchor: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    where_of: dict[bytes, int] = {}
    at = 0
    for doc, mark, start, size, text in zip(ids, marks, starts, sizes, texts, strict=True):
        begin = np.cumsum(size) - size
        for i in np.flatnonzero(maybe[at : at + len(size)]).tolist():
            b = int(begin[i])
            s = text[b : b + int(size[i])]
            by_anchor.setdefault(int(of[at + i]), {}).setdefault(s, []).append((int(doc[i]), int(mark[i]), int(start[i])))
            where_of[s] = at + i
        at += len(size)
    # Of the distinct runs, those that can share a string with another one.
    distinct = [(k, s) for k, group in by_anchor.items() if len(group) > 1 for s in group]
    rows = np.array([where_of[s] for _, s in distinct], np.int64)
    near = may_repeat(of[rows], left[rows], right[rows], many[rows]) if len(rows) else np.zeros(0, bool)
    sorts = {s for (_, s), ok in zip(distinct, near, strict=True) if ok}
    strings: list[bytes] = []
    places: list[list[tuple[int, int, int]]] = []
    for group in by_anchor.values():
        for s, where in group.items():
            low = min(w[0] for w in where)
            for d, m, a in where:
                if d > low:
                    spans.setdefault((d, m), []).extend((a, a + len(s)))
            if s in sorts:
                strings.append(s)
                places.append([w for w in where if w[0] == low])
    a = 0
    while a < len(strings):  # an anchor's strings stay together: cut only where the anchor changes
        b, held = a, 0
        while b < len(strings) and held < piece:
            held += len(strings[b])
            b += 1
        if b < len(strings):
            own = anchor_of(strings[b - 1])
            while b < len(strings) and anchor_of(strings[b]) == own:
                b += 1
        for k, found in repeated(strings[a:b], np.array([p[0][0] for p in places[a:b]], np.int64), least).items():
            for d, m, start in places[a + k]:
                for x in found.tolist():
                    spans.setdefault((d, m), []).extend((start + x, start + x + least))
        a = b
    for (d, m), s in spans.items():
        yield d, m, merged(np.array(s, np.int64)).tobytes()


def anchor_of(run: bytes) -> int:
    return int(gram_hashes(np.frombuffer(run, np.uint8))[: len(run) - GRAM + 1].min())


def merged(spans: np.ndarray) -> np.ndarray:
    """Starts and ends in turn, sorted, with stretches that meet made one."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]])
    return np.stack([pairs[new, 0], end[last]], axis=1).ravel()


def _answer(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by owner; those with an id are answers already."""
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("spans", pa.binary())])

    def out(blobs: list[bytes]) -> pa.RecordBatch:
        got = list(_own(blobs, least))
        d, m, s = zip(*got, strict=True) if got else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.binary())], schema=schema)

    now, blobs = -1, []
    for batch in batches:
        known = batch.column(1).is_valid()
        if known.true_count:
            part = batch.filter(known)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3)], schema=schema)
        batch = batch.filter(batch.column(1).is_null())
        for i, o in enumerate(batch.column(0).to_pylist()):
            if o != now and blobs:
                yield out(blobs)
                blobs = []
            now = o
            blobs.append(batch.column(3)[i].as_py())
    if blobs:
        yield out(blobs)


def marks(docs: DataFrame, id_col: str, text_col: str):
    """A hash of the row where ids repeat, else 0 (which costs nothing to send)."""
    repeat = docs.groupBy(F.col(id_col).alias("i")).count().where("count > 1").take(1)
    return F.xxhash64(id_col, text_col) if repeat else F.lit(0).cast("long")


def spans(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, spans``: the covered stretches of each document (binary pieces of starts and ends, not yet merged). ``docs`` has ``_mark``, which tells rows of one id with other texts apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("_mark").alias("mark"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), round(total * GROWTH / (4 * OWNER_BYTES)))
    owners = max(OWNERS, round(total * GROWTH / OWNER_BYTES))
    sent = rows.mapInArrow(lambda it: _send(it, owners, least), SENT_SQL)
    return sent.repartition(parts, "owner").sortWithinPartitions("owner").mapInArrow(lambda it: _answer(it, least), "id long, mark long, spans binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows = []
        for t, s in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            text = (t.as_py() or "").encode("utf-8", "surrogatepass")
            pairs = merged(np.frombuffer(b"".join(s), np.int64)).reshape(-1, 2).tolist() if s else []
            kept, at = hashlib.sha256(), 0
            for a, b in pairs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in pairs), len(pairs), kept.hexdigest()))
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]], names=["id", *schema.names])


def with_spans(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: arrays of binary pieces, null where nothing is covered."""
    docs = docs.withColumn("_mark", marks(docs, id_col, text_col))
    found = spans(docs, least, id_col, text_col).groupBy("id", "mark").agg(F.collect_list("spans").alias("_spans"))
    rows = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    same = (rows["_id"] == found["id"]) & (rows["_mark"] == found["mark"])
    return rows.join(found.hint("shuffle_hash"), same, "left").drop("_id", "_mark", "id", "mark")


def removed(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = with_spans(docs.select(id_col, text_col), least, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("_spans").alias("spans"))
    return rows.mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with covered bytes removed from the texts. A cut within a character's bytes leaves U+FFFD."""

    @F.pandas_udf("string")
    def cut(text, found):
        out = []
        for t, s in zip(text, found, strict=True):
            if t is None or s is None:
                out.append(t)
                continue
            data, kept, at = t.encode("utf-8", "surrogatepass"), [], 0
            for a, b in merged(np.frombuffer(b"".join(s), np.int64)).reshape(-1, 2).tolist():
                kept.append(data[at:a])
                at = b
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
        return type(text)(out)

    return with_spans(docs, least, id_col, text_col).withColumn(text_col, cut(F.col(text_col), F.col("_spans"))).select(*docs.columns)
