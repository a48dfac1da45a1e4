"""Media columns: chroma fingerprints of audio, and their alignment.

A media column holds WAV bytes. A recording is read as mono at ``RATE``; overlapping frames go through a
Fourier transform into the energy of 12 pitch classes; frames are smoothed over time and normalised. The image
(time by pitch class) is summed into an integral image, so each of 16 rectangle filters costs a few look-ups at
any size; a filter's log ratio of two areas becomes 2 bits (a Gray code), and 16 filters make one packed 32-bit integer
for each position. Positions whose window holds a silent frame have none.

``search`` and ``links`` align recordings. Equal fingerprints are one class, the smallest id standing for it. A query
and a recording match if the best bin of the histogram of their offsets has at least ``VOTES`` of the query's integers
and the bits over the overlap at that offset differ by at most ``ERROR``. The queries are laid in blocks of about ``BLOCK`` integers; a task holds
one block as an inverted index and aligns a share of all recordings with it, so a recording is copied once for each block, common
integers never multiply rows, and nothing is missed. ``search`` gives all pairs of classes. ``links`` gives what grows with the recordings only: inside a
task matches are counted, the best is kept, and a forest of links (each matched recording to one query, each query to one of its
component) goes out.

Tables without media can be given some by ``sonify``: a vector becomes a melody, one note for each component, its pitch
class being the component's interval of a normal distribution, after a pause that depends on the id.

Defined results: null, empty or unreadable audio, null or empty vectors and recordings without a sounding window match nothing
and have a row of their own in ``links``; null vector components and ones that are not numbers count as 0; null ids are never queries and
stand for a class only without another id; rows that repeat are each counted; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.components import components

RATE, FRAME, HOP = 4000, 1024, 256
NOTE = 512
LOW, HIGH = 110.0, 1760.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SPAN = 16
STEP = 0.35
VOTES = 0.15
ERROR = 0.3
#: Integers of the queries that a task holds, and how many times the queries of a block the recordings of a task are.
BLOCK, SHARE = 2_000_000, 4
#: Filters (kind, first pitch class, pitch classes, frames), made by a rule: each kind at four places and sizes.
FILTERS = [(kind, (3 * i + 2 * kind) % 9, 3 + (i + kind) % 2, (4, 8, 12, 16)[i]) for kind in range(4) for i in range(4)]
GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wav(data: bytes | None) -> np.ndarray:
    """Mono samples between -1 and 1 at ``RATE``; none if the bytes are not readable PCM."""
    if not data:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    elif width == 1:
        x = np.frombuffer(raw, np.uint8) / 128.0 - 1
    else:
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}") / 2.0 ** (8 * width - 1)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _pitch_classes() -> np.ndarray:
    """(bins, 12): the pitch class of each frequency of the transform."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    ok = (f >= LOW) & (f <= HIGH)
    out[np.flatnonzero(ok), np.round(12 * np.log2(f[ok] / 440)).astype(int) % 12] = 1
    return out


PITCH = _pitch_classes()
TAPER = np.hanning(FRAME)


def chroma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, 12) normalised energies of the pitch classes, and which frames sound."""
    n = (len(x) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12)), np.zeros(0, bool)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n] * TAPER
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ PITCH
    k = len(SMOOTH)
    smooth = sum(w * energy[i : n - k + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.sqrt((smooth**2).sum(axis=1))
    sounds = size > 1e-3
    return smooth / np.maximum(size, 1e-12)[:, None], sounds


def areas(total: np.ndarray, t: np.ndarray, width: int, y: int, height: int) -> np.ndarray:
    """Sums of rectangles that begin at frames ``t``, from the integral image."""
    return total[t + width, y + height] - total[t, y + height] - total[t + width, y] + total[t, y]


def fingerprint(x: np.ndarray) -> np.ndarray:
    """The recording's integers: int64, -1 where a window is not sounding."""
    image, sounds = chroma(x)
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)
    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # one part of the octave against the rest of it
            a, b = areas(total, t, w, y, h), areas(total, t, w, 0, 12) - areas(total, t, w, y, h)
            a = a * 12 / h
            b = b * 12 / (12 - h)
        elif kind == 1:  # earlier against later
            a, b = areas(total, t, w // 2, y, h), areas(total, t + w // 2, w // 2, y, h)
        elif kind == 2:  # lower against higher
            a, b = areas(total, t, w, y, h // 2), areas(total, t, w, y + h // 2, h - h // 2)
        else:  # crossed
            a = areas(total, t, w // 2, y, h // 2) + areas(total, t + w // 2, w // 2, y + h // 2, h - h // 2)
            b = areas(total, t, w // 2, y + h // 2, h - h // 2) + areas(total, t + w // 2, w // 2, y, h // 2)
        v = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        level = (v > -STEP).astype(int) + (v > 0) + (v > STEP)
        out = out << np.uint32(2) | GRAY[level]
    silent = np.concatenate([[0], (~sounds).cumsum()])
    return np.where(silent[t + SPAN] == silent[t], out.astype(np.int64), -1)


# Cuts of the standard normal distribution into 6 equal parts, a whole tone each.
CUTS = np.array([-0.967422, -0.430727, 0.0, 0.430727, 0.967422])


def melody(vector: list[float] | None, key: int) -> np.ndarray:
    """Samples of a vector: a pause of ``key % 7`` frames, then a note with two overtones for each component."""
    if not vector:
        return np.zeros(0)
    v = np.nan_to_num(np.array([0.0 if a is None else a for a in vector], float), nan=0.0, posinf=0.0, neginf=0.0)
    scale = np.sqrt((v**2).mean()) or 1.0
    pitch = 2 * np.searchsorted(CUTS, v / scale)
    t = np.arange(NOTE) / RATE
    f = 220.0 * 2 ** (np.arange(12) / 12)
    notes = sum(g * np.sin(2 * np.pi * k * f[:, None] * t) for k, g in ((1, 0.5), (2, 0.25), (4, 0.1)))
    notes *= np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 32)
    return np.concatenate([np.zeros(HOP * (key % 7)), notes[pitch].ravel()])


def sonify(vector: list[float] | None, key: int) -> bytes:
    return write_wav(melody(vector, key))


def _prints(batches: Iterator[pa.RecordBatch], vectors: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = sonify(m.as_py(), i or 0) if vectors else m.as_py()
            got.append(fingerprint(read_wav(data)).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["id", "print"])


def fingerprints(media: DataFrame, id_col: str, media_col: str, vectors: bool = False) -> DataFrame:
    """``id, print`` (little-endian 64-bit integers, -1 for silence) of every row; ``vectors``: the column is sonified first."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(lambda it: _prints(it, vectors), "id long, print binary")


def votes_needed(n: int) -> int:
    return max(2, ceil(VOTES * n))


class Block:
    """An inverted index of the integers of some queries, against which recordings are aligned one at a time."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints = prints
        where = [np.flatnonzero(p >= 0) for p in prints]
        size = np.array([len(w) for w in where], np.int64)
        self.need = np.array([votes_needed(n) for n in size.tolist()], np.int64)
        values = np.concatenate([p[w] for p, w in zip(prints, where, strict=True)]) if prints else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.query = np.repeat(np.arange(len(prints)), size)[order]
        self.at = (np.concatenate(where) if where else np.zeros(0, np.int64))[order]
        self.longest = max((len(p) for p in prints), default=0)

    def votes(self, other: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries with their best offset (position in ``other`` minus position in the query; ties: the smallest) and its votes, where those suffice."""
        sounding = np.flatnonzero(other >= 0)
        a, b = np.searchsorted(self.values, other[sounding]), np.searchsorted(self.values, other[sounding], side="right")
        n = b - a
        span = self.longest + len(other) + 1
        bins, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // most, prepend=0)) if n.sum() > most else np.zeros(0, np.int64)
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
            part = n[lo:hi]
            if not part.sum():
                continue
            hit = np.repeat(a[lo:hi] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            code = self.query[hit] * span + (np.repeat(sounding[lo:hi], part) - self.at[hit] + self.longest)
            new, times = np.unique(code, return_counts=True)
            bins, back = np.unique(np.concatenate([bins, new]), return_inverse=True)
            count = np.bincount(back, np.concatenate([count, times]), len(bins)).astype(np.int64)
        query = bins // span
        order = np.lexsort((bins, -count, query))
        first = order[np.concatenate([[True], query[order][1:] != query[order][:-1]])] if len(order) else order
        first = first[count[first] >= self.need[query[first]]]
        return query[first], bins[first] % span - self.longest, count[first]

    def matches(self, other: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Query, offset, votes, overlap in integers and differing bits of every query that matches."""
        out = []
        for k, offset, votes in zip(*(x.tolist() for x in self.votes(other)), strict=True):
            query = self.prints[k]
            q = query[max(0, -offset) : len(other) - offset]
            r = other[max(0, offset) : max(0, offset) + len(q)]
            q = q[: len(r)]
            both = (q >= 0) & (r >= 0)
            overlap, bits = int(both.sum()), int(np.bitwise_count(q[both] ^ r[both]).sum())
            if bits <= ERROR * 32 * overlap:
                out.append((k, offset, votes, overlap, bits))
        return out


MATCHES = "k string, match string, offset long, votes long, overlap long, bit_errors long"
#: role 0: what a task knows of a query; role 1: of a recording. ``link`` ties each to a query of its component.
PARTS = "role int, k string, classes long, recordings long, link string, match string, offset long, votes long, overlap long, bit_errors long"


def _blocks(batches: Iterator[pa.RecordBatch], all_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``part, role, k, members, asked, print`` come sorted by part and role: a part's queries (role 0), then its recordings.

    ``all_pairs``: every match; else one row for each query and each matched recording of the part, however many pairs there are.
    """
    fields = [f.split() for f in (MATCHES if all_pairs else PARTS).split(", ")]
    names = [f[0] for f in fields]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f[1]] for f in fields]
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    part, queries, block = None, [], None
    best: dict[int, tuple] = {}
    seen: list[list[int]] = []
    above: list[int] = []

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def close() -> None:
        if not all_pairs and block is not None:
            for i, (k, _, _) in enumerate(queries):
                if seen[i][0]:
                    rows.append((0, k, *seen[i], queries[root(i)][0], *best.get(i, (None, None) + (None,) * 5)[2:]))

    for batch in batches:
        for p, role, k, members, asked, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                close()
                part, queries, block, best = p, [], None, {}
            if role == 0:
                queries.append((k, asked, np.frombuffer(data, "<i8")))
                continue
            if block is None:
                block = Block([q[2] for q in queries])
                seen, above = [[0, 0] for _ in queries], list(range(len(queries)))
            found = block.matches(np.frombuffer(data, "<i8"))
            if all_pairs:
                rows += [(queries[i][0], k, *x) for i, *x in found]
            elif found:
                for i, offset, votes, overlap, bits in found:
                    seen[i][0] += 1
                    seen[i][1] += members
                    above[root(i)] = root(found[0][0])
                    if queries[i][0] != k:  # the fewest differing bits for the overlap, then most votes, then the smallest digest
                        rank = ((bits / overlap, -votes), k)
                        if i not in best or rank < best[i][:2]:
                            best[i] = (*rank, k, offset, votes, overlap, bits)
                rows.append((1, k, len(found), sum(queries[x[0]][1] for x in found), queries[found[0][0]][0], *[None] * 5))
            if len(rows) >= 10_000:
                yield made()
    close()
    yield made()


def classes_of(prints: DataFrame, asks: Column) -> DataFrame:
    """Recordings with one fingerprint: ``k`` (its digest), ``class_id`` (their smallest id), ``members`` and how many of them ``asked``."""
    counted = F.count_if(F.coalesce(asks, F.lit(False)))
    return prints.groupBy("print").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"), counted.alias("asked")).withColumn("k", F.sha1("print"))


def _aligned(classes: DataFrame, all_pairs: bool, block: int, share: int) -> DataFrame:
    """The classes that ask, in blocks of about ``block`` integers, against all classes, in shares of about ``share`` times as many."""
    sounding = classes.where(F.octet_length("print") > 0)
    n, size = sounding.where("asked > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("print")), F.lit(0))).first()
    blocks = max(1, -(-size // (8 * block)))
    shares = max(1, -(-sounding.count() // max(2048, share * (n // blocks))))
    place = lambda i, j: F.xxhash64(i, j)
    numbers = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    mine = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    asking = sounding.where("asked > 0").select(F.explode(F.transform(numbers(shares), lambda j: place(mine, j))).alias("part"), F.lit(0).alias("role"), "k", "members", "asked", "print")
    of = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(shares)).cast("int")
    others = sounding.select(F.explode(F.transform(numbers(blocks), lambda i: place(i, of))).alias("part"), F.lit(1).alias("role"), "k", "members", "asked", "print")
    rows = asking.unionByName(others).repartition(blocks * shares, "part").sortWithinPartitions("part", "role")
    return rows.mapInArrow(lambda it: _blocks(it, all_pairs), MATCHES if all_pairs else PARTS)


def search(media: DataFrame, id_col: str, media_col: str, vectors: bool = False, query_every: int = 20, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """Every match of the rows whose id is divisible by ``query_every`` against all rows, as pairs of classes of equal fingerprints.

    ``class_id, match_id`` (the classes' smallest ids), ``members`` (recordings of the matched class), ``offset, votes, overlap, bit_errors``.
    """
    prints = stage(fingerprints(media, id_col, media_col, vectors), "audio-prints")
    classes = stage(classes_of(prints, F.col("id") % query_every == 0), "audio-classes")
    found = _aligned(classes, True, block, share)
    one = classes.select("k", "class_id")
    two = classes.select(F.col("k").alias("match"), F.col("class_id").alias("match_id"), "members")
    return found.join(one, "k").join(two, "match").select("class_id", "match_id", "members", "offset", "votes", "overlap", "bit_errors")


def links(media: DataFrame, id_col: str, media_col: str, vectors: bool = False, query_every: int = 20, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """One row for each recording: membership and numbers of links of ``search``, without its pairs.

    ``id, class_id, component_id`` (the smallest id that links reach, among queries and recordings), ``is_query``, ``n_links`` (of a query: the other
    recordings it matches; else: the queries that match it), and a query's best match in another class: ``match_id, offset, votes, overlap, bit_errors``.
    """
    prints = stage(fingerprints(media, id_col, media_col, vectors), "audio-prints")
    asks = F.coalesce(F.col("id") % query_every == 0, F.lit(False))
    classes = stage(classes_of(prints, asks), "audio-classes")
    parts = stage(_aligned(classes, False, block, share), "audio-parts")
    rank = F.struct(F.col("bit_errors") / F.col("overlap"), -F.col("votes"), "match")
    best = F.min_by(F.struct("match", "offset", "votes", "overlap", "bit_errors"), F.when(F.col("match").isNotNull(), rank))
    asked = parts.where("role = 0").groupBy("k").agg(F.sum("recordings").alias("matched"), best.alias("best"))
    heard = parts.where("role = 1").groupBy("k").agg(F.sum("recordings").alias("queries"))
    roots = components(parts.select(F.col("k").alias("a"), F.col("link").alias("b")), "audio-components").select(F.col("v").alias("k"), "root")
    known = classes.join(asked, "k", "left").join(heard, "k", "left").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    known = stage(known, "audio-known")
    least = known.groupBy("root").agg(F.min("class_id").alias("component_id"))
    other = classes.select(F.col("k").alias("_k"), F.col("class_id").alias("match_id"))
    known = known.join(least, "root").join(other, F.col("best.match") == F.col("_k"), "left")
    rows = prints.join(known, "print").withColumn("is_query", asks)
    count = F.when(F.col("is_query"), F.coalesce("matched", F.lit(1)) - 1).otherwise(F.coalesce("queries", F.lit(0)))
    of = lambda c: F.when(F.col("is_query"), F.col(c)).alias(c.split(".")[-1])
    return rows.select("id", "class_id", "component_id", "is_query", count.alias("n_links"), of("match_id"), of("best.offset"), of("best.votes"), of("best.overlap"), of("best.bit_errors"))
