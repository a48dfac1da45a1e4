"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

*Tokens.* Every whole text is encoded and ends with the id ``END``. Pieces of words are encoded once a worker and
kept in a bounded dictionary; the library encodes what is new. The ids are written to the shared folder.

*Statistics.* Document frequencies of all ids over all documents, their number and mean length; at most one row
for each id of the vocabulary, which bounds what goes to the driver and into the tasks.

*Shards.* Documents are range-partitioned by the least of two hashes among their ids, then by a hash of the whole document, so documents with like
words meet and a group of copies of any size is split. A shard has about ``SHARD_TOKENS`` ids and an inverted
index of its own: postings with BM25 weights under the statistics of the whole corpus. A seed asks its own shard only: neighbours in other
shards are not found.

*Windows.* A document first fills whole windows of its own. Its rest is a seed (longest first) or a neighbour: all documents of the shard are scored
for all of the seed's terms, and unused neighbours by falling score (ties by position) fill the window; the one that
does not fit is cut, and its rest stays unused. Where no neighbour shares a term, the next unused rest is
taken. So every window of a shard but the last is full, and the last is cut into sequences of powers of
two: there is no padding.

Defined results: a null or empty text is the one id ``END``; ids of documents may be null or repeat (each row is packed); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_alphabet
from tessera.llm.common import arrow_rows, discard, give_back, staged

WINDOW = 2048
END = 1
SHARD_TOKENS = 8 << 20
#: Terms whose postings are rows of a matrix.
ROWS = 512
K1, B = 1.2, 0.75
#: Documents that a worker is sent at once.
SENT = 512
#: Pieces in a worker's dictionary, and characters that are cut into pieces at once.
CACHE, CHARS = 400_000, 1 << 18
SPACES = " \n\t\r\v\f"
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
# Letters that lower-case to one letter each and are composed already; marks that the library takes together (but apostrophes, which begin
# contractions, and the bar of the special tokens).
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"

BYTES = {b: c for c, b in byte_alphabet().items()}


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and their counts."""
    s = np.sort(x)
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
    return s[edge[:-1]], np.diff(edge)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For code points under 256, and one row for all others: what they are (``SPACE`` ...), and their lower case."""
    kind, low = np.full(257, ODD, np.uint8), np.arange(257, dtype=np.uint32)
    for c in map(chr, range(256)):
        if c in SPACES:
            kind[ord(c)] = SPACE
        elif LATIN.fullmatch(c):
            kind[ord(c)], low[ord(c)] = LETTER, ord(c.lower())
        elif c in "0123456789":
            kind[ord(c)] = DIGIT
        elif c in MARKS:
            kind[ord(c)] = MARK
    return kind, low


KIND, LOWER = _kinds()


class WordTokenizer:
    """A tokenizer that never joins text across spaces, for many texts at a time.

    Texts are cut into pieces by array operations, as the library's pattern cuts them: runs of letters, single digits and runs of marks; a word with
    any other character is one piece. Pieces are told apart by 64-bit polynomial hashes (prefix sums), and each distinct one is looked up
    once; the library's model encodes new pieces of letters, digits and marks, the whole library the others. The dictionary (arrays, about 20 bytes
    a piece and 2 an id) keeps at most ``CACHE`` pieces, those used last.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.size = self.lib.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.model = self.lib.model
        probe = ["the", "été", "straße", "ñ", "!", "...", "?!", "ÿ", "internationalisierung", "__", "7"]
        rng = np.random.default_rng(11)
        self.code = rng.integers(0, 2**64, 257, np.uint64)
        odd = int(rng.integers(0, 2**62)) * 2 + 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(2 * CHARS + 2, odd, np.uint64))
            self.inverse = np.cumprod(np.full(2 * CHARS + 2, pow(odd, -1, 1 << 64), np.uint64))
        # The dictionary: hashes in order and the entry of each; where an entry's ids begin in ``flat``, and how many they are.
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.length, self.flat = array("i"), array("i"), array(self.kind.char)
        self.used, self.clock = np.zeros(CACHE, np.int32), 0
        # The model takes lower-case pieces without normalising and splitting again, if it gives what the library gives.
        self.direct = True
        self.direct = all(x.tobytes() == y for x, y in zip(self.encode_batch(probe), self._lib(probe), strict=True))

    def _lib(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.lib.encode_batch(words, add_special_tokens=False)]

    def _learn(self, pieces: list[str], odd: list[bool]) -> None:
        """Makes an entry of each piece."""
        tokenize, flat = self.model.tokenize, self.flat
        rest = iter(self._lib([w for w, o in zip(pieces, odd, strict=True) if o or not self.direct]))
        size = []
        for w, o in zip(pieces, odd, strict=True):
            if o or not self.direct:
                ids = np.frombuffer(next(rest), self.kind).tolist()
            else:
                w = w.lower()
                ids = [x.id for x in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTES))]
            flat.extend(ids)
            size.append(len(ids))
        length = np.array(size, np.int64)
        self.begin.frombytes((len(flat) - length.sum() + np.cumsum(length) - length).astype(np.int32).tobytes())
        self.length.frombytes(length.astype(np.int32).tobytes())

    def _forget(self, room: int) -> None:
        """Keeps the pieces used last, about half of them, if ``room`` more would not fit."""
        n = len(self.length)
        if n + room <= len(self.used):
            return
        used = self.used[:n]
        kept = np.flatnonzero(used > np.partition(used, n // 2)[n // 2]) if n else np.zeros(0, np.int64)
        begin, length = np.array(self.begin, np.int32)[kept], np.array(self.length, np.int32)[kept]
        flat = self._gather(begin, length)
        now = np.full(n, -1, np.int32)
        now[kept] = np.arange(len(kept))
        now = now[self.entry]
        self.known, self.entry = self.known[now >= 0], now[now >= 0]
        self.begin, self.length, self.flat = array("i", (np.cumsum(length) - length).astype(np.int32).tobytes()), array("i", length.tobytes()), array(self.kind.char, flat.tobytes())
        self.used = np.concatenate([used[kept], np.zeros(max(CACHE, room), np.int32)])

    def _gather(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        flat = np.frombuffer(self.flat, self.kind) if len(self.flat) else np.zeros(0, self.kind)
        return flat[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]

    def _encode(self, text: str, edges: list[int]) -> list[np.ndarray]:
        """The ids of each stretch of ``text`` between two edges; spaces are at the edges."""
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(point, 256)
        kind = KIND[small]
        gap = kind == SPACE
        before = np.concatenate([[True], gap[:-1]])
        value = self.code[LOWER[small]]
        if (kind == ODD).any():
            word = np.cumsum(before & ~gap)
            bad = np.zeros(int(word[-1]) + 1, bool)
            bad[word[kind == ODD]] = True
            bad = bad[word] & ~gap
            kind = np.where(bad, ODD, kind)
            value[bad] = (point[bad].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        first = ~gap & (before | (kind == DIGIT) | np.concatenate([[True], kind[1:] != kind[:-1]]))
        last = ~gap & np.concatenate([first[1:] | gap[1:], [True]])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * self.power[: len(value)], out=total[1:])
        hashes = (total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        self._forget(len(distinct))
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != distinct[inside]
        if new.any():
            where, n = at[new], len(self.length)
            self._learn([text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], (kind[start[where]] == ODD).tolist())
            self.known = np.insert(self.known, spot[new], distinct[new])
            self.entry = np.insert(self.entry, spot[new], np.arange(n, n + len(where), dtype=np.int32))
            spot += np.cumsum(new) - new
        entry = self.entry[spot]
        self.clock += 1
        self.used[entry] = self.clock
        if len(entry):
            length = np.frombuffer(self.length, np.int32)[entry][back].astype(np.int64)
            ids = self._gather(np.frombuffer(self.begin, np.int32)[entry][back], length)
        else:
            length, ids = np.zeros(0, np.int64), np.zeros(0, self.kind)
        upto = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(start, edges)]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                out.extend(self._encode("\n".join([*held, ""]), np.cumsum([0, *[len(t) + 1 for t in held]]).tolist()))
            held.clear()
            size = 0

        for t in texts:
            if len(t) > CHARS:  # a long text goes in parts that end at spaces; a longer stretch without one goes to the library
                flush()
                parts = [self._encode(x + "\n", [0, len(x) + 1])[0] if len(x) <= CHARS else np.frombuffer(self._lib([x])[0], self.kind) for x in stretches(t)]
                out.append(np.concatenate(parts))
                continue
            if size + len(t) > CHARS:
                flush()
            held.append(t)
            size += len(t) + 1
        flush()
        return out


def stretches(text: str) -> Iterator[str]:
    """Parts of a text of at most ``CHARS`` characters, cut at a space; longer only where there is no space."""
    at = 0
    while at < len(text):
        end = at + CHARS
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in SPACES)
            end = cut if cut > at else min((k for c in SPACES if (k := text.find(c, end)) >= 0), default=len(text))
        yield text[at:end]
        at = max(end, at + 1)


_open: dict[str, WordTokenizer] = {}


def open_tokenizer(path: str) -> WordTokenizer:
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each id."""
    h = x.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h ^ (h >> np.uint32(13))


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tok = open_tokenizer(path)
    end = np.array([END], tok.kind)
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            ids = [np.concatenate([x, end]) for x in tok.encode_batch([t or "" for t in batch.column(1).to_pylist()])]
            hashes = [mixed(x) for x in ids]
            route = [int(h.min()) for h in hashes]
            # A second least hash, then the document's own.
            spread = [int((h * np.uint32(0xC2B2AE35)).min()) << 31 | zlib.crc32(x.tobytes()) >> 1 for h, x in zip(hashes, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(route, pa.int64()), pa.array(spread, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["id", "n", "route", "spread", "ids"],
            )
    give_back()


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, route, spread, ids`` (little-endian ids of 2 bytes, or 4 for large vocabularies) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _tokens(it, path), f"id {kind}, n long, route long, spread long, ids binary")


def statistics(tokens: DataFrame, size: int, width: int) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id, documents and tokens of the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for b in batch.column(0):
                df[distinct(np.frombuffer(b.as_buffer(), f"<u{width}"))[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    rows = tokens.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(size, np.int64)
    for r in rows:
        df[r["term"]] = r["df"]
    n, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return df, n, total


class Index:
    """Postings of a shard: for each term its documents and their BM25 weights; the terms of many documents are rows of a matrix instead."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(d) for d in docs], np.int64)
        norm = K1 * (1 - B + B * size / mean)
        terms, weights = [], []
        for k, d in enumerate(docs):
            t, tf = distinct(d)
            terms.append(t)
            weights.append((idf[t] * (tf * (K1 + 1) / (tf + norm[k]))).astype(np.float32))
        count = np.array([len(t) for t in terms], np.int64)
        term = np.concatenate(terms) if terms else np.zeros(0, np.uint16)
        weight = np.concatenate(weights) if weights else np.zeros(0, np.float32)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), count)
        df = np.bincount(term, minlength=len(idf))
        often = np.flatnonzero(df > len(docs) // 64)
        often = often[np.argsort(-df[often], kind="stable")[:ROWS]]
        column = np.full(len(idf), -1, np.int32)
        column[often] = np.arange(len(often))
        dense = column[term] >= 0
        self.matrix = np.zeros((len(often), len(docs)), np.float32)
        self.matrix[column[term[dense]], doc[dense]] = weight[dense]
        self.cut = np.concatenate([[0], np.cumsum(count)])
        self.terms, self.column = term, column
        rare = np.flatnonzero(~dense)
        order = rare[np.argsort(term[rare], kind="stable")]
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term[rare], minlength=len(idf)))])
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for all terms of the seed."""
        t = self.terms[self.cut[seed] : self.cut[seed + 1]]
        row = self.column[t]
        t = t[row < 0].astype(np.int64)
        n = self.begin[t + 1] - self.begin[t]
        at = np.repeat(self.begin[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float32)
        for r in row[row >= 0].tolist():  # adding in place needs no copy of the rows
            out += self.matrix[r]
        return out


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of a shard: each a list of (document, start, length)."""
    done = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    for d in range(len(docs)):
        while left[d] >= window:
            yield [(d, int(done[d]), window)]
            done[d] += window
            left[d] -= window
    index = Index(docs, idf, mean)
    order = np.lexsort((np.arange(len(docs)), -left))
    at = 0
    while True:
        while at < len(order) and not left[order[at]]:
            at += 1
        if at == len(order):
            return
        seed = int(order[at])
        now: list[tuple[int, int, int]] = []
        space = window

        def take(d: int) -> None:
            nonlocal space
            n = int(min(left[d], space))
            now.append((d, int(done[d]), n))  # noqa: B023
            done[d] += n
            left[d] -= n
            space -= n

        take(seed)
        if space:
            score = index.scores(seed)
            score[left == 0] = 0
            some = 16
            while space:
                near = np.flatnonzero(score)
                if not len(near):
                    break
                if len(near) > some:
                    near = near[np.argpartition(-score[near], some - 1)[:some]]
                for d in near[np.lexsort((near, -score[near]))].tolist():
                    if space:
                        take(d)
                    score[d] = 0
                some *= 4
            k = at
            while space and k < len(order):
                if left[order[k]]:
                    take(int(order[k]))
                k += 1
        if not space:
            yield now
            continue
        # The last window: powers of two need no padding.
        total, k, used = window - space, 0, 0
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            piece: list[tuple[int, int, int]] = []
            while want:
                d, start, n = now[k]
                n = min(n - used, want)
                piece.append((d, start + used, n))
                want -= n
                used += n
                if used == now[k][2]:
                    k, used = k + 1, 0
            yield piece


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, width: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sequences of a partition, which is one shard, or several if it is far over ``most`` ids."""
    sequence = TaskContext.get().partitionId() << 32
    ids: list[object] = []
    docs: list[np.ndarray] = []
    held = 0

    def out(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], id_type), *[pa.array(x, pa.int64()) for x in c[1:]]], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for pieces in pack(docs, idf, mean):
            at = 0
            for d, start, n in pieces:
                crc = zlib.crc32(docs[d][start : start + n].astype("<u4").tobytes())
                rows.append((ids[d], start, n, crc, len(docs[d]), sequence, at))
                at += n
            sequence += 1
            if len(rows) >= 20_000:
                yield made()
                rows = []
        if rows:
            yield made()

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(b.as_py(), f"<u{width}")
            ids.append(i)
            docs.append(x)
            held += len(x)
            if held >= 2 * most:
                yield from out(kind)
                ids, docs, held = [], [], 0
    if docs:
        yield from out(kind)
    ids, docs = [], []
    give_back()


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    tok = open_tokenizer(path)
    width = tok.kind.itemsize
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    with arrow_rows(spark, SENT):
        tokens, tokens_at = staged(tokenize(docs, path, id_col, text_col), "packing-tokens")
        df, n, total = statistics(tokens, tok.size, width)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = max(1.0, total / max(1, n))
        shards = max(1, -(-total // shard_tokens))
        rows = tokens.select("id", "ids", "route", "spread").repartitionByRange(shards, "route", "spread", "id")
        rows = rows.sortWithinPartitions("route", "spread", "id").select("id", "ids")
        out = staged(rows.mapInArrow(lambda it: _pack(it, idf, mean, width, shard_tokens), f"id {kind}, {PIECES}"), "packing-pieces")[0]
    discard(spark, tokens_at)
    return out.withColumnRenamed("id", id_col)
