"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

A word (a piece of the pre-tokenisation pattern) starts as its bytes' tokens. Leaf i of a segment tree
holds (rank, i) of the pair that begins at position i; inner nodes hold the least of their children, so
the root is the leftmost pair of the lowest rank. A merge takes the root, closes the right-hand
leaf, ranks the pair anew on either side and repairs three paths to the root. It ends when no
pair has a rank. A word of n bytes takes O(n log n).

Words are encoded in groups of like width with one numpy operation for a level of all trees; words of over ``WIDE`` bytes
use a tree in a plain list. Each Python worker keeps the words it has seen in a
dictionary that is emptied at ``CACHE`` entries, so memory is bounded; the dictionary never changes a result.
Special tokens in a text are found first and keep their id, as the library does by default.

Defined results: null and empty texts have no tokens and decode to the empty text; long texts are taken in
blocks of words; ids, repeated rows and other columns play no part in the result; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Fixed value: the pre-tokenisation pattern of byte-level BPE.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NONE = np.iinfo(np.int64).max
WIDE = 64
CACHE = 400_000
BLOCK = 100_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if i not in self.special.values() else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        of_byte = {b: vocab[c] for c, b in alphabet.items()}
        self.first = np.array([of_byte[b] for b in range(256)], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = {int(k): r for r, k in enumerate(keys)}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE; b under zero means that there is no right-hand token."""
        key = a << 20 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.order[at], NONE)

    def _wide(self, word: bytes) -> list[int]:
        """One word, its tree in a list."""
        sym = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        width = 1 << (n - 1).bit_length()
        big = (1 << 60, 0)
        rank = self.rank.get
        pair = lambda i, j: (r, i) if j < n and (r := rank(sym[i] << 20 | sym[j])) is not None else big
        tree = [big] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pair(i, i + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while tree[1] is not big and tree[1] < big:
            r, i = tree[1]
            j = after[i]
            k = after[j]
            sym[i] = int(self.merged[r])
            sym[j] = -1
            after[i] = k
            before[k] = i
            changed = [(j, big), (i, pair(i, k))]
            if (h := before[i]) >= 0:
                changed.append((h, pair(h, i)))
            for leaf, value in changed:
                node = width + leaf
                tree[node] = value
                node >>= 1
                while node:
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if least == tree[node]:
                        break
                    tree[node] = least
                    node >>= 1
        return [s for s in sym if s >= 0]

    def _group(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Words of at most ``width`` bytes (a power of two), one tree a row."""
        size = np.array([len(w) for w in words])
        rows = len(words)
        sym = np.full((rows, width + 1), -1, np.int64)  # the last column is the end
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        inside = np.arange(width) < size[:, None]
        sym[:, :width][inside] = flat
        after = np.minimum(np.arange(1, width + 1), size[:, None])
        after = np.where(after < size[:, None], after, width)
        before = np.tile(np.arange(-1, width), (rows, 1))  # column ``width``: not used
        tree = np.full((rows, 2 * width), NONE, np.int64)
        r = self.ranks(sym[:, :width], np.where(inside, np.take_along_axis(sym, after, 1), -1))
        r[~inside] = NONE
        tree[:, width:] = np.where(r < NONE, r * width + np.arange(width), NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            r, i = np.divmod(tree[live, 1], width)
            j = after[live, i]
            k = after[live, j]
            new = self.merged[r]
            sym[live, i] = new
            sym[live, j] = -1
            after[live, i] = k
            before[live, np.minimum(k, width)] = i
            h = before[live, i]
            right = self.ranks(new, sym[live, k])
            left = self.ranks(np.where(h >= 0, sym[live, h], 0), np.where(h >= 0, new, -1))
            tree[live, width + j] = NONE
            tree[live, width + i] = np.where(right < NONE, right * width + i, NONE)
            known = h >= 0
            tree[live[known], width + h[known]] = np.where(left < NONE, left * width + h, NONE)[known]
            nodes = np.stack([i, j, np.where(known, h, i)]) + width
            while nodes[0, 0] > 1:
                nodes >>= 1
                tree[live, nodes] = np.minimum(tree[live, 2 * nodes], tree[live, 2 * nodes + 1])
            live = live[tree[live, 1] < NONE]
        sym = sym[:, :width]
        kept = sym >= 0
        return np.split(sym[kept], np.cumsum(kept.sum(axis=1))[:-1])

    def learn(self, words: set[str]) -> None:
        """Encodes words into the dictionary."""
        by: dict[int, list[str]] = {}
        for w in words:
            n = len(w.encode("utf-8", "surrogatepass"))
            by.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(w)
        for width, group in by.items():
            data = [w.encode("utf-8", "surrogatepass") for w in group]
            got = map(self._wide, data) if width > WIDE else self._group(data, width)
            for w, ids in zip(group, got, strict=True):
                self.cache[w] = np.asarray(ids, np.uint32).tobytes()

    def blocks(self, text: str, size: int = BLOCK) -> Iterator[np.ndarray]:
        """Ids of the whole text, a block of words at a time."""
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield np.array([self.special[part]], np.uint32)
                continue
            it = (m.group() for m in WORD.finditer(part)) if len(part) > 8 * size else iter(WORD.findall(part))
            while words := list(islice(it, size)):
                got = list(map(self.cache.get, words))
                if None in got:
                    if len(self.cache) > CACHE:
                        self.cache.clear()
                    self.learn({w for w in words if w not in self.cache})
                    got = [self.cache[w] for w in words]
                yield np.frombuffer(b"".join(got), np.uint32)

    def encode(self, text: str) -> list[int]:
        return [int(i) for b in self.blocks(text) for i in b]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def learn_all(self, texts: list[str]) -> None:
        """Encodes the new words of several texts together, which makes larger groups."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new: set[str] = set()
        for t in texts:
            new.update(w for w in WORD.findall(t) if w not in self.cache)
        self.learn(new)


_open: dict[str, Tokenizer] = {}


def open_tokenizer(path: str) -> Tokenizer:
    """The tokenizer at ``path``, once a process."""
    if path not in _open:
        _open[path] = Tokenizer(path)
    return _open[path]


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tok = open_tokenizer(path)
    for whole in batches:
        for a in range(0, whole.num_rows, 512):
            batch = whole.slice(a, 512)
            tok.learn_all([t for t in batch.column(1).to_pylist() if t and len(t) < 8 * BLOCK])
            out: list[tuple[int, str, str]] = []
            for t in batch.column(1):
                text = t.as_py() or ""
                n, ids_sha, text_sha, tail = 0, hashlib.sha256(), hashlib.sha256(), b""
                for ids in tok.blocks(text):
                    some = ids.tolist()
                    ids_sha.update(("," * (n > 0) + ",".join([tok.decimal[i] for i in some])).encode())
                    n += len(some)
                    data = tail + b"".join([tok.bytes_of[i] for i in some])
                    cut = len(data)  # a character may go on in the next block
                    while cut and len(data) - cut < 3 and data[cut - 1] & 0xC0 == 0x80:
                        cut -= 1
                    cut -= bool(cut and data[cut - 1] >= 0xC0)
                    text_sha.update(data[:cut].decode("utf-8", "replace").encode())
                    tail = data[cut:]
                text_sha.update(tail.decode("utf-8", "replace").encode())
                out.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
            n, i, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row; a map without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lambda it: (pa.RecordBatch.from_arrays(b.columns, names=[id_col, *b.schema.names[1:]]) for b in _digests(it, path)), schema)


def _encode(batches: Iterator[pa.RecordBatch], path: str, at: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    tok = open_tokenizer(path)
    for batch in batches:
        texts = batch.column(at).to_pylist()
        tok.learn_all([t for t in texts if t and len(t) < 8 * BLOCK])
        ids = [np.concatenate([*tok.blocks(t or ""), np.zeros(0, np.uint32)]) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*columns, "token_ids"])


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``."""
    docs = docs.drop("token_ids")
    at = docs.columns.index(text_col)
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda it: _encode(it, path, at, columns), f"{fields}, token_ids array<int>")


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with ``decoded``: the text of its ids."""

    @F.pandas_udf("string")
    def text(ids):
        tok = open_tokenizer(path)
        return ids.map(lambda x: None if x is None else tok.decode(list(x)))

    return tokens.withColumn("decoded", text(F.col(ids_col)))
