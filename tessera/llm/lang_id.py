"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes (A-Z lower-cased) in windows of ``Model.width`` bytes that cover the
whole text. Two gated recurrent units, one per direction, give two states at every
byte; a softmax over both labels that byte with a distribution over the languages.
A document's probabilities are the mean of these over the bytes of its letters (ASCII letters and bytes of 0x80 and up).

The network is trained here, in numpy, by backpropagation through time with Adam, every byte of a letter
being a labelled case. The training set is a bounded sample of labelled rows: at most
``docs_per_lang`` documents of each language, those with the smallest hashes of id and text, and of each at most
``pieces`` evenly spaced pieces of ``width`` characters. The bound does not depend on the size of the table;
prediction covers every byte of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; null ids are predicted like others but
never trained on; no labelled rows at all make every prediction ``und``; repeated rows are predicted each; a table without
rows gives none. ``annotate`` passes on all columns and replaces columns named like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
LETTER = regex.compile(r"\p{L}")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
COUNTS = np.zeros(256, np.float32)
COUNTS[97:123] = 1
COUNTS[128:] = 1


@dataclass
class Model:
    """``params``: per direction ``W`` (256, 3H), ``U`` (3H, H), ``b`` (3H); ``V`` (L, 2H) and ``c`` (L). Gates: update, reset, candidate."""

    langs: list[str]
    params: dict[str, np.ndarray]
    width: int

    @property
    def hidden(self) -> int:
        return self.params["Uf"].shape[1]


def _new(langs: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, 0.4, (256, 3 * hidden))
        p[f"U{d}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
        p[f"b{d}"] = np.zeros(3 * hidden)
    p["V"] = rng.normal(0, (2 * hidden) ** -0.5, (langs, 2 * hidden))
    p["c"] = np.zeros(langs)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(a: np.ndarray) -> np.ndarray:
    """In place; one ``tanh`` is faster than ``exp`` and a division."""
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def _forward(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None, reverse: bool = False) -> np.ndarray:
    """States (T, H, B) after each byte of ``x`` (T, B). ``keep`` gathers what the backward pass needs."""
    steps, size = x.shape
    n = u.shape[1]
    out = np.empty((steps, n, size), np.float32)
    h = np.zeros((n, size), np.float32)
    g = np.empty((3 * n, size), np.float32)
    # Biases of update and reset can be added to the input weights; the candidate's is inside the reset.
    w = w + np.concatenate([b[: 2 * n], np.zeros(n, np.float32)])
    inner = b[2 * n :, None]
    rows = np.empty((size, 3 * n), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.take(w, x[t], axis=0, out=rows, mode="clip")
        into = rows.T
        np.matmul(u, h, out=g)
        gates, cand = g[: 2 * n], g[2 * n :]
        gates += into[: 2 * n]
        _sigmoid(gates)
        cand += inner
        if keep is not None:
            keep.append((t, h, gates.copy(), cand.copy()))
        cand *= gates[n:]
        cand += into[2 * n :]
        np.tanh(cand, out=cand)
        if keep is not None:
            keep[-1] += (cand.copy(),)
        new = out[t]
        np.subtract(h, cand, out=new)
        new *= gates[:n]
        new += cand
        h = new
    return out


def _probabilities(p: dict[str, np.ndarray], hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """(T, L, B): the distribution at every byte."""
    n = hf.shape[1]
    s = np.matmul(p["V"][:, :n], hf)
    s += np.matmul(p["V"][:, n:], hb)
    s += p["c"][:, None]
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    return s


def _backward(x: np.ndarray, dh_all: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of W, U and b of one direction, through all steps."""
    n = u.shape[1]
    size = x.shape[1]
    dw, du, db = np.zeros((256, 3 * n), np.float32), np.zeros_like(u), np.zeros(3 * n, np.float32)
    carry = np.zeros((n, size), np.float32)
    for t, h, gates, inner, cand in reversed(keep):
        dh = dh_all[t] + carry
        z, r = gates[:n], gates[n:]
        da = dh * (1 - z) * (1 - cand * cand)
        dz = dh * (h - cand) * z * (1 - z)
        dr = da * inner * r * (1 - r)
        di = da * r
        din = np.concatenate([dz, dr, da])  # to the input weights
        drec = np.concatenate([dz, dr, di])  # to the recurrent weights
        np.add.at(dw, x[t], din.T)
        du += drec @ h.T
        db += drec.sum(axis=1)
        carry = dh * z + u.T @ drec
    return dw, du, db


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy per letter byte of windows ``x`` (T, B) with labels ``y`` (B), and its gradients."""
    kf: list = []
    kb: list = []
    hf, hb = _forward(x, p["Wf"], p["Uf"], p["bf"], kf), _forward(x, p["Wb"], p["Ub"], p["bb"], kb, reverse=True)
    n = hf.shape[1]
    q = _probabilities(p, hf, hb)
    weight = COUNTS[x]
    weight /= max(1.0, float(weight.sum()))
    at = np.arange(x.shape[1])
    loss = -float((np.log(q[:, y, at] + 1e-9) * weight).sum())
    q[:, y, at] -= 1
    q *= weight[:, None, :]
    g = {"c": q.sum(axis=(0, 2)), "V": np.concatenate([np.einsum("tlb,thb->lh", q, hf, optimize=True), np.einsum("tlb,thb->lh", q, hb, optimize=True)], axis=1)}
    for d, h, keep, cols in (("f", hf, kf, slice(0, n)), ("b", hb, kb, slice(n, None))):
        g[f"W{d}"], g[f"U{d}"], g[f"b{d}"] = _backward(x, np.matmul(p["V"][:, cols].T, q), p[f"U{d}"], keep)
    return loss, g


def train(pieces: list[bytes], labels: list[str], hidden: int = 8, width: int = 96, epochs: int = 6, least_steps: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Model:
    """Fits the network to labelled pieces of text, in ``epochs`` passes, more if they make fewer than ``least_steps`` steps."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    p = _new(len(langs), hidden, rng)
    x = np.zeros((len(pieces), width), np.uint8)
    for i, s in enumerate(pieces):
        part = np.frombuffer(s[:width], np.uint8)
        x[i, : len(part)] = part
    x = LOWER[x]
    y = np.array([langs.index(s) for s in labels])
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    per_epoch = max(1, -(-len(x) // batch))
    epochs = max(epochs, -(-least_steps // per_epoch))
    total = epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            _, g = loss_and_gradients(p, np.ascontiguousarray(x[rows].T), y[rows])
            norm = np.sqrt(sum(float((k * k).sum()) for k in g.values()))
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for k in p:
                d = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(langs, p, width)


def pooled(model: Model, texts: list[bytes], block: int = 2048) -> np.ndarray:
    """(documents, L): mean probabilities over the letter bytes of each whole text."""
    width, p = model.width, model.params
    counts = np.array([-(-len(t) // width) for t in texts])
    out = np.zeros((len(texts), len(model.langs)))
    if not counts.sum():
        return out
    x = np.zeros((int(counts.sum()), width), np.uint8)
    flat, at = x.reshape(-1), 0
    for t, n in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * width
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros(len(texts))
    for a in range(0, len(x), block):
        part = np.ascontiguousarray(LOWER[x[a : a + block]].T)
        q = _probabilities(p, _forward(part, p["Wf"], p["Uf"], p["bf"]), _forward(part, p["Wb"], p["Ub"], p["bb"], reverse=True))
        weight = COUNTS[part]
        q *= weight[:, None, :]
        mine = owner[a : a + block]
        for k, s in enumerate(q.sum(axis=0)):
            out[:, k] += np.bincount(mine, s, len(texts))
        total += np.bincount(mine, weight.sum(axis=0), len(texts))
    return out / np.maximum(total, 1)[:, None]


def sample(docs: DataFrame, docs_per_lang: int = 256, pieces: int = 16, width: int = 96, id_col: str = "doc_id") -> tuple[list[bytes], list[str]]:
    """The bounded training sample: at most ``docs_per_lang * pieces`` pieces of each language, of the documents with the smallest hashes.

    Hashes under a threshold that leaves about four times as many are sorted on the driver, so no task gathers a language. A language
    of which the threshold leaves too few (its texts are null, or it is rare) is looked at again with a higher one.
    """
    size = F.char_length("text")
    gap = F.greatest(F.floor(size / pieces), F.lit(width)).cast("int")
    cut = F.filter(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(F.col("text"), i * gap + 1, F.lit(width))), lambda s: s != "")
    part = (F.xxhash64(id_col, "text") / F.lit(2.0**63) + 1) / 2
    known = docs.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull())
    left = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    rows = known.where(F.col("text").isNotNull()).select("lang", part.alias("h"), cut.alias("cut"))
    taken: list = []
    wide = 4
    while left:
        share = {lang: min(1.0, wide * docs_per_lang / n) for lang, n in left.items()}
        limits = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
        by: dict[str, list] = {}
        for r in rows.join(F.broadcast(limits), "lang").where(F.col("h") <= F.col("share")).select("lang", "h", "cut").collect():
            by.setdefault(r["lang"], []).append(r)
        done = [lang for lang in left if share[lang] == 1.0 or len(by.get(lang, ())) >= docs_per_lang]
        for lang in sorted(done):
            taken += sorted(by.get(lang, ()), key=lambda r: (r["h"], r["cut"]))[:docs_per_lang]
            del left[lang]
        wide *= 16
    taken.sort(key=lambda r: r["lang"])
    return [s.encode() for r in taken for s in r["cut"]], [r["lang"] for r in taken for _ in r["cut"]]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", **bounds: int) -> Model | None:
    """A model of the labelled rows that are not held out; None if there are none."""
    pieces, labels = sample(docs.where(~held_out(id_col)), id_col=id_col, **bounds)
    return train(pieces, labels) if pieces else None


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, columns: list[str], text_col: str, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, max(1, whole.num_rows), rows):
            batch = whole.slice(a, rows)
            texts = batch.column(text_col).to_pylist()
            q = np.zeros((len(texts), 1)) if model is None else pooled(model, [(t or "").encode() for t in texts])
            best = q.argmax(axis=1) if len(texts) else np.zeros(0, int)
            known = [model is not None and t is not None and LETTER.search(t) is not None for t in texts]
            lang = [model.langs[k] if ok else UND for k, ok in zip(best, known, strict=True)]
            score = [min(1.0, max(0.0, float(q[i, k]))) if known[i] else 0.0 for i, k in enumerate(best)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])


def annotate(docs: DataFrame, model: Model | None, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``lang_pred`` and ``score``; a map without a shuffle."""
    docs = docs.drop("lang_pred", "score")
    kept = [c for c in columns or docs.columns]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    need = list(dict.fromkeys([*kept, text_col]))
    return docs.select(*need).mapInArrow(lambda it: _predict(it, model, kept, text_col), schema)
