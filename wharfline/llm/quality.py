"""Quality classifier on random-indexing word vectors.

Every token has two ids: a bucket of its word (case and outer marks removed)
and a bucket of its shape (case, digits, marks; whether it repeats the word
before). Each id owns a sparse random index vector. Over all documents, an id's
context vector is the sum of the index vectors of its neighbours; these sums
are whole numbers, so they don't depend on the order in which tasks end. A
document is the mean of its tokens' word and shape vectors, drawn towards the
training documents' mean as by ``PRIOR_TOKENS`` more tokens, so that a few odd
tokens don't settle a short text. A two-layer network in numpy, fitted on at
most ``TRAIN_ROWS`` labelled documents, gives a logit, and a temperature fitted
on a part kept from training calibrates it.

The word table has a fixed number of buckets, so what reaches the driver and
goes out with the tasks doesn't grow with the corpus.

Only the text is an input of a score. Labels of held-out documents, those whose
crc32 of the id as text leaves no remainder by 5, are never read.

Defined results: a null text is empty, and an empty text is scored as the mean
document; a null id is never held out nor labelled; of repeated labels of an id
the majority counts, 1 on ties; without labels of both classes the score is the
labels' smoothed mean; repeated rows each get their own result; an empty table
gives no rows; other columns are carried by :func:`keep_good` only.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.names import map_carrying, quoted, unused
from wharfline.session import ship

WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 13, 1 << 10, 64, 2, 2
#: Labelled documents that the network is fitted on, at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
PRIOR_TOKENS = 4
SEED = 11
HIDDEN, EPOCHS, BATCH = 24, 60, 256
#: Text whose tokens are counted at once.
_CHUNK_BYTES = 4 << 20
#: The same where a vector is fetched for each token.
_POOL_BYTES = 1 << 17
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
#: Marks around a token that any prose has; a token with a digit is one shape.
_QUIET = b"\"'()[]{},.;:?-"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class _Ids(dict):
    """token -> word bucket * SHAPES + shape bucket; emptied when it gets large."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, token: bytes) -> int:
        raw = token.translate(_SHAPE)
        shape = self.shapes.get(raw)
        if shape is None:
            bare = raw.strip(_QUIET)
            flat = b"0" if b"0" in bare else bytes(c for i, c in enumerate(bare) if i == 0 or c != bare[i - 1])[:8]
            shape = self.shapes[raw] = zlib.crc32(flat) % (SHAPES // 2)
            if len(self.shapes) > 200_000:
                self.shapes.clear()
        if len(self) > 400_000:
            self.clear()
        found = self[token] = zlib.crc32(token.lower().strip(_MARKS)) % WORDS * SHAPES + shape
        return found


def _encode(texts: list[bytes | None], ids: _Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape ids of all texts, and each text's number of tokens."""
    parts = [np.array([ids[t] for t in (x or b"").split()], np.int64) for x in texts]
    sizes = np.array([len(p) for p in parts])
    both = np.concatenate(parts) if parts else np.empty(0, np.int64)
    word, shape = both // SHAPES, both % SHAPES
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    starts = np.cumsum(sizes) - sizes
    again[starts[(sizes > 0)]] = False
    return word, shape + again * (SHAPES // 2), sizes


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero parts of ``n`` random index vectors."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (n, NONZERO)), rng.choice(np.array([-1, 1]), (n, NONZERO))


def _add_contexts(total: np.ndarray, ids: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    for off in range(1, REACH + 1):
        if len(ids) <= off:
            continue
        same = doc[off:] == doc[:-off]
        a, b = ids[:-off][same], ids[off:][same]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(x * DIM + places[y, j], weights=signs[y, j], minlength=len(total)).astype(np.int64)


def _chunks(texts: list[bytes | None], limit: int = _CHUNK_BYTES) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or b"")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The (WORDS + SHAPES, DIM) whole-number context vectors of all documents."""
    names = [f"c{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, shapes = _Ids(), np.zeros(WORDS * DIM, np.int64), np.zeros(SHAPES * DIM, np.int64)
        wi, si = index_vectors(WORDS, SEED), index_vectors(SHAPES, SEED + 1)
        for b in batches:
            for part in _chunks(b.column(0).cast(pa.binary()).to_pylist()):
                w, s, sizes = _encode(part, ids)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                _add_contexts(words, w, doc, *wi)
                _add_contexts(shapes, s, doc, *si)
        both = np.concatenate((words, shapes)).reshape(-1, DIM)
        met = np.flatnonzero(both.any(axis=1))
        for i in range(0, len(met), 2048):
            k = met[i : i + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(np.ascontiguousarray(both[k, c])) for c in range(DIM))], names=["id", *names])

    sums = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in names))
    rows = sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((WORDS + SHAPES, DIM), np.int64)
    out[rows.column("id").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in names], axis=1) if rows.num_rows else 0
    return out


def word_vectors(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit word and shape vectors: the context's direction plus the id's own index vector."""
    out = []
    for part, n, seed in ((contexts[:WORDS], WORDS, SEED), (contexts[WORDS:], SHAPES, SEED + 1)):
        v = part.astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        places, signs = index_vectors(n, seed)
        own = np.zeros((n, DIM))
        np.add.at(own, (np.arange(n)[:, None], places), signs / np.sqrt(NONZERO))
        out.append(v + own)
    return tuple(out)


def pooled(texts: list[bytes | None], vectors: tuple[np.ndarray, np.ndarray], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Mean word and shape vectors of each text, zero for an empty one, and its weight n / (n + prior)."""
    width = vectors[0].shape[1]
    out, weight = np.zeros((len(texts), 2 * width)), np.zeros(len(texts))
    at = 0
    for part in _chunks(texts, _POOL_BYTES):
        w, s, sizes = _encode(part, ids)
        full = np.flatnonzero(sizes)
        if full.size:
            starts = (np.cumsum(sizes) - sizes)[full]
            for k, (v, of) in enumerate(((vectors[0], w), (vectors[1], s))):
                out[at + full, k * width : (k + 1) * width] = np.add.reduceat(v[of], starts, axis=0) / sizes[full, None]
        weight[at : at + len(part)] = sizes / (sizes + PRIOR_TOKENS)
        at += len(part)
    return out, weight


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return self.second((weight[:, None] * (x - self.mean) / self.scale) @ self.w1 + self.b1)

    def second(self, first: np.ndarray) -> np.ndarray:
        return np.tanh(first) @ self.w2 + self.b2

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -30, 30)))


def fit(x: np.ndarray, weight: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the log loss; a fifth of the rows is kept for the temperature."""
    if len(set(y.tolist())) < 2:
        none = np.zeros(0)
        return Network(none, none, none, none, none, 0.0, 1.0, (float(y.sum()) + 1) / (len(y) + 2))
    rng, x = np.random.default_rng(seed), x.astype(np.float64)
    order = rng.permutation(len(x))
    kept, used = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    z = weight[:, None] * (x - mean) / scale
    names = ("w1", "b1", "w2", "b2")
    m, v, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(used)
        for i in range(0, len(mixed), BATCH):
            k = mixed[i : i + BATCH]
            h = np.tanh(z[k] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
            e = (p - y[k]) / len(k)
            d = np.outer(e, net.w2) * (1 - h * h)
            grads = {"w1": z[k].T @ d + 1e-4 * net.w1, "b1": d.sum(axis=0), "w2": h.T @ e + 1e-4 * net.w2, "b2": e.sum()}
            t += 1
            for n, g in grads.items():
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g * g
                setattr(net, n, getattr(net, n) - 3e-3 * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8))
    if len(kept):
        raw, best = net.logits(x[kept], weight[kept]), None
        for temp in np.exp(np.linspace(-1.5, 2.0, 71)):
            p = np.clip(1 / (1 + np.exp(-np.clip(raw / temp, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -(y[kept] * np.log(p) + (1 - y[kept]) * np.log(1 - p)).mean()
            if best is None or loss < best[0]:
                best = (loss, float(temp))
        net.temperature = best[1]
    return net


def _held_out(c: F.col) -> F.col:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Classifier:
    """The network with its first layer applied to each word vector ahead.

    That layer is linear, so the mean of the layer's outputs is its output for
    the mean vector, and far fewer numbers are summed for a token.
    """

    network: Network
    layers: tuple[np.ndarray, np.ndarray] | None
    shift: np.ndarray | None

    @classmethod
    def of(cls, vectors: tuple[np.ndarray, np.ndarray], net: Network) -> Classifier:
        if net.constant is not None:
            return cls(net, None, None)
        w = net.w1 / net.scale[:, None]
        return cls(net, (vectors[0] @ w[:DIM], vectors[1] @ w[DIM:]), -net.mean @ w)

    def score(self, texts: list[bytes | None], ids: _Ids) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.network.constant)
        both, weight = pooled(texts, self.layers, ids)
        first = weight[:, None] * (both[:, :HIDDEN] + both[:, HIDDEN:] + self.shift) + self.network.b1
        return self.network.probability(self.network.second(first))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Classifier:
    """Word vectors from all of ``docs``; the network from a bounded part of ``labels``."""
    vectors = word_vectors(context_vectors(docs, text))
    given = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).dropna().where(~_held_out(F.col("i")))
    given = given.groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("i"), "i").limit(train_rows)
    known = docs.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(text)).cast("string").alias("t"))
    known = known.join(F.broadcast(given), "i")  # at most train_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = np.column_stack(pooled(part.column("t").cast(pa.binary()).to_pylist(), vectors, ids)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["i", "y", "x"])

    got = known.mapInArrow(run, T.StructType([known.schema["i"], known.schema["y"], T.StructField("x", T.BinaryType())]))
    # rows that share a labelled id may be many: at most train_rows vectors are drawn, by hash
    got = got.orderBy(F.xxhash64("i", "x"), "i", "x").limit(train_rows).toArrow()
    rows = sorted(zip(got.column("i").to_pylist(), got.column("y").to_pylist(), got.column("x").to_pylist(), strict=True), key=lambda r: (str(r[0]), r[2]))
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, 2 * DIM + 1)
    return Classifier.of(vectors, fit(x[:, :-1], x[:, -1].astype(np.float64), np.array([r[1] for r in rows], np.float64)))


def scored(docs: DataFrame, model: Classifier, text: str = "text", keep_text: bool = False, name: str = "score") -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) and each document's score, as a new column."""
    if unused(docs.columns, name)[0] != name:
        raise ValueError(f"a column is called {name} already")
    shared = ship(docs.sparkSession, model)  # a fixed number of buckets
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = pickle.loads(shared.value), _Ids()
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(texts, ids), pa.float64())], names=[*b.schema.names[:-1], "a0"])

    return map_carrying(docs, kept, [F.col(quoted(text)).cast("string")], run, [T.StructField(name, T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, doc_id, text, train_rows=train_rows)
    out = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    model = train(docs, labels, doc_id, text, train_rows=train_rows)
    score = unused(docs.columns, "__score")[0]
    return scored(docs, model, text, keep_text=True, name=score).where(F.col(score) >= threshold).drop(score)
