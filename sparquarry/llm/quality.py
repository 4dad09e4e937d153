"""Quality: random-indexing word vectors pooled per document, a two-layer network on top.

A word's vector is the sum of fixed sparse random vectors of the words around it, over
all documents. A document pools its words' vectors; a small numpy network scores the
pools, and one temperature, fitted on rows the fit hasn't seen, calibrates the result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample

#: Runs of ASCII letters, digits and anything beyond ASCII; runs of other signs.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
#: Words on either side that make a context, and words taken at a time.
REACH, PART = 2, 1 << 15


def token_buckets(text: str | None, buckets: int) -> np.ndarray:
    found = TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    return (np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % np.uint32(buckets)).astype(np.int32)


def index_vectors(buckets: int, dims: int, nonzero: int = 4, seed: int = 11) -> np.ndarray:
    """Each bucket's fixed random vector: a few +1 and -1, else 0; the last row is blank."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets + 1, dims), np.int8)
    at = np.argsort(rng.random((buckets, dims)), axis=1)[:, :nonzero]
    out[np.arange(buckets)[:, None], at] = rng.choice(np.array([-1, 1], np.int8), (buckets, nonzero))
    return out


def context_sums(ids: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to total, by bucket, the index vectors of the words around each word; -1 in ids parts texts.

    Long runs are taken in parts, with the words around a part read beside it.
    """
    buckets = len(index) - 1
    around = np.concatenate([np.full(REACH, buckets), np.where(ids < 0, buckets, ids), np.full(REACH, buckets)])
    for i in range(0, len(ids), 2 * PART):
        part = ids[i : i + 2 * PART]
        vectors = index[around[i : i + len(part) + 2 * REACH]]
        context = sum(vectors[REACH + j : REACH + j + len(part)].astype(np.int16) for j in range(-REACH, REACH + 1) if j)
        live = part >= 0
        at, context = part[live], context[live]
        for d in range(index.shape[1]):
            total[d] += np.bincount(at, weights=context[:, d], minlength=buckets).astype(np.int64)


def _contexts(buckets: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(buckets, dims), np.zeros((dims, buckets), np.int64)
        counts = np.zeros(buckets, np.int64)
        gap, held, size = np.full(REACH, -1, np.int32), [], 0

        def flush() -> None:
            ids = np.concatenate(held)
            context_sums(ids, index, total)
            counts[:] += np.bincount(ids[ids >= 0], minlength=buckets)

        for batch in batches:
            for t in batch.column(0):
                held += [token_buckets(t.as_py(), buckets), gap]
                size += len(held[-2]) + REACH
                if size >= PART:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (seen, counts[seen], *total[:, seen])], ["bucket", "c", *(f"d{i}" for i in range(dims))])

    return run


def word_vectors(docs: DataFrame, buckets: int, dims: int, text_col: str = "text") -> np.ndarray:
    """Unit vectors by bucket from the contexts in all documents; 0 for buckets without any.

    Every task adds up its own words; the sums meet by bucket. The driver gets buckets
    rows, whatever the corpus. The commonest direction is taken out before scaling.
    """
    names = [f"d{i}" for i in range(dims)]
    schema = ", ".join(f"{n} long" for n in ("bucket", "c", *names))
    sums = docs.select(F.col(f"`{text_col}`")).mapInArrow(_contexts(buckets, dims), schema).groupBy("bucket").agg(F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in names])
    rows = sums.orderBy("bucket").toPandas()
    out = np.zeros((buckets, dims), np.float64)
    if not len(rows):
        return out.astype(np.float32)
    c = rows["c"].to_numpy(np.float64)
    v = rows[names].to_numpy(np.float64) / c[:, None]
    v -= (v * c[:, None]).sum(axis=0) / c.sum()
    out[rows["bucket"].to_numpy(np.int64)] = v / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
    return out.astype(np.float32)


def pools(texts: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Of each document: mean and spread of its words' vectors, mean over its distinct words, mean step between neighbours, log of its length."""
    dims = vectors.shape[1]
    out = np.zeros((len(texts), 3 * dims + 3), np.float32)
    for r, ids in enumerate(texts):
        n = len(ids)
        if not n:
            continue
        total, squares, step = np.zeros(dims), np.zeros(dims), 0.0
        for i in range(0, n, PART):
            v = vectors[ids[i : i + PART + 1]]
            own = v[:PART]
            total += own.sum(axis=0)
            squares += np.einsum("ij,ij->j", own, own)
            step += float(np.einsum("ij,ij->", v[:-1], v[1:]))
        distinct = np.unique(ids)
        mean = total / n
        out[r, :dims], out[r, dims : 2 * dims] = mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))
        out[r, 2 * dims : 3 * dims] = vectors[distinct].mean(axis=0)
        out[r, 3 * dims :] = step / max(n - 1, 1), np.log1p(n), np.log1p(n) - np.log1p(len(distinct))
    return out


@dataclass
class QualityModel:
    """Word vectors, scaling of the pools, the two layers and the temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.clip((x - self.centre) / self.scale, -6, 6) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, w: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, batch: int = 64, seed: int = 5) -> QualityModel:
    """Fit by Adam with a small weight decay."""
    rng = np.random.default_rng(seed)
    m = QualityModel(vectors, np.zeros(x.shape[1]), np.ones(x.shape[1]), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    if not len(x):
        return m
    m.centre, m.scale = x.mean(axis=0).astype(np.float64), np.maximum(x.std(axis=0), 1e-6).astype(np.float64)
    z, w = np.clip((x - m.centre) / m.scale, -6, 6), w / w.mean()
    params = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for b in range(0, len(order), batch):
            i, t = order[b : b + batch], t + 1
            pre = z[i] @ params[0] + params[1]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - y[i]) * w[i] / len(i)
            gh = g[:, None] * params[2][None, :] * (pre > 0)
            grads = [z[i].T @ gh + 1e-4 * params[0], gh.sum(axis=0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            for k, gr in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * gr
                second[k] = 0.999 * second[k] + 0.001 * gr * gr
                params[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    m.b2 = float(params[3][0])
    return m


def fitted_temperature(logits: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The temperature between 0.25 and 8 of the least log loss."""
    best, loss = 1.0, np.inf
    for t in np.geomspace(0.25, 8, 61):
        p = 1 / (1 + np.exp(-np.clip(logits / t, -40, 40)))
        now = -np.average(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12), weights=w)
        if now < loss:
            best, loss = float(t), now
    return best


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = 3000, buckets: int = 1 << 14, dims: int = 32, label_col: str = "quality") -> QualityModel:
    """Word vectors from all documents; the network from at most bound labelled ones of either label, whole texts each.

    A fifth of the sample sets the temperature. Without labelled rows every text scores 0.5.
    """
    vectors = word_vectors(docs, buckets, dims)
    sample = labelled_sample(docs, labels, label_col, bound)
    x = pools([token_buckets(t, buckets) for t in sample["text"]], vectors)
    y, w = sample["label"].to_numpy(np.float64), sample["weight"].to_numpy(np.float64)
    back = np.array([zlib.crc32(f"calibrate {i}".encode()) % 5 == 0 for i in sample["doc_id"]], bool)
    model = train_network(x[~back], y[~back], w[~back], vectors)
    if back.any():
        model.temperature = fitted_temperature(model.logits(x[back]), y[back], w[back])
    if not len(sample):
        model.w2[:] = 0
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = [m.scores(pools([token_buckets(t.as_py(), len(m.vectors))], m.vectors))[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """id, held_out, score (0 to 1), predicted (score >= least) for each row of docs.

    Null and empty texts are scored like a text without words. Every row counts on its
    own, so repeated rows get equal scores; a null id is held out. Other columns aren't
    read. An empty table gives an empty result.
    """
    model = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`")).mapInArrow(_score(shared), "id long, score double")
    scored = scored.withColumnRenamed("id", id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
