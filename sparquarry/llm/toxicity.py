"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two hashed rows, of the word and of how it begins.
Filters of several widths slide over a text, each keeps its greatest response over the
whole text, and a logistic layer weighs them. Thresholds are calibrated by language on
rows that the fit hasn't seen; language is no input of the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample

WIDTHS = (1, 2, 3)
#: A-Z lower-cased; ASCII signs, white space and control characters part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
START = 5
#: Words taken at a time; a longer text is read in overlapping parts.
PART = 1 << 15


def word_buckets(text: str | None, buckets: int) -> np.ndarray:
    """Two rows of buckets, of the words and of their beginnings; the second half of the table is for these."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    whole = np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % np.uint32(buckets)
    start = np.fromiter(map(zlib.crc32, [w[:START] for w in found], repeat(77)), np.uint32, len(found)) % np.uint32(buckets)
    return np.stack([whole, start + np.uint32(buckets)]).astype(np.int32)


@dataclass
class ConvModel:
    """Weights: embeddings (2 * buckets + 1 rows, the last one blank), filters by width, logistic layer."""

    buckets: int
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def tables(self) -> np.ndarray:
        """For every row of the embeddings, its share in each filter at each place of the window."""
        return np.concatenate([self.embed @ f[j] for f in self.filters for j in range(f.shape[0])], axis=1)

    def pooled(self, texts: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
        """Greatest response of each filter over each text, through the rectifier."""
        n, blank, most = self.filters[0].shape[2], 2 * self.buckets, max(WIDTHS)
        out = np.full((len(texts), n * len(WIDTHS)), -np.inf, np.float32)
        # Owner, words, and how far windows may reach: to the blanks after the last part, else to what begins within PART.
        parts = [(d, p, p.shape[1] + most if i + PART >= t.shape[1] else PART + most - 1) for d, t in enumerate(texts) for i in range(0, max(t.shape[1], 1), PART) for p in [t[:, i : i + PART + most - 1]]]
        at = 0
        while at < len(parts):
            size, end = 0, at
            while end < len(parts) and (end == at or size + parts[end][1].shape[1] + most <= 2 * PART):
                size += parts[end][1].shape[1] + most
                end += 1
            pad = np.full((2, most), blank, np.int32)
            ids = np.concatenate([x for _, t, _ in parts[at:end] for x in (t, pad)], axis=1)
            lengths = np.array([t.shape[1] + most for _, t, _ in parts[at:end]])
            own = np.array([reach for _, _, reach in parts[at:end]])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            share = tables[ids[0]] + tables[ids[1]]
            owners, k = np.array([d for d, _, _ in parts[at:end]]), 0
            for w_at, w in enumerate(WIDTHS):
                total = share[: len(share) - w + 1, k * n : (k + 1) * n].copy()
                for j in range(1, w):
                    total += share[j : len(share) - w + 1 + j, (k + j) * n : (k + j + 1) * n]
                k += w
                # Windows that reach past a part's own words and blanks would see the next text, or blanks within a text.
                past = np.repeat(starts + own, lengths)[: len(total)] < np.arange(w, len(total) + w)
                total[past] = -np.inf
                np.maximum.at(out[:, w_at * n : (w_at + 1) * n], owners, np.maximum.reduceat(total, starts, axis=0))
            at = end
        return np.maximum(out + self.bias, 0)

    def scores(self, texts: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
        z = self.pooled(texts, tables).astype(np.float64) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_conv(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, buckets: int, dims: int = 8, n_filters: int = 8, epochs: int = 12, rate: float = 0.08, batch: int = 32, seed: int = 7) -> ConvModel:
    """Fit by Adagrad; only the words that gave a filter's greatest response move.

    Embeddings start at 0, so that words outside the sample add nothing to a response.
    """
    rng = np.random.default_rng(seed)
    m = ConvModel(buckets, np.zeros((2 * buckets + 1, dims), np.float32), [rng.normal(0, 0.7, (w, dims, n_filters)).astype(np.float32) for w in WIDTHS], np.full(n_filters * len(WIDTHS), 0.1, np.float32), rng.normal(0, 0.3, n_filters * len(WIDTHS)), 0.0)
    if not len(texts):
        m.out[:] = 0
        return m
    rate0 = float(np.average(labels, weights=weights))
    m.shift = float(np.log((rate0 + 1e-3) / (1 - rate0 + 1e-3)))
    seen = [np.full(m.embed.shape[0], 1e-2, np.float32), [np.full(f.shape, 1e-2, np.float32) for f in m.filters], np.full(m.bias.shape, 1e-2), np.full(m.out.shape, 1e-2), 1e-2]
    blank, most = 2 * buckets, max(WIDTHS)
    padded = [np.concatenate([t, np.full((2, most), blank, np.int32)], axis=1) for t in texts]
    weights = weights / weights.mean()
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), batch):
            some = order[b : b + batch]
            pooled = np.zeros((len(some), len(m.bias)), np.float32)
            where = np.zeros((len(some), len(m.bias)), np.int64)
            for r, d in enumerate(some):
                e = m.embed[padded[d][0]] + m.embed[padded[d][1]]
                for w_at, f in enumerate(m.filters):
                    w = f.shape[0]
                    z = sum(e[j : len(e) - w + 1 + j] @ f[j] for j in range(w))
                    top = z.argmax(axis=0)
                    s = slice(w_at * n_filters, (w_at + 1) * n_filters)
                    where[r, s], pooled[r, s] = top, z[top, np.arange(n_filters)]
            act = np.maximum(pooled + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.shift, -40, 40)))
            g = (p - labels[some]) * weights[some] / len(some)
            g_act = g[:, None] * m.out[None, :] * (act > 0)
            g_out = act.T @ g + 1e-4 * m.out
            rows, grads = [], []
            for w_at, f in enumerate(m.filters):
                g_f = np.zeros_like(f)
                for r, d in enumerate(some):
                    for j in range(f.shape[0]):
                        s = slice(w_at * n_filters, (w_at + 1) * n_filters)
                        ids = padded[d][:, where[r, s] + j]
                        gz = g_act[r, s].astype(np.float32)
                        e = m.embed[ids[0]] + m.embed[ids[1]]
                        g_f[j] += e.T * gz
                        rows += [ids[0], ids[1]]
                        grads += [f[j].T * gz[:, None]] * 2
                seen[1][w_at] += g_f * g_f
                f -= rate * g_f / np.sqrt(seen[1][w_at])
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            live = (rows != blank) & (np.abs(grads).sum(axis=1) > 0)
            if live.any():
                only, at = np.unique(rows[live], return_inverse=True)
                total = np.zeros((len(only), dims), np.float32)
                np.add.at(total, at, grads[live])
                total += 1e-4 * m.embed[only]
                seen[0][only] += (total * total).mean(axis=1)
                m.embed[only] -= rate * total / np.sqrt(seen[0][only])[:, None]
            g_bias = g_act.sum(axis=0)
            seen[2] += g_bias * g_bias
            m.bias -= (rate * g_bias / np.sqrt(seen[2])).astype(np.float32)
            seen[3] += g_out * g_out
            m.out -= rate * g_out / np.sqrt(seen[3])
            seen[4] += float(g.sum()) ** 2
            m.shift -= rate * float(g.sum()) / seen[4] ** 0.5
    return m


def calibrated(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, least: int = 10) -> float | None:
    """The threshold with the best F1, midway between the scores beside it; None with too few of a label."""
    if min((labels == 1).sum(), (labels == 0).sum()) < least:
        return None
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weights[order]
    hit, all_ = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (all_ + (w * y).sum())
    last = np.append(s[1:] != s[:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float((s[best] + below) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 3000, buckets: int = 1 << 16, label_col: str = "toxic") -> ConvModel:
    """Fit on at most bound labelled documents of either label, whole texts each; a fifth sets the thresholds.

    Without labelled rows the model gives every text the same score of 0.5.
    """
    sample = labelled_sample(docs, labels, label_col, bound, with_lang=True)
    texts = [word_buckets(t, buckets) for t in sample["text"]]
    y, w = sample["label"].to_numpy(np.float64), sample["weight"].to_numpy(np.float64)
    back = sample["doc_id"].map(lambda i: zlib.crc32(f"calibrate {i}".encode()) % 5 == 0).to_numpy(bool) if len(sample) else np.zeros(0, bool)
    model = train_conv([t for t, b in zip(texts, back, strict=True) if not b], y[~back], w[~back], buckets)
    if back.any():
        s = model.scores([t for t, b in zip(texts, back, strict=True) if b], model.tables())
        lang = sample["lang"].to_numpy(object)[back]
        model.threshold = calibrated(s, y[back], w[back]) or 0.5
        for name in {x for x in lang if x is not None}:
            own = lang == name
            found = calibrated(s[own], y[back][own], w[back][own])
            if found is not None:
                model.thresholds[name] = found
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tables = m.tables()
        for batch in batches:
            scores, held, size = [], [], 0
            for t in batch.column(batch.num_columns - 1):
                held.append(word_buckets(t.as_py(), m.buckets))
                size += held[-1].shape[1]
                if size > PART:
                    scores.append(m.scores(held, tables))
                    held, size = [], 0
            if held:
                scores.append(m.scores(held, tables))
            all_ = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(all_, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_toxicity(docs: DataFrame, model: ConvModel, keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The kept columns with score (0 to 1) and toxic, the verdict by the language's threshold.

    Null and empty texts are scored like a text without words. A null or unseen language
    has the threshold of all languages. Every row counts on its own, so repeated rows get
    equal scores. keep names columns of docs, which must not be called score or toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*keep, *([lang_col] if lang_col not in keep else [])]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    out = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias("scored text")).mapInArrow(_score(shared), schema)
    limit = F.lit(model.threshold)
    for name, value in sorted(model.thresholds.items()):
        limit = F.when(F.col(f"`{lang_col}`") == name, F.lit(value)).otherwise(limit)
    return out.withColumn("toxic", F.col("score") >= limit).select(*[F.col(f"`{c}`") for c in keep], "score", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score, predicted (score >= 0.5) and toxic for each row of docs; see score_toxicity."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels), [id_col])
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")
