"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Filters over ``WIDTH`` neighbouring bytes
(one weight per filter, offset and byte value) run over every chunk and are max-pooled; the mean
and the maximum of the chunks' pooled values go through a logistic layer to one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, result_schema, text_blocks, unused

FILTERS, WIDTH, CHUNK, STRIDE = 12, 5, 512, 448
#: The probability from which a text is predicted good; training weighs the classes alike.
THRESHOLD = 0.3


@dataclass
class Model:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    shift: np.ndarray  # FILTERS
    mean_w: np.ndarray
    max_w: np.ndarray
    bias: float


def chunk_starts(offsets: np.ndarray):
    """Start, end and text of the chunks; every byte is in one, neighbours overlap, an empty text has none."""
    length = np.diff(offsets)
    count = np.where(length > 0, 1 + np.maximum(0, -(-(length - CHUNK) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + number * STRIDE
    return start, np.minimum(start + CHUNK, offsets[owner + 1]), owner


def pooled(model: Model, buf: np.ndarray, start: np.ndarray, end: np.ndarray, places: bool = False):
    """Largest filter response of each chunk, rectified; with ``places`` also where it is."""
    n = len(start)
    out, at = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.int64)
    padded = np.concatenate([buf, np.zeros(CHUNK + WIDTH, np.uint8)])
    step = 256  # chunks in one numpy pass
    for a in range(0, n, step):
        s, e = start[a : a + step], end[a : a + step]
        grid = padded[s[:, None] + np.arange(CHUNK + WIDTH - 1)]
        size = e - s
        grid[np.arange(CHUNK + WIDTH - 1) >= size[:, None]] = 0  # bytes past the chunk are zero
        z = model.table[0][grid[:, :CHUNK]]
        for k in range(1, WIDTH):
            z += model.table[k][grid[:, k : CHUNK + k]]
        z[np.arange(CHUNK) >= size[:, None]] = -1e9
        out[a : a + step] = z.max(1)
        if places:
            at[a : a + step] = z.argmax(1) + s[:, None]
    return np.maximum(out + model.shift, 0), at


def combine(pool: np.ndarray, owner: np.ndarray, docs: int):
    """Mean and maximum over each text's chunks (zero for a text without one)."""
    count = np.bincount(owner, minlength=docs)
    mean, top = np.zeros((docs, FILTERS), np.float32), np.zeros((docs, FILTERS), np.float32)
    some = np.flatnonzero(count)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        mean[some] = np.add.reduceat(pool, first, axis=0) / count[some][:, None]
        top[some] = np.maximum.reduceat(pool, first, axis=0)
    return mean, top


def probabilities(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    start, end, owner = chunk_starts(offsets)
    mean, top = combine(pooled(model, buf, start, end)[0], owner, len(offsets) - 1)
    z = mean @ model.mean_w + top @ model.max_w + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 16, rate: float = 0.02, seed: int = 7, least_steps: int = 800) -> Model:
    """Train by Adam on the mean log loss of small batches of whole texts, for ``epochs`` or more: ``least_steps`` batches at least."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.full(FILTERS, 0.0, np.float32), np.zeros(FILTERS, np.float32), 0.0)
    m.mean_w = rng.normal(0, 0.3, FILTERS).astype(np.float32)
    data, y = [(t or "").encode() for t in texts], np.array(labels, np.float32)
    if len(y) == 0:
        return m
    share = float(np.clip(y.mean(), 0.05, 0.95))
    m.bias = float(np.log(share / (1 - share)))
    names = ("table", "shift", "mean_w", "max_w", "bias")
    state = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in names}
    step, epochs = 0, max(epochs, -(-least_steps // (len(data) // batch + 1)))
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            offsets = np.concatenate([[0], np.cumsum([len(data[i]) for i in rows])])
            buf = np.frombuffer(b"".join(data[i] for i in rows), np.uint8)
            start, end, owner = chunk_starts(offsets)
            pool, at = pooled(m, buf, start, end, places=True)
            mean, top = combine(pool, owner, len(rows))
            z = mean @ m.mean_w + top @ m.max_w + m.bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            count = np.maximum(np.bincount(owner, minlength=len(rows)), 1)
            to_pool = (err / count)[owner][:, None] * m.mean_w + (err[owner][:, None] * m.max_w) * (pool >= top[owner])
            to_pool *= pool > 0
            g_table = np.zeros_like(m.table)
            padded = np.concatenate([buf, np.zeros(WIDTH, np.uint8)])
            column = np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(WIDTH):
                byte = np.where(at + k < end[:, None], padded[np.minimum(at + k, len(buf))], 0)
                g_table[k] = np.bincount((byte.astype(np.int64) * FILTERS + column).ravel(), to_pool.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = {"table": g_table, "shift": to_pool.sum(0), "mean_w": mean.T @ err, "max_w": top.T @ err, "bias": err.sum()}
            step += 1
            lr = rate * (1 - step / (epochs * (len(order) // batch + 1) + 1))
            for k in names:
                g, (m1, m2) = grads[k], state[k]
                m1 = 0.9 * m1 + 0.1 * g
                m2 = 0.999 * m2 + 0.001 * g * g
                state[k] = [m1, m2]
                move = lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
                value = getattr(m, k) - move
                setattr(m, k, float(value) if k == "bias" else value.astype(np.float32))
    return m


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, **options) -> Model:
    """Fit on at most ``sample_rows`` labelled rows: docs (doc_id, text) with labels (doc_id, quality 0 or 1)."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    chosen = bounded_sample(marked, "doc_id", sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", "quality", "text").limit(sample_rows).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("quality").to_pylist(), **options)


def score(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with score double and predicted int, or under other ``names``.

    Null and empty texts get the probability of a text without chunks. Texts are read whole; every row gives a row, so that null and
    repeated doc_ids stay and equal rows get equal scores; a score on the threshold is predicted 1; an empty table gives no rows. A kept
    column that bears one of ``names`` is an error; other extra columns are no matter."""
    text = unused(docs, "text_read")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(text))
    schema = result_schema(kept.drop(text), zip(names, ("double", "integer"), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            parts = [probabilities(shared.value, buf, offsets) for _, _, buf, offsets in text_blocks(batch, text)]
            if parts:
                p = np.concatenate(parts)
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=schema.names)

    return kept.mapInArrow(run, schema)
