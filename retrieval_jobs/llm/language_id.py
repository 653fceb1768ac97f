"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are byte runs of length 1 to 4 of the lower-cased text, hashed to buckets. A text's vector is
the mean of its buckets' embeddings; a linear softmax names the language. Both layers are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows; a temperature and a
rejection threshold are fitted on a part of the sample that training never sees. As the model is
linear in the mean, each bucket's class scores are worked out once and a whole text is scored by
adding table rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, result_schema, text_blocks, unused

#: The model learns at most so many languages, the most frequent ones.
LANGUAGES = 1000
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
PIECE = 1 << 17  # bytes whose buckets are looked up at a time

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48  # digits alike
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: bucket embedding times output layer
    bias: np.ndarray
    temperature: float
    threshold: float  # a text of lower confidence is rejected


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes starting at each place (len(data) - n + 1 of them)."""
    code = np.full(max(0, len(data) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        code = (code ^ _FOLD[data[k : k + len(code)]]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
    return code & np.uint32(BUCKETS - 1)


def _counts(text: bytes):
    data = np.frombuffer(text, np.uint8)
    ids, n = np.unique(np.concatenate([buckets(data, n) for n in GRAMS]), return_counts=True)
    return ids.astype(np.uint16), (n / max(1, n.sum())).astype(np.float32)


class Examples:
    """Bucket shares of the training texts, in few large arrays (BUCKETS fit 16 bits)."""

    def __init__(self, texts, languages, names: list[str], seed: int):
        rng, number = np.random.default_rng(seed), {k: i for i, k in enumerate(names)}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        whole: list[tuple[np.ndarray, np.ndarray]] = []
        size, label, held = [], [], []

        def add(data, y, apart):
            ids, share = _counts(data)
            parts.append((ids, share))
            size.append(len(ids))
            label.append(y)
            held.append(apart)
            if len(parts) == 512:
                whole.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts.clear()

        for i, (text, lang) in enumerate(zip(texts, languages, strict=True)):
            data = (str(text) if text is not None else "").encode()
            if not has_letter(data):
                continue
            add(data, number[str(lang)], i % 5 == 0)
            if len(data) > 80:  # a short piece as well, as short texts occur
                at, n = int(rng.integers(0, len(data) - 40)), int(rng.integers(20, 200))
                add(data[at : at + n], number[str(lang)], i % 5 == 0)
        whole += parts
        self.ids, self.share = (np.concatenate(x) for x in zip(*whole, strict=True)) if whole else (np.zeros(0, np.uint16), np.zeros(0, np.float32))
        self.at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.label, self.held = np.array(label, np.int64), np.array(held, bool)

    def __getitem__(self, i: int):
        a, b = self.at[i], self.at[i + 1]
        return self.ids[a:b], self.share[a:b], self.label[i]


def fit(texts, languages, dim: int = 16, epochs: int = 6, rate: float = 20.0, seed: int = 7, reject_share: float = 0.001) -> Model:
    """Train on parallel sequences. ``reject_share``: part of rightly named calibration texts that may be rejected."""
    names = sorted({str(x) for x in languages})
    rows, rng = Examples(texts, languages, names, seed), np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    train = np.flatnonzero(~rows.held)
    weight = (len(train) / (len(names) * np.maximum(1, np.bincount(rows.label[train], minlength=len(names))))).astype(np.float32)
    for epoch in range(epochs):
        for step, k in enumerate(rng.permutation(train)):
            ids, share, y = rows[k]
            lr = rate * (1 - (epoch + step / len(train)) / epochs)
            vec = share @ emb[ids]
            z = vec @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= min(weight[y], 4.0)
            back = out @ p
            out -= lr * 0.1 * np.outer(vec, p)
            bias -= lr * 0.001 * p
            emb[ids] -= lr * share[:, None] * back
    scores = emb @ out
    held = np.flatnonzero(rows.held) if rows.held.any() else train
    z = np.array([rows[k][1] @ scores[rows[k][0]] + bias for k in held]).reshape(len(held), len(names))
    y = rows.label[held]

    def probs(t):
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature, threshold = 1.0, 0.0
    if len(y):
        loss = {t: -np.log(probs(t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.25, 8, 21)}
        temperature = float(min(loss, key=loss.get))
        p = probs(temperature)
        right = np.sort(p.max(1)[p.argmax(1) == y])
        if len(right):
            threshold = float(min(right[int(reject_share * len(right))], 0.5))
    # buckets that training never met say nothing
    seen = np.zeros(BUCKETS, bool)
    for k in train:
        seen[rows[k][0]] = True
    scores[~seen] = 0
    return Model(names, scores.astype(np.float32), bias, temperature, threshold)


def has_letter(data: bytes) -> bool:
    """Whether the text has a letter of any alphabet."""
    view = np.frombuffer(data, np.uint8)
    if _LETTER[view].any():
        return True
    return bool((view >= 128).any()) and any(c.isalpha() for c in data.decode("utf-8", "replace"))


def train(docs: DataFrame, sample_rows: int = 6000, **options) -> Model:
    """Fit on at most ``sample_rows`` rows of (doc_id, text, lang) with a language and a text.

    Rare languages are kept: each language gets its share of the bound, at least as many rows as any other if it has them.
    Only the ``LANGUAGES`` most frequent values of ``lang`` are learned, as the model has a column for each."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    nothing = Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    if not counts:
        return nothing
    each = sample_rows / len(counts)
    odds = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * each / n))) for k, n in counts.items()], F.lit(0.0))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_000)) < odds * 1_000_000)
    sample = bounded_sample(drawn, "doc_id", sample_rows).coalesce(1)

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("doc_id", "lang", "text")])
        m = fit(rows.column("text"), rows.column("lang"), **options)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.languages]), pa.array([m.scores.tobytes()]), pa.array([m.bias.tobytes()]), pa.array([m.temperature]), pa.array([m.threshold])],
            names=["languages", "scores", "bias", "temperature", "threshold"],
        )

    # the sample is learned in a task of its own; only the model comes to the driver
    found = sample.mapInArrow(run, "languages array<string>, scores binary, bias binary, temperature double, threshold double").collect()
    if not found:
        return nothing
    m = found[0]
    scores = np.frombuffer(m["scores"], np.float32).reshape(BUCKETS, -1)
    return Model(list(m["languages"]), scores, np.frombuffer(m["bias"], np.float32), m["temperature"], m["threshold"])


def bucket_sums(scores: np.ndarray, buf: np.ndarray, offsets: np.ndarray):
    """Sum of the score rows of each text's byte runs, and their number. Runs across a border belong to no text.

    At most ``PIECE`` bytes are looked up at a time, however long a text is."""
    total, grams = np.zeros((len(offsets) - 1, scores.shape[1])), np.zeros(len(offsets) - 1)
    for n in GRAMS:
        grams += np.maximum(np.diff(offsets) - n + 1, 0)
        for a in range(0, len(buf), PIECE):
            code = buckets(buf[a : a + PIECE + n - 1], n)
            if not len(code):
                continue
            first, last = np.searchsorted(offsets, [a, a + len(code) - 1], "right") - 1
            text = np.arange(first, last + 1)
            lo, hi = np.maximum(offsets[text], a) - a, np.minimum(offsets[text + 1] - n + 1 - a, len(code))
            text, lo, hi = text[hi > lo], lo[hi > lo], hi[hi > lo]
            values = np.zeros((len(code) + 1, scores.shape[1]))
            np.cumsum(scores[code], axis=0, dtype=np.float64, out=values[1:])
            total[text] += values[hi] - values[lo]
    return total, grams


def probabilities(m: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x languages, after the temperature."""
    total, grams = bucket_sums(m.scores, buf, offsets)
    z = (total / np.maximum(grams, 1)[:, None] + m.bias) / m.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred string, score double and rejected boolean, or under other ``names``.

    ``und`` with score 0 and rejected for null text and text without a letter. Texts are read whole; ties go to the first
    language in name order; every row gives a row, so that null and repeated doc_ids stay and equal rows get equal results; an
    empty table gives no rows. A kept column that bears one of ``names`` is an error; other extra columns are no matter."""
    text = unused(docs, "text_read")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(text))
    schema = result_schema(kept.drop(text), zip(names, ("string", "double", "boolean"), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            pred, score, rejected = [], [], []
            for lo, hi, buf, offsets in text_blocks(batch, text):
                p = probabilities(m, buf, offsets)
                best = p.argmax(1)
                letters = np.zeros(len(buf) + 1, np.int64)
                np.cumsum(_LETTER[buf], out=letters[1:])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = has_letter(buf[offsets[i] : offsets[i + 1]].tobytes())
                top = p[np.arange(hi - lo), best]
                pred += [m.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                score.append(np.where(has, top, 0.0))
                rejected.append(~has | (top < m.threshold))
            if pred:
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))], names=schema.names)

    return kept.mapInArrow(run, schema)
