"""Language-model scoring with a hidden Markov model over words.

States emit word classes (a word's class is a hash of it, the end of a text has its own) and a
class emits its words by their corpus counts, one share of each class being kept for unseen words:
    P(word | state) = P(class | state) * (c + 1) / (class count + class words + 1).
Word counts cover all training texts and are joined back to blocks of texts. Baum-Welch starts from a
bounded sample and then takes whole-corpus rounds: every task sums expected counts over its texts and
the sums are added across partitions. All recursions are scaled; a text longer than ``PIECE`` tokens is cut
into pieces whose transfer matrices carry the forward and the backward vectors from one to the next, in
training as in scoring, so that results are those of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, one_per_id, settled, span_hashes, text_blocks, words_of

STATES, CLASSES = 8, 4096
END = np.uint64(1)  # token hash of the end of a text; its class is 0
PIECE = 1024
BLOCK_TEXT = 8 << 20  # bytes of text whose word counts come back together
SAMPLE_ROWS, SAMPLE_ROUNDS, CORPUS_ROUNDS = 400, 8, 2
COUNT_TOKENS, FLUSH_TOKENS = 1_500_000, 300_000  # tokens that a task holds when counting words, and for the recursions


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # CLASSES x STATES


def class_of(tokens: np.ndarray) -> np.ndarray:
    c = 1 + ((tokens >> np.uint64(20)) % np.uint64(CLASSES - 1)).astype(np.int64)
    c[tokens == END] = 0
    return c


def tokens_of(buf: np.ndarray, offsets: np.ndarray):
    """Token hashes of all texts one after another, each followed by END, and their offsets."""
    starts, ends, doc = words_of(buf, offsets)
    docs = len(offsets) - 1
    count = np.bincount(doc, minlength=docs) + 1
    begin = np.zeros(docs + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    out = np.full(begin[-1], END, np.uint64)
    out[np.arange(len(doc)) + doc] = np.maximum(span_hashes(buf, starts, ends), np.uint64(2))
    return out, begin


def gathered(batches, size: int):
    """Token runs of many batches: (batch rows kept, tokens, offsets), flushed near ``size`` tokens."""
    keys, tokens, lengths, held = [], [], [], 0
    for batch in batches:
        for lo, hi, buf, offsets in text_blocks(batch):
            t, begin = tokens_of(buf, offsets)
            keys.append(batch.slice(lo, hi - lo))
            tokens.append(t)
            lengths.append(np.diff(begin))
            held += len(t)
            if held >= size:
                yield keys, np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
                keys, tokens, lengths, held = [], [], [], 0
    if keys:
        yield keys, np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def pieces_of(begin: np.ndarray, size: int):
    """Start and length of consecutive pieces of at most ``size`` tokens, with text and first flag."""
    length = np.diff(begin)
    count = -(-length // size)
    text = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[text] + number * size
    return start, np.minimum(size, begin[text + 1] - start), text, number == 0


def ends_of(model: Model, classes: np.ndarray, at: np.ndarray, size: np.ndarray, rows: np.ndarray):
    """State distribution at the end of each piece for each row it starts from, and log10 of the row's probability.

    Pieces start at ``at`` and have ``size`` tokens; ``rows`` are the distributions of their first state, before it emits."""
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    vec = np.broadcast_to(rows, (len(at), *rows.shape)).copy()
    logs = np.zeros(vec.shape[:2])
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # pieces longer than t
    for t in range(steps):
        n = active[t]
        a = vec[:n] if t == 0 else vec[:n] @ model.move
        a = a * model.emit[classes[at[:n] + t]][:, None, :]
        s = a.sum(2, keepdims=True)
        vec[:n] = a / s
        logs[:n] += np.log10(s[:, :, 0])
    back = np.argsort(order)
    return vec[back], logs[back]


def boundaries(model: Model, classes: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray):
    """For each piece: the state distribution at its end, that of the backward values there (any scale), and log10 of its probability after what comes before.

    Pieces are in text order."""
    end, log, after = np.empty((len(start), STATES)), np.zeros(len(start)), np.ones((len(start), STATES))
    one = np.flatnonzero(first)
    vec, logs = ends_of(model, classes, start[one], length[one], model.start[None])
    end[one], log[one] = vec[:, 0], logs[:, 0]
    later = np.flatnonzero(~first)
    vec, logs = ends_of(model, classes, start[later], length[later], model.move)  # row i: from state i of the token before
    top = logs.max(1) if len(later) else np.zeros(0)
    matrix = vec * 10.0 ** (logs - top[:, None])[:, :, None]
    for k, p in enumerate(later):
        mixed = end[p - 1] @ matrix[k]
        total = mixed.sum()
        end[p], log[p] = mixed / total, np.log10(total) + top[k]
    for k in range(len(later) - 1, -1, -1):
        back = matrix[k] @ after[later[k]]
        after[later[k] - 1] = back / back.sum()
    return end, after, log


def expected_counts(model: Model, classes: np.ndarray, begin: np.ndarray):
    """Baum-Welch sums (start, move, emit) of the texts; every token and every transition counts."""
    start, length, _, first = pieces_of(begin, PIECE)
    end, after, _ = boundaries(model, classes, start, length, first)
    before = np.zeros_like(end)
    before[1:] = end[:-1]  # of later pieces: the states at the end of the piece before
    # backward values at the end are scaled so that those of every token sum to one with the forward ones
    beta = after / (end * after).sum(1, keepdims=True)
    order = np.argsort(-length, kind="stable")
    start, length, first, before, beta = start[order], length[order], first[order], before[order], beta[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    alpha, scale = [], []
    for t in range(steps):
        n = active[t]
        a = np.where(first[:, None], model.start, before @ model.move) if t == 0 else alpha[-1][:n] @ model.move
        a = a * model.emit[classes[start[:n] + t]]
        s = a.sum(1, keepdims=True)
        alpha.append(a / s)
        scale.append(s)
    move, emit = np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    gammas, at = [], []
    begun = np.zeros(STATES)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if t + 1 < steps and active[t + 1]:
            m = active[t + 1]
            back = model.emit[classes[start[:m] + t + 1]] * beta[:m] / scale[t + 1]
            move += model.move * (alpha[t][:m].T @ back)
            beta[:m] = back @ model.move.T
        g = alpha[t] * beta[:n]
        gammas.append(g)
        at.append(start[:n] + t)
        if t == 0:
            begun = g[first].sum(0)
            back = (model.emit[classes[start]] * beta / scale[0])[~first]  # from the last token of the piece before
            move += model.move * (before[~first].T @ back)
    if steps:
        g, c = np.concatenate(gammas), classes[np.concatenate(at)]
        for k in range(STATES):
            emit[:, k] = np.bincount(c, g[:, k], CLASSES)
    return begun, move, emit


def maximised(begun, move, emit, prior: np.ndarray) -> Model:
    """Model of the expected counts, smoothed by one pseudo text and the classes' overall shares."""
    start = begun + 1.0 / STATES
    emit = emit + 20.0 * prior[:, None]
    move = move + 0.1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def forward(model: Model, classes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """log10 probability of each text's class sequence."""
    start, length, text, first = pieces_of(begin, PIECE)
    return np.bincount(text, boundaries(model, classes, start, length, first)[2], len(begin) - 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(block, hash, n) of docs (block, train, text): each token a block holds, with its count in the block's training texts.

    A block may give a token more than once."""

    def run(batches):
        for keys, tokens, begin in gathered(batches, COUNT_TOKENS):
            block = np.concatenate([k.column(0).to_numpy() for k in keys])
            train = np.concatenate([k.column(1).to_numpy(zero_copy_only=False) for k in keys])
            length = np.diff(begin)
            owner, trains = np.repeat(block, length), np.repeat(train, length)
            order = np.lexsort((tokens, owner))
            owner, tokens, trains = owner[order], tokens[order], trains[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            n = np.add.reduceat(trains.astype(np.int64), first)
            for a in range(0, len(first), 200_000):
                b = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(owner[first[b]]), pa.array(tokens[first[b]].view(np.int64)), pa.array(n[b])], names=["block", "hash", "n"])

    return docs.mapInArrow(run, "block int, hash long, n long")


def corpus_round(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of one Baum-Welch round, summed in every task and then across partitions."""
    shared = texts.sparkSession.sparkContext.broadcast(model_arrays(model))

    def run(batches):
        m = Model(*shared.value)
        sums = None
        for _, tokens, begin in gathered(batches, FLUSH_TOKENS):
            part = expected_counts(m, class_of(tokens), begin)
            sums = part if sums is None else tuple(a + b for a, b in zip(sums, part, strict=True))
        if sums is not None:
            flat = np.concatenate([x.ravel() for x in sums])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "value"])

    rows = texts.select("text").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
    for r in rows:  # as many as the model has parameters
        flat[r["at"]] = r["value"]
    return flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 :].reshape(CLASSES, STATES)


def model_arrays(m: Model):
    return m.start, m.move, m.emit


def train(texts: DataFrame, shares: np.ndarray, seed: int = 7) -> Model:
    """Baum-Welch on texts (doc_id, text): rounds on a bounded sample, then rounds on all rows."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * (0.5 + rng.random((CLASSES, STATES)))
    model = Model(np.full(STATES, 1 / STATES), 0.5 / STATES + 0.5 * np.eye(STATES), emit / emit.sum(0))
    sample = [r["text"] for r in bounded_sample(texts, "doc_id", SAMPLE_ROWS).orderBy("doc_id").collect()]
    if sample:
        batch = pa.RecordBatch.from_arrays([pa.array(sample, pa.string())], names=["text"])
        parts = [(class_of(t), b) for _, t, b in gathered([batch], FLUSH_TOKENS)]
        for _ in range(SAMPLE_ROUNDS):
            sums = [expected_counts(model, c, b) for c, b in parts]
            model = maximised(*(sum(x) for x in zip(*sums, strict=True)), shares)
        for _ in range(CORPUS_ROUNDS):
            model = maximised(*corpus_round(texts, model), shares)
    return model


def score_texts(docs: DataFrame, train_rows) -> DataFrame:
    """Score every text of docs (doc_id, text), learning from the rows where the column ``train_rows`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score. Null counts as empty: one token, the end.
    Rows with a null doc_id are left out and of repeated ids one row stays. Without training rows every count is zero and the
    model is its start. An empty table gives no rows; extra columns are ignored."""
    rows = one_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).collect()[0][0] or 0
    blocks = max(1, -(-total // BLOCK_TEXT))
    rows = rows.select("doc_id", train_rows.alias("train"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    held = settled(word_counts(rows.select("block", "train", "text").repartition("block")))
    # sums are combined before they are shuffled; they are a table of their own, so that Spark can split the join back at common words
    lead = settled(held.groupBy("hash").agg(F.sum("n").alias("c")))
    # class of a hash, as class_of: an unsigned shift, then the remainder
    cls = F.when(F.col("hash") == int(END), F.lit(0)).otherwise(1 + F.shiftrightunsigned("hash", 20) % (CLASSES - 1)).cast("int")
    per_class = lead.where("c > 0").groupBy(cls.alias("cls")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    class_c, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in per_class:  # at most CLASSES rows
        class_c[r["cls"]], class_v[r["cls"]] = r["c"], r["v"]
    n, v = int(class_c.sum()), int(class_v.sum())
    shares = (class_c + 1.0) / (n + CLASSES)
    model = train(rows.where("train").select("doc_id", "text"), shares)
    shared = docs.sparkSession.sparkContext.broadcast((model_arrays(model), class_c, class_v))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        arrays, cc, cv = shared.value
        m = Model(*arrays)
        hashes = right.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, c = hashes[order], right.column("c").to_numpy()[order]
        parts: list[list] = [[], [], [], [], []]
        for keys, tokens, begin in gathered(left.combine_chunks().to_batches(), FLUSH_TOKENS):
            got = c[np.searchsorted(hashes, tokens)]
            classes = class_of(tokens)
            word = np.where(classes == 0, 0.0, np.log10((got + 1.0) / (cc[classes] + cv[classes] + 1.0)))
            base = np.log10((got + 1.0) / (n + v + 1.0))
            add = lambda x, b=begin: np.add.reduceat(x, b[:-1])
            parts[0].append(np.concatenate([k.column(0).to_numpy() for k in keys]))
            parts[1].append(np.diff(begin))
            parts[2].append(add((got > 0).astype(np.int64)))
            parts[3].append(add(base))
            parts[4].append(forward(m, classes, begin) + add(word))
        cols = [np.concatenate(p) if p else np.zeros(0) for p in parts]
        size = len(cols[0])
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_tokens": pa.array(cols[1], pa.int64()), "n_known": pa.array(cols[2], pa.int64()), "train_tokens": pa.array(np.full(size, n), pa.int64()), "base_score": pa.array(cols[3], pa.float64()), "score": pa.array(cols[4], pa.float64())})

    words = settled(held.join(lead, "hash").select("block", "hash", "c"))
    discard(held, lead)
    texts = rows.select("doc_id", "text", "block")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
