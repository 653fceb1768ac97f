"""Dense and sparse search, and their fusion.

Questions carry ``query_id``; where they are confined to items, ``query_items`` (query_id, item_name)
says so and becomes an equi-join. Scores are rounded to 6 digits before they order anything.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
#: Questions that are sent to the rows at a time (32 MB of 1,024 single-precision dimensions).
BROADCAST_QUESTIONS = 8192
#: Vectors of a block (2 and 8 MB of 1,024 double-precision dimensions).
QUESTION_BLOCK, CHUNK_BLOCK = 256, 1024
#: Weights of a block of sparse vectors (4 MB), the words of two blocks that are multiplied as dense columns, products that are summed up at a time for the others.
BLOCK_WEIGHTS, HEAVY, AT_ONCE = 300_000, 512, 1 << 18
#: Ids that are sent to a table to say which of its rows are wanted; beyond that both are shuffled.
BROADCAST_IDS = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key; Spark pushes the limit below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def wanted(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of ``table`` whose ``key`` is among ``ids``, which are counted: up to ``BROADCAST_IDS`` go to the rows, so that these stay where they are."""
    ids = ids.select(key).distinct()
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def filter_items(queries: DataFrame, table: DataFrame, item: str = "item_name", items: str = "item_names") -> DataFrame:
    """Rows of ``table`` within the items of each question, with query_id: an equi-join on the item."""
    asked = queries.select("query_id", F.explode(F.array_distinct(items)).alias(item))
    return table.join(asked, item)


def packed(df: DataFrame, id_col: str, vector: str, item: str | None, rows: int) -> DataFrame:
    """(item, dim, ids, flat): up to ``rows`` unit vectors of one item and dimension in a row, packed where they lie, without a shuffle.

    Null, zero and non-finite vectors take no part."""
    kind = df.schema[id_col].dataType
    fields = [T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("flat", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*([df.schema[item]] if item else []), *fields])

    def pack(batches):
        waiting: dict = {}

        def block(key):
            ids, vectors = zip(*waiting.pop(key), strict=True)
            cells = [pa.array([key[1]], pa.int32()), pa.array([list(ids)], pa.list_(id_type)), pa.array([np.concatenate(vectors)], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([*([pa.array([key[0]], item_type)] if item else []), *cells], names=schema.names)

        for batch in batches:
            id_type, item_type = batch.column(0).type, batch.column(batch.num_columns - 1).type
            items = batch.column(2).to_pylist() if item else [None] * batch.num_rows
            for i, own, cell in zip(batch.column(0).to_pylist(), items, batch.column(1), strict=True):
                v = cell.values.to_numpy(zero_copy_only=False).astype(np.float64)
                norm = np.sqrt(v @ v)
                if not norm > 0 or not np.isfinite(norm):
                    continue
                waiting.setdefault((own, len(v)), []).append((i, v / norm))
                if len(waiting[own, len(v)]) >= rows:
                    yield block((own, len(v)))
            if sum(map(len, waiting.values())) > 16 * rows:
                yield from [block(key) for key in list(waiting)]
        yield from [block(key) for key in list(waiting)]

    return df.where(F.size(vector) > 0).select(id_col, vector, *([item] if item else [])).mapInArrow(pack, schema)


def _likeliest(scores: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (question, chunk) of the best ``k`` finite scores of each question and of those that may equal them after rounding; of exactly equal ones the first ``k`` ids."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    q, c = np.nonzero((scores >= (least - 2 * 10.0**-DIGITS)[:, None]) & (scores > -np.inf))
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place[c], scores[q, c], q))
    q, c = q[order], c[order]
    own = np.ones(len(q), bool)
    own[1:] = (q[1:] != q[:-1]) | (scores[q[1:], c[1:]] != scores[q[:-1], c[:-1]])
    near = np.arange(len(q)) - np.maximum.accumulate(np.where(own, np.arange(len(q)), 0)) < k
    return q[near], c[near]


def _products(blocks: DataFrame, query_type, chunk_type, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of the likeliest ``k`` chunks, and their equals after rounding, of each question in each pair of blocks."""
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())])

    def multiply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                asks, chunks = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (2, 4))
                scores = asks @ chunks.T
                q, c = _likeliest(scores, batch.column(3)[r].values, k)
                yield pa.RecordBatch.from_arrays([batch.column(1)[r].values.take(pa.array(q)), batch.column(3)[r].values.take(pa.array(c)), pa.array(scores[q, c])], names=schema.names)

    return blocks.mapInArrow(multiply, schema)


def dense_topk(queries: DataFrame, table: DataFrame, k: int = 5, item: str | None = "item_name") -> DataFrame:
    """Cosine search: queries (query_id, q_dense, item) against table (chunk_id, dense, item).

    Questions and chunks meet as blocks, by one matrix product for each pair of blocks of an item, whose best k a question are merged: no row is made for a pair of
    vectors. A hot item has many blocks, which Spark's skew join splits. Without an item the counted questions are broadcast, ``BROADCAST_QUESTIONS`` at a time.
    Null, zero and non-finite vectors, and vectors of another dimension, are no hits."""
    right = packed(table, "chunk_id", "dense", item, CHUNK_BLOCK)
    right = right.withColumnsRenamed({"ids": "c_ids", "flat": "c_flat"})
    keys = ["dim", *([item] if item else [])]
    columns = ["dim", "ids", "flat", "c_ids", "c_flat"]
    if item:
        pairs = packed(queries, "query_id", "q_dense", item, QUESTION_BLOCK).join(right, keys).select(*columns)
    else:
        blocks = max(1, -(-queries.count() // BROADCAST_QUESTIONS))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        each = [packed(queries.where(block == b), "query_id", "q_dense", None, QUESTION_BLOCK) for b in range(blocks)]
        pairs = functools.reduce(DataFrame.unionByName, [right.join(F.broadcast(q), keys).select(*columns) for q in each])
    found = _products(pairs, queries.schema["query_id"].dataType, table.schema["chunk_id"].dataType, k)
    scored = found.withColumn("score", F.round("score", DIGITS))
    return top_per(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def weighted_tokens(queries: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, keys, token, q_weight): the words of each question and item, weights of repeated ones added."""
    rows = queries.select("query_id", *keys, F.explode("q_sparse").alias("token", "w"))
    return rows.groupBy("query_id", *keys, "token").agg(F.sum(F.col("w").cast("double")).alias("q_weight"))


def packed_maps(df: DataFrame, id_col: str, weights: str, item: str | None, rows: int) -> DataFrame:
    """(item, ids, starts, words, at, weights): up to ``rows`` weight maps of one item, of ``BLOCK_WEIGHTS`` weights if they are not fewer, in a row, packed where they lie.

    A map's weights lie from its start to the next; ``at`` tells the place of each one's word in ``words``, which has every word of the block once."""
    kind, word = df.schema[id_col].dataType, df.schema[weights].dataType.keyType
    lists = {"ids": kind, "starts": T.IntegerType(), "words": word, "at": T.IntegerType(), "weights": T.DoubleType()}
    schema = T.StructType([*([df.schema[item]] if item else []), *[T.StructField(name, T.ArrayType(t)) for name, t in lists.items()]])

    def block(own, part, item_type):
        maps = part.column(1)
        starts = maps.offsets.to_numpy()
        inside = slice(starts[0], starts[-1])
        words = maps.keys[inside].dictionary_encode()
        cells = [part.column(0), pa.array((starts - starts[0]).astype(np.int32)), words.dictionary, words.indices, pc.fill_null(maps.items[inside], 0.0)]
        cells = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in cells]
        return pa.RecordBatch.from_arrays([*([pa.array([own], item_type)] if item else []), *cells], names=schema.names)

    def cut(own, parts, item_type, least):
        """Blocks of the rows that wait, as long as ``least`` are left; then the others."""
        part = pa.concat_batches(parts)
        while part.num_rows >= least:
            starts = part.column(1).offsets.to_numpy()
            n = min(rows, max(1, int(np.searchsorted(starts, starts[0] + BLOCK_WEIGHTS))))
            yield block(own, part.slice(0, n), item_type)
            part = part.slice(n)
        parts[:] = [part] if part.num_rows else []

    def pack(batches):
        waiting: dict = {}
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            item_type = batch.column(batch.num_columns - 1).type
            for own in pc.unique(batch.column(2)).to_pylist() if item else [None]:
                waiting.setdefault(own, []).append(batch.filter(pc.equal(batch.column(2), pa.scalar(own, item_type))) if item else batch)
            full = sum(x.num_rows for parts in waiting.values() for x in parts) > 8 * rows
            for own, parts in waiting.items():
                if parts and (full or sum(x.num_rows for x in parts) >= rows):
                    yield from cut(own, parts, item_type, 1 if full else rows)
        for own, parts in waiting.items():
            if parts:
                yield from cut(own, parts, item_type, 1)

    own = F.col(weights).cast(T.MapType(word, T.DoubleType())).alias(weights)
    kept = df.where(F.size(weights) > 0) if item is None else df.where((F.size(weights) > 0) & F.col(item).isNotNull())
    return kept.select(id_col, own, *([item] if item else [])).mapInArrow(pack, schema)


def _sparse_scores(asks: list, chunks: list) -> np.ndarray:
    """The inner products of two blocks (starts, words, at, weights); minus infinity where no word is common.

    The ``HEAVY`` words with the most products are multiplied as dense columns, the products of the others are added one by one."""
    (q_starts, q_words, q_at, q_w), (c_starts, c_words, c_at, c_w) = ([x[0].to_numpy(), x[1], *(y.to_numpy() for y in x[2:])] for x in (asks, chunks))
    nq, nc, n_words = len(q_starts) - 1, len(c_starts) - 1, len(q_words)
    at = pc.fill_null(pc.index_in(c_words, value_set=q_words), -1).to_numpy()[c_at]
    common = at >= 0
    q_row, c_row = np.repeat(np.arange(nq), np.diff(q_starts)), np.repeat(np.arange(nc), np.diff(c_starts))[common]
    at, c_own = at[common], c_w[common]
    by_word = np.bincount(q_at, minlength=n_words)
    first = np.concatenate([[0], np.cumsum(by_word)])
    work = by_word * np.bincount(at, minlength=n_words)
    heavy = np.argsort(-work, kind="stable")[:HEAVY]
    column = np.full(n_words, -1)
    column[heavy] = np.arange(len(heavy))
    order, rest = np.argsort(q_at, kind="stable"), np.nonzero(column[at] < 0)[0]
    n = by_word[at[rest]]
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + AT_ONCE, AT_ONCE)) if len(n) else []

    def summed(q_values, c_values):
        left, right = np.zeros((nq, len(heavy))), np.zeros((nc, len(heavy)))
        mine, theirs = column[q_at] >= 0, column[at] >= 0
        left[q_row[mine], column[q_at[mine]]] = q_values[mine]
        right[c_row[theirs], column[at[theirs]]] = c_values[theirs]
        total = left @ right.T
        for some in np.split(np.arange(len(rest)), cuts[1:] if len(cuts) else []):
            times, place = n[some], rest[some]
            entry = order[np.repeat(first[at[place]] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            where = q_row[entry] * nc + np.repeat(c_row[place], times)
            total += np.bincount(where, weights=q_values[entry] * np.repeat(c_values[place], times), minlength=nq * nc).reshape(nq, nc)
        return total

    scores = summed(q_w, c_own)
    if min(q_w.min(initial=1), c_own.min(initial=1)) > 0:
        return np.where(scores > 0, scores, -np.inf)
    return np.where(summed(np.ones_like(q_w), np.ones_like(c_own)) > 0.5, scores, -np.inf)


def _sparse_products(blocks: DataFrame, query_type, chunk_type, k: int) -> DataFrame:
    """(query_id, chunk_id, score), as ``_products``, of pairs of blocks of weight maps (ids, starts, words, at, weights; the same of the chunks)."""
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())])

    def multiply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cells = [batch.column(i)[r].values for i in range(10)]
                scores = _sparse_scores(cells[1:5], cells[6:])
                q, c = _likeliest(scores, cells[5], k)
                yield pa.RecordBatch.from_arrays([cells[0].take(pa.array(q)), cells[5].take(pa.array(c)), pa.array(scores[q, c])], names=schema.names)

    return blocks.mapInArrow(multiply, schema)


def sparse_topk(queries: DataFrame, table: DataFrame, k: int = 5, item: str | None = None) -> DataFrame:
    """Inner product of weight maps, exact; (chunk_id, item) is the key of the table. Chunks without a common token are no hits.

    Questions and chunks meet as blocks, as in ``dense_topk``: no row is made for a posting or a pair, and what is shuffled grows with the tables."""
    keys = [item] if item else []
    asked = weighted_tokens(queries, keys).groupBy("query_id", *keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "q_weight"))).alias("q_sparse"))
    names = ["ids", "starts", "words", "at", "weights"]
    columns = [*names, *[f"c_{x}" for x in names]]
    right = packed_maps(table, "chunk_id", "sparse", item, CHUNK_BLOCK).withColumnsRenamed({x: f"c_{x}" for x in names})
    if item:
        pairs = packed_maps(asked, "query_id", "q_sparse", item, QUESTION_BLOCK).join(right, item).select(*columns)
    else:
        blocks = max(1, -(-queries.count() // BROADCAST_QUESTIONS))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        each = [packed_maps(asked.where(block == b), "query_id", "q_sparse", None, QUESTION_BLOCK) for b in range(blocks)]
        pairs = functools.reduce(DataFrame.unionByName, [right.crossJoin(F.broadcast(q)).select(*columns) for q in each])
    found = _sparse_products(pairs, queries.schema["query_id"].dataType, table.schema["chunk_id"].dataType, k)
    scored = found.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return top_per(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def normalised(score: Column, metric: str | None) -> Column:
    """Scores brought into 0..1: cosine by (1 + s) / 2, inner product by 0.5 + atan(s) / pi; None leaves them."""
    if metric == "cosine":
        return (1 + score) / 2
    return 0.5 + F.atan(score) / F.lit(3.141592653589793) if metric == "ip" else score


def hybrid_fuse(dense_hits: DataFrame, sparse_hits: DataFrame, weights: tuple[float, float] = (0.5, 0.5), k: int = 5, norm: bool = True) -> DataFrame:
    """Weighted sum of both legs' scores over the union of their hits; an absent leg adds nothing."""
    part = lambda df, w, metric: df.select("query_id", "chunk_id", (F.lit(w) * normalised(F.col("score"), metric if norm else None)).alias("s"))
    both = part(dense_hits, weights[0], "cosine").unionByName(part(sparse_hits, weights[1], "ip"))
    fused = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), DIGITS).alias("score"))
    return top_per(fused, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def hybrid_search(queries: DataFrame, table: DataFrame, weights: tuple[float, float] = (0.5, 0.5), k: int = 5, item: str | None = "item_name", leg_k: int = 5) -> DataFrame:
    """Dense and sparse search fused; serves questions, hypothetical documents, item names and entities alike."""
    return hybrid_fuse(dense_topk(queries, table, leg_k, item), sparse_topk(queries, table, leg_k, item), weights, k)


def backfill_chunks(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Chunk columns for each hit, ids compared as text, hit order kept in ``rank``; missing chunks give nulls."""
    keyed = chunks.select(F.col("chunk_id").cast("string").alias("_key"), *columns)
    return hits.withColumn("_key", F.col("chunk_id").cast("string")).join(keyed, "_key", "left").drop("_key")


def valid_vectors(chunks: DataFrame, need_some: bool = False) -> DataFrame:
    """Chunks with both vectors non-empty; with ``need_some``, an import of chunks of which none is valid is an error."""
    valid = chunks.where((F.size("dense") > 0) & (F.size("sparse") > 0))
    if need_some and valid.isEmpty():
        raise ValueError("no chunk has both a dense and a sparse vector")
    return valid
