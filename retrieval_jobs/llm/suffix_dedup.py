"""Exact removal of repeated 100-byte strings by column-wise collection suffix sorting.

Every window of ``WINDOW`` bytes is assigned to its anchor, the ``CORE``-byte string of least hash in it, so
equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a block
of at most 176 bytes. The blocks of an anchor are a collection of short documents aligned at the anchor; many
copies of blocks are dealt to parts, each with the first occurrence of every distinct block, before which
nothing of the anchor starts. Its suffixes are
sorted column by column: each round inserts the symbol of every block in front of its suffix,
distributes the order of the round before by that symbol (the column of the Burrows-Wheeler transform)
and renews the common prefixes of neighbours from range minima. Runs of common prefix 100 or more are
equal windows; all but the first in the corpus are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_span_hashes, discard, mix, one_per_id, prefix_sums, settled, span_hashes, text_blocks

WINDOW, CORE = 100, 24
SPAN = WINDOW - CORE + 1  # places of the anchor in a window
#: An anchor with more distinct blocks than this is hot: its blocks are dealt out anew under longer strings.
HOT = 512
STEP = 19  # windows of a piece of a hot block; they share a string of WINDOW - STEP + 1 bytes
COPIES = 4096  # later occurrences of blocks under one anchor that one collection takes, beside the first ones
COLLECTION = 20_000  # blocks that one sort takes, whole anchors at a time


def anchored_blocks(sums: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: document, first window, windows, anchor (all places in the text), by the ``prefix_sums`` of the text."""
    begin, end = offsets[:-1], offsets[1:] - (WINDOW - 1)  # the first window of a document, and after its last
    begin, end = begin[end > begin], end[end > begin]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 4
    low = all_span_hashes(sums, CORE)
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(low), dtype=np.uint64)  # equal hashes: the leftmost place
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    new = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[begin] = True
    step = np.zeros(len(low) + 1, np.int8)
    step[begin] = 1
    step[end] -= 1  # the windows from here on cross documents
    first = np.flatnonzero(new & np.cumsum(step[:-1], dtype=np.int8).view(bool))
    doc = np.searchsorted(offsets, first, "right") - 1
    # windows in the run: up to the next run, or the last of the document
    count = np.minimum(np.r_[first[1:], len(low)], offsets[doc + 1] - (WINDOW - 1)) - first
    return doc, first, count, (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Unions of overlapping or touching ranges, in order of document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.r_[0, np.cumsum(doc[1:] != doc[:-1])] * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def occurrences(docs: DataFrame) -> DataFrame:
    """(anchor hash, block hash, doc_id, start, windows, place of the anchor) of every block."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, offsets in text_blocks(batch):
                sums = prefix_sums(buf, lower=False)
                doc, first, count, anchor = anchored_blocks(sums, offsets)
                if not len(doc):
                    continue
                key = span_hashes(buf, anchor, anchor + CORE, sums=sums)
                block = span_hashes(buf, first, first + count + WINDOW - 1, sums=sums)
                cols = [key.view(np.int64), block.view(np.int64), ids[lo + doc], first - offsets[doc], count, anchor - first]
                for a in range(0, len(doc), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in cols], names=["key", "block", "doc_id", "start", "n", "at"])

    return docs.mapInArrow(run, "key long, block long, doc_id long, start long, n long, at long")


def first_and_rest(occ: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first occurrence of each block, and the ranges of all later ones.

    Counts and first places are pre-aggregated; later occurrences learn them by a join that Spark can split at a hot block."""
    first = F.min(F.struct("doc_id", "start", "n", *carry)).alias("f")
    firsts = settled(occ.groupBy("key", "block").agg(first, F.count("*").alias("c")).select("key", "block", "f.*", "c"))
    many = firsts.where("c > 1").select("key", "block", F.col("doc_id").alias("d0"), F.col("start").alias("s0"))
    rest = occ.select("key", "block", "doc_id", "start", "n").join(many, ["key", "block"]).where("doc_id <> d0 or start <> s0")
    return firsts.drop("c"), rest.select("doc_id", "start", (F.col("start") + F.col("n") + (WINDOW - 1)).alias("end"))


def with_group_size(firsts: DataFrame) -> DataFrame:
    """Blocks whose anchor has others, with ``hot``."""
    size = settled(firsts.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"))
    return firsts.join(size, "key").withColumn("hot", F.col("g") > HOT).drop("g")


def dealt_copies(occ: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks to sort (key, part, doc_id, start, n, at, hot), ranges of later occurrences under hot anchors, and the table of first occurrences.

    Under an anchor that is not hot all occurrences are sorted: the first of each distinct block goes to every part, a later one to one part."""
    first = F.min(F.struct("doc_id", "start", "n", "at")).alias("f")
    firsts = settled(occ.groupBy("key", "block").agg(first, F.count("*").alias("c")).select("key", "block", "f.*", "c"))
    size = firsts.groupBy("key").agg(F.count("*").alias("g"), F.sum("c").alias("c")).where("c > 1")
    size = settled(size.select("key", (F.col("g") > 1).alias("others"), (F.col("g") > HOT).alias("hot"), F.ceil((F.col("c") - F.col("g")) / COPIES).alias("parts")))
    many = firsts.where("c > 1").select("key", "block", F.col("doc_id").alias("d0"), F.col("start").alias("s0")).join(size, "key")
    later = occ.join(many, ["key", "block"]).where("doc_id <> d0 or start <> s0")
    rest = later.where("hot").select("doc_id", "start", (F.col("start") + F.col("n") + (WINDOW - 1)).alias("end"))
    parts = F.when(F.col("hot"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1))
    one = firsts.join(size, "key").where("not hot or others").select("key", F.explode(parts).alias("part"), "doc_id", "start", "n", "at", "hot")
    copies = later.where("not hot").select("key", F.pmod(F.xxhash64("doc_id", "start"), "parts").alias("part"), "doc_id", "start", "n", "at", "hot")
    return one.unionByName(copies), rest, firsts


PIECES = "level int, key long, part long, block long, doc_id long, start long, n long, at long, bytes binary"


def block_bytes(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """Level 1: the asked blocks with their bytes; level 2: pieces of hot blocks, under their common strings."""
    asked = asks.groupBy("doc_id").agg(F.collect_list(F.struct("key", "part", "start", "n", "at", "hot")).alias("asks"))

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for lo, hi, buf, offsets in text_blocks(batch):
                own = column.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), pc.list_value_length(own).to_numpy())
                key, part, start, n, at, hot = (c.to_numpy(zero_copy_only=False) for c in own.flatten().flatten())
                base, doc, data = offsets[row], ids[lo + row], buf.tobytes()
                one = np.flatnonzero(~hot)
                yield from piece_batches(data, base[one], 1, key[one], part[one], 0, doc[one], start[one], n[one], at[one])
                if not hot.any():
                    continue
                sums = prefix_sums(buf, lower=False)
                # windows whose anchor lies STEP * q to STEP * q + STEP - 1 bytes inside them
                for q in range(-(-SPAN // STEP)):
                    core = start + at - STEP * q
                    s, e = np.maximum(start, core - STEP + 1), np.minimum(start + n - 1, core)
                    two = np.flatnonzero(hot & (s <= e))
                    b, s, e, core = base[two], s[two], e[two], core[two]
                    # keys are hashes of the common strings, told apart by q
                    common = mix(span_hashes(buf, b + core, b + core + WINDOW - STEP + 1, sums=sums) + np.uint64(q)).view(np.int64)
                    block = span_hashes(buf, b + s, b + e + WINDOW, sums=sums).view(np.int64)
                    yield from piece_batches(data, b, 2, common, 0, block, doc[two], s, e - s + 1, core - s)

    return docs.join(asked, "doc_id").select("doc_id", "text", "asks").mapInArrow(run, PIECES)


def piece_batches(data: bytes, base: np.ndarray, level: int, key, part, block, doc, start, n, at):
    """Rows of ``PIECES``, some at a time; ``base`` is where their documents begin in ``data``."""
    begin = base + start
    columns = [np.broadcast_to(np.asarray(c, np.int64), len(base)) for c in (key, part, block, doc, start, n, at)]
    for a in range(0, len(base), 20_000):
        cut = [pa.array(c[a : a + 20_000]) for c in columns]
        ends = begin[a : a + 20_000] + n[a : a + 20_000] + (WINDOW - 1)
        pieces = [data[x:y] for x, y in zip(begin[a : a + 20_000].tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pieces), level, np.int32)), *cut, pa.array(pieces, pa.binary())], names=["level", "key", "part", "block", "doc_id", "start", "n", "at", "bytes"])


def single_windows(pieces: DataFrame) -> DataFrame:
    """Each window of pieces as a block of its own, under two hashes of its bytes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, start, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            data = batch.column(3).to_pylist()
            size = np.array([len(x) for x in data])
            begin = np.cumsum(size) - size
            buf = np.frombuffer(b"".join(data), np.uint8)
            row = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[row] + off
            key, block = span_hashes(buf, at, at + WINDOW, lower=False), span_hashes(buf[::-1], len(buf) - at - WINDOW, len(buf) - at, lower=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(block.view(np.int64)), pa.array(doc[row]), pa.array(start[row] + off), pa.array(np.ones(len(row), np.int64))], names=["key", "block", "doc_id", "start", "n"])

    return pieces.select("doc_id", "start", "n", "bytes").mapInArrow(run, "key long, block long, doc_id long, start long, n long")


def range_minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a..b]) for each pair with a <= b, by doubling."""
    span = b - a + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(len(a), values.dtype)
    table, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table, width = np.minimum(table[: len(table) - width], table[width:]), width * 2
        sel = np.flatnonzero(level == k)
        out[sel] = np.minimum(table[a[sel]], table[b[sel] - width + 1])
    return out


def repeated_windows(doc: np.ndarray, start: np.ndarray, at: np.ndarray, data: list[bytes], anchor: np.ndarray):
    """Ranges (doc, start, end) of windows of the blocks that occur in an earlier block of their anchor (numbered in order from 0).

    Blocks are aligned at their anchors, so equal windows start in the same column; the columns are
    inserted from the last to the first. An anchor keeps its places in the order, so that a column moves
    and compares only suffixes of one anchor."""
    m, left = len(doc), int(at.max())
    size = np.fromiter(map(len, data), np.int64, m)
    columns, lead, pad = left + int((size - at).max()), left - at, 256
    text = b"".join([x.rjust(n).ljust(columns) for x, n in zip(data, (lead + size).tolist(), strict=True)])
    symbols = np.ascontiguousarray(np.frombuffer(text, np.uint8).reshape(m, columns).T).astype(np.int32)
    column = np.arange(columns)[:, None]
    symbols[(column < lead) | (column >= lead + size)] = pad
    symbols += (anchor * (2 * pad)).astype(np.int32)
    place = start + at
    # a first occurrence may be here once for each part of its anchor: equal places have equal ranks
    by = np.lexsort((place, doc))
    rank = np.empty(m, np.int64)
    rank[by] = np.cumsum(np.r_[0, (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])])
    order, common = np.arange(m), np.zeros(m, np.int16)
    late = np.zeros((columns - WINDOW + 2, m), bool)
    for c in range(columns - 1, -1, -1):
        sym, fresh = symbols[c][order], np.zeros(m, np.int16)
        if (sym[1:] < sym[:-1]).any():
            move = np.argsort(sym, kind="stable")
            sym, order = sym[move], order[move]
            same = (sym[1:] == sym[:-1]) & (sym[1:] & pad == 0)
            near = common[move[1:]]
            far = np.flatnonzero(same & (move[1:] != move[:-1] + 1))  # no neighbours before
            near[far] = range_minima(common, move[far] + 1, move[far + 1])
        else:
            same, near = (sym[1:] == sym[:-1]) & (sym[1:] & pad == 0), common[1:]
        np.multiply(np.minimum(near, WINDOW - 1) + 1, same, out=fresh[1:])
        common = fresh
        if c <= columns - WINDOW:
            again = fresh >= WINDOW
            at_run = again.copy()
            at_run[:-1] |= again[1:]
            runs = np.flatnonzero(at_run)
            if len(runs):
                first, who = np.flatnonzero(~again[runs]), order[runs]
                r = rank[who]
                late[c][who] = r > np.repeat(np.minimum.reduceat(r, first), np.diff(np.r_[first, len(r)]))
    edge = np.diff(np.ascontiguousarray(late.T).view(np.int8), axis=1, prepend=0)
    r0, c0 = np.nonzero(edge == 1)
    _, c1 = np.nonzero(edge == -1)
    return doc[r0], place[r0] + c0 - left, place[r0] + c1 - left + WINDOW - 1


def sorted_collections(pieces: DataFrame) -> DataFrame:
    """Ranges found by suffix sorting, anchors whole in a task and a bounded number of blocks at a time."""

    def settle(keys, rows):
        if len(keys) < 2:
            return None
        doc, start, at = (np.concatenate([r[i] for r in rows]) for i in range(3))
        anchor = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
        d, s, e = merged(*repeated_windows(doc, start, at, [x for r in rows for x in r[3]], anchor))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc_id", "start", "end"])

    def run(batches):
        keys, rows = np.zeros(0, np.int64), []
        for batch in batches:
            key, doc, start, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            data, a = batch.column(4).to_pylist(), 0
            while a < len(key):
                b = min(len(key), a + COLLECTION)
                keys = np.r_[keys, key[a:b]]
                rows.append((doc[a:b], start[a:b], at[a:b], data[a:b]))
                a = b
                if len(keys) >= COLLECTION:
                    cut = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on
                    if cut:
                        joined = tuple(np.concatenate([r[i] for r in rows]) for i in range(3)) + ([x for r in rows for x in r[3]],)
                        out = settle(keys[:cut], [tuple(x[:cut] for x in joined)])
                        if out is not None:
                            yield out
                        keys, rows = keys[cut:], [tuple(x[cut:] for x in joined)]
        out = settle(keys, rows)
        if out is not None:
            yield out

    rows = pieces.select(F.xxhash64("key", "part").alias("key"), "doc_id", "start", "at", "bytes").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "doc_id long, start long, end long")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(doc_id, start, end) of bytes of docs (doc_id, text) inside a window that also starts earlier; ranges may overlap."""
    occ = occurrences(rows)
    shared = settled(occ.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    both = settled(occ.join(shared, "key"))
    blocks, rest, firsts = dealt_copies(both)
    pieces = settled(block_bytes(rows, blocks))
    firsts2, rest2 = first_and_rest(pieces.where("level = 2"), ["at", "bytes"])
    again = settled(with_group_size(firsts2))
    windows = settled(single_windows(again.where("hot")))
    firsts3, rest3 = first_and_rest(windows, [])
    cold = pieces.where("level = 1").select("key", "part", "doc_id", "start", "at", "bytes").unionByName(again.where("not hot").select("key", F.lit(0).cast("long").alias("part"), "doc_id", "start", "at", "bytes"))
    found = sorted_collections(cold)
    out = settled(rest.unionByName(rest2).unionByName(rest3).unionByName(found))
    discard(shared, both, firsts, pieces, firsts2, again, windows, firsts3)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove each byte covered by a 100-byte string that also starts earlier (smaller doc_id, or same text, earlier start).

    Returns doc_id, kept binary (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs). Null text
    counts as empty; texts shorter than 100 bytes lose nothing; strings never cross documents; rows with a null
    doc_id are left out and of repeated ids one row stays; an empty table gives no rows; extra columns are ignored."""
    rows = one_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    ranges = repeated_ranges(rows).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            out = []
            for lo, hi, buf, offsets in text_blocks(batch):
                for i in range(lo, hi):
                    text = buf[offsets[i - lo] : offsets[i - lo + 1]]
                    if not column[i].is_valid:
                        out.append((text.tobytes(), len(text), 0, 0))
                        continue
                    r = column[i].values
                    s, e = r.field(0).to_numpy(), r.field(1).to_numpy()
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                    gone = np.zeros(len(text) + 1, np.int8)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, e, -1)
                    out.append((text[np.cumsum(gone[:-1]) == 0].tobytes(), len(text), int((e - s).sum()), len(s)))
            if out:
                kept, size, removed, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
