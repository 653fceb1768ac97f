"""Exact n-gram Jaccard join of documents with themselves.

A document is its set of distinct 5-word shingles. Equal sets form one class, and only one document of
a class goes on. Two sets of similarity 0.75 or more share a shingle among the first
n - ceil(0.75 n) + 1 of either under one order of all shingles, in which widespread ones come last; so
documents meet under the shingles of those prefixes. Of shingles under which the same documents meet
one is kept. Each document is first compared with the smallest of its size band that it meets most
often: such leaders and their partners form tiles of bounded size, where hashed bitmaps bound the
overlap from above and the sorted arrays of the pairs that remain are intersected. Shingles whose
documents these links leave in different components are gathered to groups by a min-hash of their
documents, and the groups are cut to tiles. First only bitmaps are compared, and a document goes on if
they leave it a partner in another component; then the sorted arrays of those are intersected in
the tile, the likeliest pairs first, where pairs that earlier links have joined need no answer. Tiles give
documents and spanning links, so that pairs are never rows, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, dealt, discard, mix, one_per_id, settled, shingle_sets, text_blocks

WORDS = 5
#: Text bytes that one pass holds at a time: some ten arrays of 8 bytes a text byte stand beside each other.
BLOCK = 256 << 10
#: A shingle that so many sets of one task's share hold is reported as widespread; the order of shingles needs no exact count.
WIDESPREAD_IN_TASK, WIDESPREAD = 2, 16
#: Widespread shingles that the order knows (8 bytes each, so 1.6 MB are broadcast); others count as rare, which costs time, not links.
KNOWN_WIDESPREAD = 200_000
TILE = 256  # partners of one leader in a tile
FLUSH = 2_000_000
PART = 4096  # documents of one shingle that go to one task
CELL = 2048  # documents of a group in a cell; two cells are compared in a tile
CELL_SHINGLES = 2 << 20  # and of so many shingles, 16 MB
WORDS_AT_ONCE = 1 << 21  # 64-bit words of bitmaps that one numpy step compares


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ salt), out=sums[1:])
        out.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, n, h1, h2, bits) of each document, bits being its bitmap; kind 1: a shingle h1 that n sets of a task hold."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0

        def widespread():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            v, c = v[c >= WIDESPREAD_IN_TASK], c[c >= WIDESPREAD_IN_TASK]
            zero = pa.array(np.zeros(len(v), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(v), np.int32)), zero, pa.array(c.astype(np.int64)), pa.array(v.view(np.int64)), zero, pa.nulls(len(v), pa.binary())], names=["kind", "doc_id", "n", "h1", "h2", "bits"])

        for batch in batches:
            for lo, hi, buf, offsets in text_blocks(batch, max_bytes=BLOCK):
                values, at = shingle_sets(buf, offsets, WORDS)
                h1, h2 = set_hashes(values, at)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([bitmap(values[at[i] : at[i + 1]]) for i in range(hi - lo)], pa.binary())], names=["kind", "doc_id", "n", "h1", "h2", "bits"])
                for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if key not in seen and n[i]:
                        seen.add(key)
                        held.append(values[at[i] : at[i + 1]])
                        size += int(n[i])
                if size >= FLUSH:
                    yield widespread()
                    held, size = [], 0
        if held:
            yield widespread()

    return docs.mapInArrow(run, "kind int, doc_id long, n long, h1 long, h2 long, bits binary")


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def prefixes(docs: DataFrame, widespread: np.ndarray, sets: np.ndarray) -> DataFrame:
    """(token, part, n, doc) of the prefix shingles of one document of each class of a task.

    The rows of a known widespread shingle are dealt to parts from 1 on, by the number of ``sets`` known to hold it; other shingles have part 0."""
    rank = np.argsort(widespread)
    shared = docs.sparkSession.sparkContext.broadcast((widespread[rank], rank + 1, np.maximum(1, sets[rank] // PART)))

    def run(batches):
        hot, place, parts = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in text_blocks(batch, max_bytes=BLOCK):
                values, at = shingle_sets(buf, offsets, WORDS)
                h1, h2 = set_hashes(values, at)
                fresh = np.zeros(hi - lo, bool)
                for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                n = np.diff(at)
                owner = np.repeat(np.arange(hi - lo), n)
                keep = fresh[owner]
                owner, values = owner[keep], values[keep]
                late, part = np.zeros(len(values), np.int64), np.zeros(len(values), np.int32)
                if len(hot) and len(values):
                    where = np.searchsorted(hot, values)
                    where[where == len(hot)] = 0
                    known = hot[where] == values
                    late = np.where(known, place[where], 0)
                    dealt = mix(ids[lo + owner].astype(np.uint64)) % parts[where].astype(np.uint64)
                    part = np.where(known, 1 + dealt.astype(np.int32), 0).astype(np.int32)
                order = np.lexsort((values, late, owner))
                owner, values, part = owner[order], values[order], part[order]
                first = np.searchsorted(owner, np.arange(hi - lo))
                take = np.arange(len(owner)) - first[owner] < prefix_length(n)[owner]
                owner, values, part = owner[take], values[take], part[take]
                for a in range(0, len(owner), 200_000):
                    b = slice(a, a + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(values[b].view(np.int64)), pa.array(part[b]), pa.array(n[owner[b]]), pa.array(ids[lo + owner[b]])], names=["token", "part", "n", "doc"])

    return docs.mapInArrow(run, "token long, part int, n long, doc long")


def shared_only(rows: DataFrame) -> DataFrame:
    """(token, n, doc) of ``prefixes`` whose shingle another row of the table has too, or that is known to be widespread."""

    def run(batches):
        last = None  # the last row: its shingle may go on; whether it has been given out
        for batch in batches:
            token, part, n, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            goes_on = last is not None and last[0] == token[0]
            keep = part > 0
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= goes_on
            out = [token[keep], n[keep], doc[keep]]
            if goes_on and not last[3]:
                out = [np.r_[last[k], x] for k, x in enumerate(out)]
            last = (token[-1], n[-1], doc[-1], bool(keep[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["token", "n", "doc"])

    return rows.repartition("token", "part").sortWithinPartitions("token").mapInArrow(run, "token long, n long, doc long")


def meetings(shared: DataFrame, member: DataFrame) -> DataFrame:
    """(token, n, doc, leader): the classes that meet under a shingle, of shingles with the same classes only one.

    Every row has a leader, the smallest of its size band in its part of at most about PART documents."""
    moved = member.where("doc_id <> rep").select(F.col("doc_id").alias("doc"), "rep")
    groups = settled(shared.join(moved, "doc", "left").select("token", "n", F.coalesce("rep", "doc").alias("doc")).distinct())
    of = groups.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit("class"), "doc")).alias("y"))
    kept = settled(of.where("size > 1").groupBy("size", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("size") / PART).alias("parts")))
    rows = groups.join(kept, "token").select("token", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), "n", "doc")

    def run(batches):
        key0 = lead0 = size0 = None  # part, leader and its size at the end of the last batch
        for batch in batches:
            token, part, n, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            leader, size = doc[lead], n[lead]
            if key0 == (token[0], part[0]):
                head = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(token)
                leader[:head], size[:head] = lead0, size0
            group = np.cumsum(new)
            while (far := 3 * n > 4 * size).any():  # too large for the leader: the first such row leads the next band
                at = np.flatnonzero(far)
                for s in at[np.r_[True, group[at][1:] != group[at][:-1]]]:
                    e = int(np.searchsorted(group, group[s], "right"))
                    leader[s:e], size[s:e] = doc[s], n[s]
            key0, lead0, size0 = (token[-1], part[-1]), leader[-1], size[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, n, doc, leader)], names=["token", "n", "doc", "leader"])

    met = settled(rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "doc").mapInArrow(run, "token long, n long, doc long, leader long"))
    discard(groups, kept)
    return met


def with_sets(rows: DataFrame, row_of, schema: pa.Schema) -> DataFrame:
    """A row ``row_of(doc_id, ask)`` with the document's sorted shingles for each ask of rows (doc_id, text, asks)."""

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(2)
            for lo, hi, buf, offsets in text_blocks(batch, max_bytes=BLOCK):
                values, at = shingle_sets(buf, offsets, WORDS)
                out, held = [], 0
                for i in range(hi - lo):
                    blob = values[at[i] : at[i + 1]].tobytes()
                    for a in asked[lo + i].as_py():
                        out.append((*row_of(int(ids[lo + i]), a), blob))
                        held += len(blob)
                        if held > 8 << 20:
                            yield as_batch(out)
                            out, held = [], 0
                if out:
                    yield as_batch(out)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return rows.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (doc, leader) that link, decided in tiles of one leader and at most about TILE partners."""
    count = pairs.groupBy("leader").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = pairs.join(count, "leader").select("doc", "leader", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int").alias("tile"))
    asks = placed.select(F.col("doc").alias("doc_id"), F.struct("leader", "tile", F.lit(1).alias("role")).alias("ask"))
    leads = placed.select("leader", "tile").distinct().select(F.col("leader").alias("doc_id"), F.struct("leader", "tile", F.lit(0).alias("role")).alias("ask"))
    wanted = asks.unionByName(leads).groupBy("doc_id").agg(F.collect_list("ask").alias("asks"))

    schema = pa.schema([("leader", pa.int64()), ("tile", pa.int32()), ("role", pa.int32()), ("doc", pa.int64()), ("shingles", pa.binary())])
    rows = docs.join(wanted, "doc_id").select("doc_id", "text", "asks")
    rows = with_sets(rows, lambda doc, a: (a["leader"], a["tile"], a["role"], doc), schema)
    tiles = rows.repartition("leader", "tile").sortWithinPartitions("leader", "tile", "role")

    def decide(batches):
        key = lead = None
        for batch in batches:
            leader, tile, role, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            blobs = batch.column(4)
            edge = np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (tile[1:] != tile[:-1]) | (role[1:] != role[:-1])])
            for a, b in zip(edge, np.r_[edge[1:], len(leader)], strict=True):
                if role[a] == 0:
                    key, lead = (leader[a], tile[a]), np.frombuffer(blobs[a].as_py(), np.uint64)
                    continue
                assert key == (leader[a], tile[a])
                for s in range(a, b, 64):
                    e = min(b, s + 64)
                    ok = linked(lead, [np.frombuffer(blobs[i].as_py(), np.uint64) for i in range(s, e)])
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(doc[s:e][ok]), pa.array(leader[s:e][ok])], names=["a", "b"])

    return tiles.mapInArrow(decide, "a long, b long")


def bitmap(values: np.ndarray, times: int = 2) -> bytes:
    """Hashed bitmap of a set: the least power of two of bits that is ``times`` its size, alike for sets of a size band."""
    bits = max(64, 1 << int(times * len(values) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(values % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether the bitmaps leave room for 100 * intersection >= 75 * union."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # halves laid over each other are the smaller bitmap
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    # each bit of one side only is an element the other lacks
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 100 * most >= 75 * (n + m - most)


def bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (doc, leader) that their bitmaps (doc_id, n, bits) don't rule out."""

    def run(batches):
        for batch in batches:
            _, _, n, a, m, b = (batch.column(i).to_pylist() for i in range(6))
            ok = pa.array([may_link(*row) for row in zip(n, a, m, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc", "leader"]).filter(ok)

    side = lambda key, n, name: bits.select(F.col("doc_id").alias(key), F.col("n").alias(n), F.col("bits").alias(name))
    rows = pairs.join(side("doc", "n", "a"), "doc").join(side("leader", "m", "b"), "leader")
    return rows.select("doc", "leader", "n", "a", "m", "b").mapInArrow(run, "doc long, leader long")


def linked(lead: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sets have 100 * intersection >= 75 * union with ``lead``; all sets sorted."""
    ok = np.zeros(len(others), bool)
    for i, other in enumerate(others):
        at = np.searchsorted(lead, other)
        at[at == len(lead)] = 0
        both = int((lead[at] == other).sum())
        ok[i] = 100 * both >= 75 * (len(lead) + len(other) - both)
    return ok


TILE_KEY = ["grp", "i", "j"]


def open_tiles(met: DataFrame, component: DataFrame) -> DataFrame:
    """(grp, i, j, cell, doc, component): the documents under shingles with more than one component, dealt to tiles.

    Shingles with the same document of least hash form one group, as most shingles of near copies do. Documents of a
    group's largest component need not be compared with each other: in a group of more than one cell they meet only
    the cells of the others, which meet each other as well."""
    rows = met.select("token", "doc", "n").join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    of = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64(F.lit("grp"), "doc"), "doc"))["doc"].alias("grp"))
    of = settled(of.where("lo <> hi").select("token", "grp"))
    rows = settled(rows.join(of, "token").select("grp", "doc", "n", "component").distinct())
    cells = lambda c, n: F.ceil(F.greatest(c / F.lit(CELL), n / F.lit(CELL_SHINGLES))).cast("int")
    each = rows.groupBy("grp", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    groups = each.groupBy("grp").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.max(F.struct("c", "component", "n")).alias("main"))
    one = cells(F.col("c"), F.col("n")) == 1
    rest = F.greatest(cells(F.col("c") - F.col("main.c"), F.col("n") - F.col("main.n")), F.lit(1))
    groups = settled(groups.select("grp", F.when(~one, F.col("main.component")).alias("main"), F.when(one, 0).otherwise(cells(F.col("main.c"), F.col("main.n"))).alias("k"), F.when(one, 1).otherwise(rest).alias("l")))
    is_main = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    rows = rows.join(groups, "grp").withColumn("cell", F.when(is_main, F.pmod(F.xxhash64("doc"), F.greatest("k", F.lit(1)))).otherwise(F.col("k") + F.pmod(F.xxhash64("doc"), "l")).cast("int"))
    others = F.sequence("k", F.col("k") + F.col("l") - 1)
    to_main = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    pair = lambda x: F.struct(F.least("cell", x).alias("i"), F.greatest("cell", x).alias("j"))
    rows = rows.withColumn("at", F.explode(F.transform(F.when(is_main, others).otherwise(F.concat(to_main, others)), pair)))
    return rows.select("grp", "at.i", "at.j", "cell", "doc", "component")


def by_tile(rows: DataFrame, decide, schema: str) -> DataFrame:
    """``decide`` (one tile's rows as a table -> table) for every tile of rows (grp, i, j, ...)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(3)):
                yield from decide(pa.Table.from_batches(held)).to_batches()
                held = []
            cuts = [0, *edge.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield from decide(pa.Table.from_batches(held)).to_batches()
                    held = []
        if held:
            yield from decide(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY).mapInArrow(run, schema)


def possible(n: np.ndarray, component: np.ndarray, cell: np.ndarray | None, maps: list[np.ndarray]):
    """Pairs of rows of one tile that may link, as (row, row, largest similarity the bitmaps allow), a bounded number of words at a time.

    The rows lie in other components and, if ``cell`` is given, in other cells; those of the largest component are not compared with each other."""
    names, inverse, size = np.unique(component, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    few, width = inverse != size.argmax(), np.array([len(m) for m in maps])
    for w in np.unique(width):
        # sets that may link differ by a third at most in size, so by one doubling at most in width
        rows, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        base = np.stack([maps[r] for r in rows])
        cols = np.r_[rows, wide].astype(np.int64)
        against = np.concatenate([base, np.stack([maps[r][:w] | maps[r][w:] for r in wide])]) if len(wide) else base
        for some_rows, some_cols in ((few[rows], np.ones(len(cols), bool)), (~few[rows], few[cols])):
            r_at, c_at = np.flatnonzero(some_rows), np.flatnonzero(some_cols)
            step = max(1, WORDS_AT_ONCE // max(1, len(c_at) * int(w)))
            for a in range(0, len(r_at) if len(c_at) else 0, step):
                x, y = base[r_at[a : a + step], None, :], against[c_at][None]
                r, c = rows[r_at[a : a + step]], cols[c_at]
                both = n[r][:, None] + n[c][None, :]
                room = np.minimum(n[r][:, None] - np.bitwise_count(x & ~y).sum(2, dtype=np.int64), n[c][None, :] - np.bitwise_count(~x & y).sum(2, dtype=np.int64))
                ok = (100 * room >= 75 * (both - room)) & (component[r][:, None] != component[c][None, :])
                if cell is not None:
                    ok &= cell[r][:, None] != cell[c][None, :]
                at = np.nonzero(ok)
                yield r[at[0]], c[at[1]], room[at] / (both - room)[at]


def has_partner(tile: pa.Table) -> pa.Table:
    """The rows of a tile (grp, i, j, cell, doc, component, n, bits) that may link with another, by bitmaps alone."""
    maps = [np.frombuffer(x, np.uint64) for x in tile.column("bits").to_pylist()]
    cell, component, n = (tile.column(c).to_numpy() for c in ("cell", "component", "n"))
    some = np.zeros(len(n), bool)
    for r, c, _ in possible(n, component, cell if tile.column("i")[0].as_py() != tile.column("j")[0].as_py() else None, maps):
        some[r] = some[c] = True
    return tile.select([*TILE_KEY, "cell", "doc", "component"]).filter(pa.array(some))


def spanning_links(tile: pa.Table) -> pa.Table:
    """Links (a, b) between the components of a tile (grp, i, j, cell, doc, component, shingles), enough to join all that its pairs link."""
    sets = [np.frombuffer(x, np.uint64) for x in tile.column("shingles").to_pylist()]
    cell, component, doc = (tile.column(c).to_numpy() for c in ("cell", "component", "doc"))
    n = np.array([len(x) for x in sets])
    top = {c: c for c in component.tolist()}

    def root(c):
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    found = []
    maps = [np.frombuffer(bitmap(x, 16), np.uint64) for x in sets]
    for r, c, likely in possible(n, component, cell if tile.column("i")[0].as_py() != tile.column("j")[0].as_py() else None, maps):
        for k in np.argsort(-likely, kind="stable"):
            x, y = root(int(component[r[k]])), root(int(component[c[k]]))
            if x != y and linked(sets[r[k]], [sets[c[k]]])[0]:
                top[x] = y
                found.append((doc[r[k]], doc[c[k]]))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def apart(met: DataFrame, component: DataFrame, bits: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between documents that meet under a shingle and lie in different components, enough to join all that link."""
    rows = open_tiles(met, component).join(bits.withColumnRenamed("doc_id", "doc"), "doc").select(*TILE_KEY, "cell", "doc", "component", "n", "bits")
    left = settled(by_tile(rows, has_partner, "grp long, i int, j int, cell int, doc long, component long"))
    asks = left.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct(*TILE_KEY, "cell", "component")).alias("asks"))
    schema = pa.schema([("grp", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("cell", pa.int32()), ("doc", pa.int64()), ("component", pa.int64()), ("shingles", pa.binary())])
    rows = texts.join(asks, "doc_id").select("doc_id", "text", "asks")
    rows = with_sets(rows, lambda doc, a: (a["grp"], a["i"], a["j"], a["cell"], doc, a["component"]), schema)
    return by_tile(rows, spanning_links, "a long, b long")


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links (itself included). Null and blank texts have no shingles and link
    with nothing; rows with a null doc_id are left out and of repeated ids one row stays; texts are read whole; equal
    sets always link; an empty table gives no rows; extra columns are ignored."""
    rows = one_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = settled(signatures(rows))
    sigs = found.where("kind = 0").select("doc_id", "n", "h1", "h2")
    # a table of its own, so that the join with it can be split at a class of very many documents; blank texts are no class
    classes = settled(sigs.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"))
    alone = sigs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))
    member = settled(sigs.where("n > 0").join(classes, ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")).unionByName(alone))
    often = found.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") >= WIDESPREAD)
    often = often.orderBy(F.desc("n"), "h1").limit(KNOWN_WIDESPREAD).toArrow()
    hot, sets = (often.column(c).to_numpy()[::-1] for c in ("h1", "n"))  # rarest first
    shared = settled(shared_only(prefixes(rows, np.ascontiguousarray(hot).view(np.uint64), sets)))
    met = meetings(shared, member)
    discard(shared, classes)
    meeting = met.select(F.col("doc").alias("doc_id")).distinct()
    # the pairs to verify are brought to the texts, which stay where they are
    texts = settled(dealt(rows, "doc_id").join(found.where("kind = 0").select("doc_id", "n", "bits"), "doc_id").join(meeting, "doc_id", "left_semi"), by="doc_id")
    discard(found)
    bits, texts = texts.select("doc_id", "n", "bits"), texts.select("doc_id", "text")
    # each document with the leader it meets most
    leads = met.where("doc <> leader").groupBy("doc", "leader").agg(F.count("*").alias("c"))
    leads = leads.groupBy("doc").agg(F.max(F.struct("c", (-F.col("leader")).alias("neg"))).alias("m")).select("doc", (-F.col("m.neg")).alias("leader"))
    pairs = settled(bounded(leads, bits))
    links = [settled(verified(texts, pairs))]
    component = connected_components(links[0])
    links.append(settled(apart(met, component, bits, texts)))
    if not links[1].isEmpty():
        component = connected_components(links[0].unionByName(links[1]))
    discard(met, texts, pairs, *links)
    out = member.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
