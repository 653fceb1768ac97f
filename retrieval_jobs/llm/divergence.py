"""Divergence of the sources of each language, by chunk factorization.

White-space chunks are counted per document, each globally distinct chunk is cut into its terms once, and the terms are joined back to the counts of their
chunks. The documents of a term lie between the most of any of its chunks and the sum over them, as two chunks of one document may hold the same term. That
settles all terms but those whose chunks all stand below the threshold while their sum does not. A second scan counts the occurrences of the chunks of all
terms that may be kept, by source, and names the documents of those open chunks, which are counted once each. Nothing is estimated.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, dealt, discard, has_bits, mix, packed_bits, settled, span_hashes, text_blocks, unpacked_bits, words_of

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: What a term is; only A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct chunks of a language, and chunks of all groups, that a task holds before it hands their counts on.
HELD, WORDS_HELD = 500_000, 8_000_000
#: Sources of a tile of the pair matrix, and terms of a group that fills tiles.
TILE, GROUP_TERMS = 256, 4096
#: Bits of the filters by which chunks are looked for in documents; chunks they let through are joined exactly.
FILTER_BITS = 1 << 26

_DOCS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("lang", "chunk")], *[T.StructField(c, T.LongType()) for c in ("key", "docs")]])
_USES = T.StructType([T.StructField(c, T.LongType()) for c in ("group", "key", "doc", "n")])


def _seeds(langs: list[str], salt: int) -> np.ndarray:
    of = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=bytes([salt])).digest(), "little") for x in set(langs)}
    return np.array([of[x] for x in langs], np.uint64)


def chunk_documents(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(lang, chunk, key, docs): the documents that hold each chunk, dealt by chunk; the key is a hash of both."""

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def flush(lang):
            chunks = held.pop(lang)
            sizes = np.cumsum([0, *map(len, chunks)])
            buf = np.frombuffer(b"".join(chunks), np.uint8)
            keys = mix(span_hashes(buf, sizes[:-1], sizes[1:], lower=False) ^ _seeds([lang], salt))
            text = pa.array(list(chunks), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(chunks), pa.string()), text, pa.array(keys.view(np.int64)), pa.array(list(chunks.values()), pa.int64())], names=_DOCS.names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                own = held[lang]
                own.update(set(text.as_py().split()))
                if len(own) >= HELD:
                    yield from flush(lang)
        for lang in [x for x, own in held.items() if own]:
            yield from flush(lang)

    found = docs.select("lang", "text").mapInArrow(count, _DOCS)
    return dealt(found, "chunk").groupBy("lang", "chunk", "key").agg(F.sum("docs").alias("docs"))


def term_chunks(counts: DataFrame) -> DataFrame:
    """(lang, term, key, times, docs): each distinct chunk cut once, its terms joined to its counts in every language (times: how often it holds the term)."""
    lower = F.translate("chunk", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = counts.groupBy("chunk").agg(F.collect_list(F.struct("lang", "key", "docs")).alias("langs"))
    once = once.select("langs", F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    times = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).cast("long").alias("times")))
    single = F.array(F.struct(F.get("terms", F.lit(0)).alias("term"), F.lit(1).cast("long").alias("times")))
    once = once.select("langs", F.inline(F.when(F.size("terms") == 1, single).otherwise(times)))
    return once.select("term", "times", F.inline("langs")).select("lang", "term", "key", "times", "docs")


def chunk_uses(docs: DataFrame, asked: DataFrame, salt: int = 0) -> DataFrame:
    """(group, key, doc, n) of the chunks in ``asked`` (key, open), and of others that the filters take for them.

    With doc -1: the occurrences of a chunk in a group. With another doc: that document holds an open chunk."""
    bits = docs.sparkSession.sparkContext.broadcast(packed_bits(bitmap(asked.select("key"), FILTER_BITS), bitmap(asked.where("open").select("key"), FILTER_BITS)))

    def count(batches):
        some, open_ = unpacked_bits(bits.value)
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        size = 0

        def rows(group, key, doc, n):
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(key)).astype(np.int64)) for x in (group, key, doc, n)], names=_USES.names)

        def flush():
            for group in list(held):
                key, n = np.unique(np.concatenate(held.pop(group)), return_counts=True)
                yield rows(group, key, -1, n)

        for batch in batches:
            seeds = _seeds(batch.column(0).to_pylist(), salt)
            groups, ids = (batch.column(i).to_numpy() for i in (1, 2))
            for lo, hi, buf, offsets in text_blocks(batch, "text"):
                starts, ends, doc = words_of(buf, offsets)
                key = mix(span_hashes(buf, starts, ends, lower=False) ^ seeds[lo:hi][doc]).view(np.int64)
                asks = has_bits(some, key)
                key, doc = key[asks], doc[asks]
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    held[groups[lo + i]].append(key[cuts[i] : cuts[i + 1]])
                size += len(key)
                found = np.flatnonzero(has_bits(open_, key))
                if len(found):
                    yield rows(groups[lo + doc[found]], key[found], ids[lo + doc[found]], 0)
                if size >= WORDS_HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "group", F.monotonically_increasing_id().alias("doc"), "text").mapInArrow(count, _USES)


def term_uses(docs: DataFrame, min_docs: int = MIN_DOCS, salt: int = 0) -> DataFrame:
    """(lang, group, term, count) of the terms that at least ``min_docs`` documents of the language hold; ``docs`` names the group of each row.

    Chunks are told apart by 64-bit keys, which is exact as no two distinct chunks of a language share one: else other keys are taken."""
    counts = settled(chunk_documents(docs, salt), by="chunk")
    if not counts.groupBy("key").count().where("count > 1").isEmpty():
        discard(counts)
        return term_uses(docs, min_docs, salt + 1)
    spread = settled(term_chunks(counts))
    bounds = spread.groupBy("lang", "term").agg(F.max("docs").alias("least"), F.sum("docs").alias("most")).where(F.col("most") >= min_docs)
    bounds = settled(bounds.select("lang", "term", (F.col("least") < min_docs).alias("open")))
    asked = spread.join(bounds, ["lang", "term"]).select("lang", "key", "term", "times", "open")
    asked = settled(dealt(asked, "key"), by="key")
    discard(counts, spread)
    uses = dealt(chunk_uses(docs, asked, salt), "key").join(asked.hint("shuffle_hash"), "key")
    uses = uses.where("doc < 0 or open").groupBy("lang", "group", "term", "doc").agg(F.sum(F.col("n") * F.col("times")).alias("count"))
    uses = settled(uses)
    found = uses.where("doc >= 0").groupBy("lang", "term").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    kept = bounds.where("not open").select("lang", "term").unionByName(found)
    out = settled(uses.where("doc < 0").join(kept, ["lang", "term"], "left_semi").select("lang", "group", "term", "count"))
    discard(bounds, asked, uses)
    return out


def _share(count, total, terms):
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exactly."""
    part = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    return F.call_function("div", part, (total + SMOOTHING * terms).cast("decimal(20,0)")) + 1


def _grouped(rows: DataFrame, salt: int) -> DataFrame:
    return rows.withColumn("group", F.xxhash64(F.lit(salt), "lang", "source"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language how far each other one is (``pair``), and its most over-used terms (``term``).

    Null text, lang and source are ''; every row is a document, with a null or repeated id too; repeated rows count as often as they stand; ties go to the smaller
    item in UTF-8 order. A language without kept terms has pairs of value 0 and no terms; an empty table gives no rows. Columns besides these three aren't read."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    salt = 0
    named = settled(_grouped(rows.select("lang", "source").distinct(), salt))
    while not named.groupBy("group").count().where("count > 1").isEmpty():
        salt += 1
        named = settled(_grouped(named.select("lang", "source"), salt))
    uses = term_uses(_grouped(rows, salt).select("lang", "group", "text"), min_docs)
    uses = uses.join(named, ["lang", "group"]).select("lang", "source", "term", "count")
    size = uses.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    total = uses.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = named.select("lang", "source").join(size, "lang", "left").join(total, ["lang", "source"], "left").na.fill(0, ["terms", "total"])
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    groups = settled(groups.select("lang", "source", "terms", "total", place))
    shares = uses.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("total"), F.col("terms")))
    shares = settled(shares.select("lang", "source", "term", "place", "count", "p"))
    discard(uses)

    whole = shares.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = whole.join(of_lang, "lang").select("lang", "term", _share(F.col("count"), F.col("total"), F.col("terms")).alias("q"))
    over = shares.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = groups.select("lang", "source", "place").join(groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other")), "lang").where("place <> other")
    far = _pair_sums(shares, groups)
    both = far.unionByName(far.select("lang", F.col("other").alias("place"), F.col("place").alias("other"), "value"))
    pairs = pairs.join(both, ["lang", "place", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def _pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, place, other, value) of place < other: the sum over all kept terms of the difference of two sources' shares.

    A matrix of terms by sources is filled per group of terms and tile of two blocks of sources; the tile sums of the groups are added up. A share
    that isn't in the table is that of a count of 0."""
    none = _share(F.lit(0), F.col("total"), F.col("terms"))
    some = groups.where("terms > 0").select("lang", "place", "terms", none.alias("p"))
    size = some.groupBy("lang").agg(F.max("terms").alias("terms"), F.floor(F.max("place") / TILE).alias("last"))
    tiles = size.select("lang", F.ceil(F.col("terms") / GROUP_TERMS).alias("salts"), "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("a"))
    tiles = tiles.select("lang", "salts", "a", F.explode(F.sequence("a", "last")).alias("b"))
    block = F.floor(F.col("place") / TILE)
    mine = lambda df: df.withColumn("block", block).join(tiles, "lang").where((F.col("block") == F.col("a")) | (F.col("block") == F.col("b")))
    if_zero = settled(mine(some).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("lang", "a", "b", "salt", "place", "p"))
    given = mine(shares).withColumn("salt", F.pmod(F.xxhash64("term"), F.col("salts"))).select("lang", "a", "b", "salt", "term", "place", "p")
    key = ["lang", "a", "b", "salt"]
    schema = T.StructType([T.StructField("lang", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("place", "other", "value", "seen")]])

    def fill(term_rows: pd.DataFrame, zero: pd.DataFrame) -> pd.DataFrame:
        zero = zero.sort_values("place")
        places, p0 = zero["place"].to_numpy(np.int64), zero["p"].to_numpy(np.int64)
        names, term = np.unique(term_rows["term"].to_numpy(object), return_inverse=True) if len(term_rows) else (np.zeros(0), np.zeros(0, np.int64))
        p = np.repeat(p0[:, None], len(names), 1)
        p[np.searchsorted(places, term_rows["place"].to_numpy(np.int64)), term] = term_rows["p"].to_numpy(np.int64)
        a, b = int(zero["a"].iloc[0]), int(zero["b"].iloc[0])
        left, right = np.flatnonzero(places // TILE == a), np.flatnonzero(places // TILE == b)
        later = [right[right > i] for i in left]
        value = [np.abs(p[js] - p[i]).sum(1) for i, js in zip(left, later, strict=True)]
        at = np.repeat(places[left], [len(js) for js in later])
        return pd.DataFrame({"lang": zero["lang"].iloc[0], "place": at, "other": places[np.concatenate(later)], "value": np.concatenate(value), "seen": len(names)})

    filled = given.groupBy(*key).cogroup(if_zero.groupBy(*key)).applyInPandas(fill, schema)
    sums = filled.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    ends = some.select("lang", "place", "terms", "p"), some.select("lang", F.col("place").alias("other"), F.col("p").alias("q"))
    rest = (F.col("terms") - F.col("seen")) * F.abs(F.col("p") - F.col("q"))
    return sums.join(ends[0], ["lang", "place"]).join(ends[1], ["lang", "other"]).select("lang", F.col("place").cast("long").alias("place"), F.col("other").cast("long").alias("other"), (F.col("value") + rest).alias("value"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS doc FROM {docs}),
t AS (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (n + 5 * v) AS p FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)) AS q FROM c JOIN (SELECT lang, sum(n)::HUGEINT AS n, max(v) AS v FROM g GROUP BY ALL) USING (lang) GROUP BY ALL),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 50
"""
