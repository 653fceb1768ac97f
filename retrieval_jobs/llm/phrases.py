"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a circle. A phrase is counted from the step after both its subphrases (all but its last word, all but its
first) have reached the threshold in what was counted so far, for one full circle; so lengths interleave, and longer phrases start before shorter ones are
done. A phrase's count in a shard is the same whenever it is taken, so the counts of the last circle of steps hold each shard at most once and never exceed the
phrase's frequency; once its circle is full they are its frequency.

What is active is told to the scans by two bitmaps of fixed size: the phrases that reached the threshold, and those that did so within the last circle. A
phrase that they let through by chance is counted in vain, none is missed. Phrases are 64-bit hashes while they are looked for; a last scan counts those
that reached the threshold by their words, so that two phrases of one hash are told apart unless they meet in one block of a scan (4 MB of text).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Circle, bitmap, discard, has_bits, mix, packed_bits, partitions, settled, span_hashes, text_blocks, together, unpacked_bits, words_of

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
SHARDS = 3
FILTER_BITS = 1 << 26
BLOCK = 4 << 20
#: Phrase places that a task holds before it hands their counts on.
HELD = 4_000_000

_STEP = np.uint64(0xD1B54A32D192ED03)
_LENGTHS = np.int64(7)  # the lowest bits of a hash hold the length
#: A-Z lowered, the marks that end a piece as line ends, tab as blank.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[*b".,;:!?", 11, 12, 13]] = 10
_BYTES[9] = 32

_HASHED = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])
_WORDED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])


def _blocks(batch: pa.RecordBatch):
    """(languages of the rows, row, bytes, start and end, hash, piece) of the words of each block; the hash knows the language."""
    langs = batch.column(0).to_pylist()
    seeds = np.array([int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    for lo, hi, raw, offsets in text_blocks(batch, "text", BLOCK):
        buf = _BYTES[raw]
        starts, ends, doc = words_of(buf, offsets)
        words = mix(span_hashes(buf, starts, ends, lower=False) ^ seeds[lo:hi][doc])
        piece = np.cumsum(buf == 10)[starts] + doc if len(starts) else starts
        yield langs[lo:hi], doc, buf, starts, ends, words, piece


def _hash(rolled: np.ndarray, length: int) -> np.ndarray:
    return (mix(rolled).view(np.int64) & ~_LENGTHS) | np.int64(length)


def _scan(docs: DataFrame, told, words: bool, longest: int) -> DataFrame:
    """(h, n): the phrases that are active in this step, counted; all words too in the first circle."""

    def count(batches):
        reached, recent = unpacked_bits(told.value)
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for _, _, _, _, _, word, piece in _blocks(batch):
                rolled, h = word, _hash(word, 1)
                if words:
                    held.append(h)
                    size += len(h)
                ok, new = has_bits(reached, h), has_bits(recent, h)
                for length in range(2, longest + 1):
                    rolled = rolled[:-1] * _STEP + word[length - 1 :]
                    both = ok[:-1] & ok[1:] & (piece[: len(rolled)] == piece[length - 1 :])
                    at = np.flatnonzero(both)
                    if len(at) == 0:
                        break
                    h = _hash(rolled[at], length)
                    active = h[new[at] | new[at + 1]]
                    held.append(active)
                    size += len(active)
                    ok, new = both, np.zeros(len(both), bool)
                    ok[at], new[at] = has_bits(reached, h), has_bits(recent, h)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(count, _HASHED).groupBy("h").agg(F.sum("n").alias("n"))


def _by_words(docs: DataFrame, told, longest: int) -> DataFrame:
    """(lang, phrase, n) of the phrases that may have reached the threshold, by their words; the phrase '' counts all words."""

    def count(batches):
        (reached,) = unpacked_bits(told.value)
        for batch in batches:
            for langs, doc, buf, starts, ends, word, piece in _blocks(batch):
                sizes = ends - starts
                begin = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(sizes + 1, out=begin[1:])
                text = np.full(begin[-1], 32, np.uint8)  # the words with one blank after each
                inside = np.ones(begin[-1], bool)
                inside[begin[1:] - 1] = False
                taken = np.zeros(len(buf) + 1, np.int8)
                taken[starts] += 1
                taken[ends] -= 1
                text[inside] = buf[np.cumsum(taken[:-1]).astype(bool)]
                names = pa.array(langs, pa.string())

                def rows(first, length, n, doc=doc, begin=begin, text=text, names=names):
                    size = begin[first + length] - 1 - begin[first]
                    offsets = np.zeros(len(first) + 1, np.int64)
                    np.cumsum(size, out=offsets[1:])
                    data = text[np.repeat(begin[first] - offsets[:-1], size) + np.arange(offsets[-1])]
                    phrase = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
                    return pa.RecordBatch.from_arrays([names.take(pa.array(doc[first])), phrase, pa.array(n.astype(np.int64))], names=_WORDED.names)

                rolled, ok = word, np.ones(len(word), bool)
                for length in range(1, longest + 1):
                    if length > 1:
                        rolled = rolled[:-1] * _STEP + word[length - 1 :]
                        ok = ok[:-1] & ok[1:] & (piece[: len(rolled)] == piece[length - 1 :])
                    at = np.flatnonzero(ok)
                    if len(at) == 0:
                        break
                    h = _hash(rolled[at], length)
                    found = has_bits(reached, h)
                    ok[at] = found
                    if found.any():
                        _, first, n = np.unique(h[found], return_index=True, return_counts=True)
                        yield rows(at[found][first], length, n)
                n = np.bincount(doc, minlength=len(langs))
                yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(langs)), pa.array(n.astype(np.int64))], names=_WORDED.names)

    return docs.mapInArrow(count, _WORDED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, n): the phrases of 1 to ``longest`` words that occur ``min_count`` times in their language; the phrase '' has the number of all words."""
    spark = docs.sparkSession
    shard = F.pmod(F.xxhash64("lang", "text"), F.lit(shards))
    parts = [settled(docs.where(shard == s)) for s in range(shards)]
    counts: list[DataFrame] = []  # of the last circle of steps
    circle = Circle(spark, "h long, n long", "h")  # they together
    found: DataFrame | None = None  # what reached the threshold in all steps
    bits = [np.zeros(FILTER_BITS // 8, np.uint8)]  # of what may be part of a longer phrase: all of it, then by step of the last circle
    step = 0
    while step < shards or any(b.any() for b in bits[1:]):
        told = spark.sparkContext.broadcast(packed_bits(bits[0], np.bitwise_or.reduce(bits[1:]) if step else bits[0]))
        counts.append(settled(_scan(parts[step % shards], told, step < shards, longest), by="h"))
        told.destroy()
        circle.leave(step - shards)
        circle.add(counts[-1], step)
        discard(*counts[:-shards])
        counts = counts[-shards:]
        reached = settled(_reached(circle.rows(), len(counts), found, min_count), fixed=True)
        found = together(found, reached) if found else reached
        new = bitmap(reached.where(F.col("h").bitwiseAND(F.lit(int(_LENGTHS))) < longest), FILTER_BITS)
        bits = [bits[0] | new, *[*bits[1:], new][-shards:]]
        step += 1
    told = spark.sparkContext.broadcast(packed_bits(bitmap(found, FILTER_BITS)))
    exact = settled(_by_words(together(*parts), told, longest).where((F.col("n") >= min_count) | (F.col("phrase") == "")))
    told.destroy()
    circle.drop()
    discard(*counts, found, *parts)
    return exact


def _reached(counts: DataFrame, steps: int, before: DataFrame | None, min_count: int) -> DataFrame:
    """(h): what reaches the threshold in the counts of a circle of ``steps`` and hasn't before.

    A sum reaches it only if one of its parts reaches its share of it: only such phrases are summed up, where the counts lie, without an exchange."""
    likely = counts.where(F.col("n") >= -(-min_count // steps)).select("h").distinct()
    sums = counts.join(likely.hint("shuffle_hash"), "h", "left_semi").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h")
    new = sums.join(before, "h", "left_anti") if before else sums
    return new.coalesce(-(-partitions(new.sparkSession) // 3))  # few rows are left


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words by their weakest cut.

    a, l, r: occurrences of the phrase and of both parts of the cut with the lowest score floor(1000 * a * n / (l * r)), the first such cut; n: all words of the
    language. Phrases that lie within a longer one of at least as many occurrences are left out. A null lang is 'und', a null text is empty; every row is a document,
    with a null or repeated id too; ties go by count, then by phrase in UTF-8 order; an empty table gives no rows. Columns besides these two aren't read."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    f = frequent_phrases(rows, min_count, longest, shards)
    words = f.where("phrase = ''").select("lang", F.col("n").alias("all"))
    f = f.where("phrase <> ''")
    long_ = f.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = long_.select("lang", "phrase", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * big("all"), big("l") * big("r"))
    best = cuts.join(words, "lang").withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "all")).alias("c"))
    inner = long_.where(F.size("w") > 2).select("lang", "n", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("c.a")))
    kept = kept.select("lang", "phrase", "c.a", "c.l", "c.r", F.col("c.all").alias("n"), "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM {docs}),
p AS (SELECT lang, doc, generate_subscripts(q, 1) AS piece, unnest(q) AS t FROM (SELECT lang, doc, regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+') AS q FROM d)),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY ALL),
ph AS (SELECT lang, len AS k, array_to_string(ws[i : i + len - 1], ' ') AS phrase FROM (SELECT lang, ws, len, unnest(range(1, len(ws) - len + 2)) AS i FROM w, range(1, 6) AS l(len))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM ph GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cut AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c),
s AS (SELECT cut.lang, cut.phrase, a, j, x.n AS l, y.n AS r, total.n AS n, (1000::HUGEINT * a * total.n) // (x.n * y.n) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN total ON total.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT DISTINCT x.lang, array_to_string(x.ws[i : i + len - 1], ' ') AS phrase, x.a AS longer FROM (SELECT c.*, len, unnest(range(1, k - len + 2)) AS i FROM c, range(2, 5) AS l(len) WHERE len < k) AS x),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = b.lang AND sub.phrase = b.phrase AND 100 * sub.longer >= 100 * b.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""
