"""Benchmark decontamination by canonical templates.

Words lose case and outer punctuation; numbers, units after numbers, and capitalised words inside a
sentence become typed placeholders. Windows of five template tokens are hash-joined between
documents and benchmark items. Windows of one document and item on one diagonal must fill their
slots consistently (one item value never stands for two document values), so a question asked again
with other numbers or names is caught and an unrelated text of the same shape is not.

Each window has a second template where capitalised words that open a sentence are names too, unless
they are common openers. An item without a window is looked for as it stands, by windows of its raw
tokens, of which each character of a script without blanks is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, settled, span_hashes, text_blocks, window_hashes, words_of

WINDOW = 5
LITERALS = 3  # placeholders alone don't make a window
#: Items without a template window are looked for inside documents from so many raw tokens and bytes on.
EXACT_TOKENS, EXACT_BYTES = 3, 12
PLAIN, OPENED, EXACT = 1, 2, 4  # kinds of windows, as bits: openers literal, openers as names, raw tokens
#: Benchmark windows up to this many (16 MB of hashes) are sent to the tasks; more are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Text bytes that one pass holds at a time: some ten arrays of 8 bytes a text byte stand beside each other.
BLOCK = 256 << 10

# Units that may follow a number.
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent $ usd eur dollars dollar euros euro cents kwh w kw v a hz km/h mph c f degrees".split()

# Words that open sentences and are no names.
OPENERS = "a an the this that these those i he she it we they you his her its our their your my there here how what when where which who whom whose why if then now each every all some most both one two three in on at by for from of to with after before during while as and but or so because since until once is are was were do does did has have had can could will would should may might given suppose assume let find compute calculate determine solve take consider write choose explain show prove evaluate simplify use".split()


def _hash_words(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return np.sort(span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(w) for w in data], ends))


_UNIT_HASHES, _OPENER_HASHES = _hash_words(UNITS), _hash_words(OPENERS)
_NUMBER, _NAME, _UNIT, _RAW = (np.uint64(x) for x in mix(np.array([11, 12, 13, 14], np.uint64)))
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/+-%$"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;|"]] = True


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if len(sorted_set) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def templates(buf: np.ndarray, offsets: np.ndarray):
    """Template token hash, slot value hash (0 for a literal), document, value hash and whether it may be an opening name, of each token."""
    starts, ends, doc = words_of(buf, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), doc[:0], np.zeros(0, np.uint64), np.zeros(0, bool)
    places = np.arange(len(buf))
    solid = ~_PUNCT[buf]
    prior = np.maximum.accumulate(np.where(solid, places, -1))
    following = np.minimum.accumulate(np.where(solid, places, len(buf))[::-1])[::-1]
    inner_start, inner_end = following[starts], prior[ends - 1] + 1
    keep = inner_start < inner_end
    sentence_end = _STOP[buf[ends - 1]]
    opens = np.ones(len(starts), bool)
    opens[1:] = sentence_end[:-1] | (doc[1:] != doc[:-1])
    # a line break before the word also opens a sentence
    breaks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 10, out=breaks[1:])
    opens[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
    starts, ends, doc, opens = inner_start[keep], inner_end[keep], doc[keep], opens[keep]
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), doc[:0], np.zeros(0, np.uint64), np.zeros(0, bool)
    value = span_hashes(buf, starts, ends)
    sums = np.zeros((2, len(buf) + 1), np.int64)
    np.cumsum(_DIGIT[buf], out=sums[0, 1:])
    np.cumsum(_NUMERIC[buf], out=sums[1, 1:])
    number = (sums[0, ends] > sums[0, starts]) & (sums[1, ends] - sums[1, starts] == ends - starts)
    head, second = buf[starts], buf[np.minimum(starts + 1, len(buf) - 1)]
    upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    last = buf[ends - 1]
    capital = upper & ~((last >= 65) & (last <= 90) & (ends - starts > 1)) & ~number  # words all in capitals are no names
    name = capital & ~opens
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = after_number & member(value, _UNIT_HASHES)
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    opening = capital & opens & ~unit & ~member(value, _OPENER_HASHES)
    return token, np.where(number | unit | name, value, np.uint64(0)), doc, value, opening


def raw_tokens(buf: np.ndarray, offsets: np.ndarray):
    """Value hash, document and length in bytes of each token without outer punctuation; ideographs and kana are tokens of their own."""
    starts, ends, _ = words_of(buf, offsets)
    wide = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9))
    if len(wide):
        after = wide + 3
        starts, ends = np.unique(np.concatenate([starts, wide, np.setdiff1d(after, ends)])), np.unique(np.concatenate([ends, after, np.setdiff1d(wide, starts)]))
    solid = ~_PUNCT[buf]
    places = np.arange(len(buf))
    prior = np.maximum.accumulate(np.where(solid, places, -1))
    following = np.minimum.accumulate(np.where(solid, places, len(buf))[::-1])[::-1]
    starts, ends = following[starts], prior[ends - 1] + 1
    keep = starts < ends
    keep[keep] &= ~((buf[starts[keep]] == 0xE3) & (buf[np.minimum(starts[keep] + 1, len(buf) - 1)] == 0x80))  # ideographic punctuation
    starts, ends = starts[keep], ends[keep]
    return span_hashes(buf, starts, ends), np.searchsorted(offsets, starts, "right") - 1, ends - starts


def template_windows(df: DataFrame, key: str, wanted=None, exact: list[int] | None = None) -> DataFrame:
    """(key, pos, window, slots, kind, size) of every window with enough literals; ``wanted``: broadcast sorted hashes.

    ``kind`` has the bits of the templates that the window belongs to. A text of fewer than five tokens has its whole
    sequence as its one window. Raw windows are made of ``exact`` tokens; if that is None, the rows are items, and
    those without a window of five get raw windows of five tokens, or of all they have."""
    schema = f"{key} long, pos long, win long, slots array<long>, kind int, size int"

    def of_block(buf, offsets):
        """(document, pos, hash, slots, kind, size) arrays."""
        found = []
        rows = len(offsets) - 1
        whole = np.zeros(rows, bool)
        token, slot, doc, value, opening = templates(buf, offsets)
        count = np.bincount(doc, minlength=rows)
        first = np.searchsorted(doc, np.arange(rows))

        def add(hashes, start, n, slot, doc, first, kind):
            slots = np.zeros((len(start), WINDOW), np.uint64)
            for k in range(n if slot is not None else 0):
                slots[:, k] = slot[start + k]
            found.append((doc[start], start - first[doc[start]], hashes[start], slots, kind, np.full(len(start), n, np.int32)))

        opened = np.zeros(len(token) + 1, np.int64)
        np.cumsum(opening, out=opened[1:])
        for kind in (PLAIN, OPENED):
            if kind == OPENED:
                if not opened[-1]:
                    break
                token, slot = np.where(opening, _NAME, token), np.where(opening, value, slot)
            fixed = np.zeros(len(token) + 1, np.int64)
            np.cumsum(slot == 0, out=fixed[1:])
            for n in range(1, WINDOW + 1):
                start = np.arange(max(0, len(token) - n + 1))
                ok = doc[start] == doc[start + n - 1]
                if n < WINDOW:
                    ok &= count[doc[start]] == n
                ok &= fixed[start + n] - fixed[start] >= min(LITERALS, n)
                has = opened[start + n] > opened[start]
                if kind == OPENED:
                    ok &= has
                if not ok.any():
                    continue
                if n == WINDOW:
                    whole[doc[start[ok]]] = True
                hashes = window_hashes(token, n)
                if wanted is not None:
                    ok &= member(hashes, wanted.value)
                start = start[ok]
                add(hashes, start, n, slot, doc, first, np.where(has[ok], kind, PLAIN | OPENED).astype(np.int32))
        if exact is None and whole.all() or exact is not None and not exact:
            return found
        value, doc, length = raw_tokens(buf, offsets)
        count, first = np.bincount(doc, minlength=rows), np.searchsorted(doc, np.arange(rows))
        fit = ~whole & (count >= EXACT_TOKENS) & (np.bincount(doc, length, minlength=rows) >= EXACT_BYTES)
        for n in range(EXACT_TOKENS, WINDOW + 1) if exact is None else exact:
            start = np.arange(max(0, len(value) - n + 1))
            ok = doc[start] == doc[start + n - 1]
            if exact is None:
                ok &= fit[doc[start]] & (np.minimum(count[doc[start]], WINDOW) == n)
            if not ok.any():
                continue
            hashes = window_hashes(value ^ _RAW, n)
            if wanted is not None:
                ok &= member(hashes, wanted.value)
            add(hashes, start[ok], n, None, doc, first, np.full(int(ok.sum()), EXACT, np.int32))
        return found

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for lo, _, buf, offsets in text_blocks(batch, max_bytes=BLOCK):
                if len(buf) == 0 or not (found := of_block(buf, offsets)):
                    continue
                owner, pos, win, slots, kind, size = (np.concatenate(x) for x in zip(*found, strict=True))
                for a in range(0, len(owner), 200_000):
                    b = slice(a, a + 200_000)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(owner[b] + lo)).cast(pa.int64()), pa.array(pos[b]), pa.array(win[b].view(np.int64)),
                         pa.ListArray.from_arrays(np.arange(0, WINDOW * (len(owner[b]) + 1), WINDOW, dtype=np.int32), pa.array(slots[b].ravel().view(np.int64))),
                         pa.array(kind[b]), pa.array(size[b])],
                        names=[key, "pos", "win", "slots", "kind", "size"],
                    )

    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = 0.75, min_run: int = 9, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Documents that hold a benchmark item, one row per (doc_id, item_id).

    Columns: matched (item windows found), item_windows, coverage, reparameterised (some slot holds
    another value than the item's). A pair counts when its consistent windows cover ``min_coverage``
    of the item, or ``min_run`` of them (13 words) lie on one diagonal; for an item of raw windows all
    must lie on one diagonal. Null ids are ignored; null,
    empty or unmatched texts give no row; repeated rows of one doc_id count as one, and of different texts that share one the
    windows are taken together; of equal coverages that by plain templates counts; extra columns of any name are ignored; an empty
    table on either side gives no rows."""
    bench = settled(template_windows(benchmark.where("item_id is not null"), "item_id").select("item_id", F.col("pos").alias("ipos"), "win", F.col("slots").alias("islots"), F.col("kind").alias("ikind"), "size").distinct())
    count = lambda kind: F.countDistinct(F.when(F.col("ikind").bitwiseAND(kind) != 0, F.col("ipos")))
    size = bench.groupBy("item_id").agg(count(PLAIN).alias("plain"), count(OPENED).alias("opened"), count(EXACT).alias("exact"))
    keys = bench.select("win").distinct()
    exact = sorted(r["size"] for r in bench.where(F.col("ikind") == EXACT).select("size").distinct().collect())
    rows = docs.where("doc_id is not null")
    if keys.count() <= broadcast_windows:
        wanted = np.sort(keys.toArrow().column("win").to_numpy().view(np.uint64))
        windows = template_windows(rows, "doc_id", docs.sparkSession.sparkContext.broadcast(wanted), exact)
    else:
        windows = template_windows(rows, "doc_id", exact=exact)
    hits = windows.drop("size").join(bench.drop("size"), "win").withColumn("diag", F.col("pos") - F.col("ipos"))
    kinds = F.filter(F.array(F.lit(PLAIN), F.lit(OPENED), F.lit(EXACT)), lambda k: k.bitwiseAND(F.col("kind")).bitwiseAND(F.col("ikind")) != 0)
    hits = hits.withColumn("of", F.explode(kinds))
    # slots as a map item value -> document value; a diagonal is consistent if no item value has two images
    filled = F.filter(F.arrays_zip("islots", "slots"), lambda x: x["islots"] != 0)
    lines = hits.groupBy("doc_id", "item_id", "of", "diag").agg(
        F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set(filled))).alias("slots")
    )
    ok = F.size(F.array_distinct(F.transform("slots", lambda x: x["islots"]))) == F.size("slots")
    changed = F.exists("slots", lambda x: x["islots"] != x["slots"])
    pairs = (
        lines.where(ok)
        .groupBy("doc_id", "item_id", "of")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"), F.max(F.size("at")).alias("run"), F.min(changed.cast("int")).alias("changed"))
    )
    pairs = pairs.join(size, "item_id").withColumn("item_windows", F.when(F.col("of") == PLAIN, F.col("plain")).when(F.col("of") == OPENED, F.col("opened")).otherwise(F.col("exact")))
    # few windows with opening names can't stand for an item of many windows
    least = F.when(F.col("of") == OPENED, F.col("plain") / 2).otherwise(0)
    pairs = pairs.withColumn("coverage", F.col("matched") / F.greatest(F.col("item_windows"), least))
    enough = F.when(F.col("of") == EXACT, F.col("run") >= F.col("item_windows")).otherwise((F.col("coverage") >= min_coverage) | (F.col("run") >= min_run))
    best = F.max(F.struct("coverage", (-F.col("of")).alias("rank"), "matched", "item_windows", "changed")).alias("b")
    out = pairs.where(enough).groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "b.matched", "b.item_windows", "b.coverage", (F.col("b.changed") == 1).alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null doc_id stay.

    Those documents are found first: the few ids can then be sent to the texts, which need no shuffle beside the search."""
    bad = settled(contaminated(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(bad, docs["doc_id"].cast("long") == bad["doc_id"], "left_anti")
