"""Exact token counts of every prefix of a text under a BPE vocabulary with word ends, by prefix dynamic programming.

The last token of the encoding of a prefix decides everything: the encoding of ``w[:e]`` ends with the one token ``t`` whose start ``s`` has an
encoding that ends with a token that lets ``t`` stand beside it unmerged. So one pass over a word gives the count at each of its prefixes; sums over the
words before give it for each prefix of a text. Truncation and budgets are then look-ups in these counts.

Words repeat, so each worker keeps the counts of the words it met, in bounded memory. A word of any length passes through a window as wide as the longest
token. A prefix ends after a code point of the text in NFC, which the vocabulary asks for; almost every text is in NFC as it stands.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import result_schema

LIMIT = 2048
#: Code points that a row of ``prefix_table`` covers.
RUN = 4096
#: Words, pieces and token pairs that a worker remembers, of each kind.
REMEMBERED = 500_000
#: Longer words are not remembered.
REMEMBERED_CHARS = 48
#: Code points that are cut into words at a time.
SLICE = 1 << 20

#: A white-space chunk; the four separators below are white space to Python, but not to the vocabulary.
_CHUNK = re.compile("[\\S\x1c-\x1f]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
# The vocabulary's pattern of pieces, here for lower-case ASCII and Latin-1 text, which is in NFC and which ``str.lower`` lower-cases as the library does.
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
_LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t-\r\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
_NEVER = 1 << 60
_PAIR = 1 << 24


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Remembered(dict):
    """Answers of ``ask``, kept up to a bound: when half of it is full, those not asked for since the last such time are forgotten."""

    def __init__(self, ask, longest: int | None = None):
        super().__init__()
        self.ask, self.longest, self.older = ask, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.ask(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixCounter:
    """Counts for the vocabulary file ``path`` (tokenizers JSON: BPE over bytes with an end-of-word suffix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.normal, self.cut = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end, letters = spec["model"]["end_of_word_suffix"], _byte_letters()
        vocab = spec["model"]["vocab"]
        self.tokens: dict[bytes, list[int]] = {}  # bytes -> [open token, closed token], -1 where there is none; holds all beginnings of tokens
        for name, number in vocab.items():
            closed = name.endswith(end) and name != end
            body = bytes(letters[c] for c in (name.removesuffix(end) if closed else name))
            for k in range(1, len(body)):
                self.tokens.setdefault(body[:k], [-1, -1])
            self.tokens.setdefault(body, [-1, -1])[closed] = number
        self.width = 1 << max(map(len, self.tokens)).bit_length()
        self.merged: dict[int, int] = {}  # pair, as left * PAIR + right -> rank
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left part, right part
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            self.merged[a * _PAIR + b] = rank
            self.made.setdefault(vocab[left + right], (rank, a, b))
        special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.mark = re.compile("|".join(sorted({re.escape(s[:2]) for s in special}))) if special else None
        self.trie = self._trie()
        self.right_edge, self.left_edge = _Remembered(lambda t: self._edge(t, 1)), _Remembered(lambda t: self._edge(t, 0))
        self.apart = _Remembered(self._apart)
        self.whole = _Remembered(self._whole)
        self.ends = _Remembered(self._end, REMEMBERED_CHARS)
        self.chunks = _Remembered(self._chunk_total, REMEMBERED_CHARS)
        self._pattern = None

    # tokens

    def _trie(self) -> dict:
        """``tokens`` by bytes: a node has (nodes by next byte, open token, closed token)."""
        root: dict = {}
        nodes = {b"": root}
        for body in sorted(self.tokens, key=len):
            nodes[body] = {}
            nodes[body[:-1]][body[-1]] = (nodes[body], *self.tokens[body])
        return root

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at an edge of ``token`` while it is built, each with the rank that ends it."""
        out, ends = [], _NEVER
        while True:
            out.append((token * _PAIR if side else token, ends))
            if token not in self.made:
                return out
            ends, token = self.made[token][0], self.made[token][1 + side]

    def _across(self, left: int, right: int) -> int:
        """The rank of the first merge across two neighbouring tokens that comes before those that build them (the leftmost of equal ranks first)."""
        first, rank_of, inner = _NEVER, self.merged.get, self.left_edge[right]
        for a, a_ends in self.right_edge[left]:
            for b, b_ends in inner:
                rank = rank_of(a + b)
                if rank is not None and rank < a_ends and rank <= b_ends and rank < first:
                    first = rank
        return first

    def _apart(self, pair: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        return self._across(pair // _PAIR, pair % _PAIR) == _NEVER

    def _whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        if token not in self.made:
            return True
        rank, a, b = self.made[token]
        return self.whole[a] and self.whole[b] and self._across(a, b) == rank

    def _counts(self, piece: bytes) -> Iterator[int]:
        """Token count of each prefix of a piece, as a word of its own: the dynamic program."""
        tokens, apart, whole, mask = self.tokens, self.apart, self.whole, self.width - 1
        last, count, closed = [-1] * self.width, [0] * self.width, [0] * self.width  # of the open prefix; of the prefix as a word
        n = len(piece)
        for s in range(n):
            before, k = last[s & mask] * _PAIR, count[s & mask] + 1
            last[s & mask] = -1
            for e in range(s + 1, min(n, s + mask) + 1):
                found = tokens.get(piece[s:e])
                if found is None:
                    break
                t, c = found
                if t >= 0 and last[e & mask] < 0 and (s == 0 or apart[before + t]) and whole[t]:
                    last[e & mask], count[e & mask] = t, k
                if c >= 0 and not closed[e & mask] and (s == 0 or apart[before + c]) and whole[c]:
                    closed[e & mask] = k
            yield closed[(s + 1) & mask]
            closed[(s + 1) & mask] = 0

    def _end(self, piece: bytes) -> int:
        """The last of ``_counts``: of the words only the whole piece is looked at, and its places are all kept."""
        n = len(piece)
        if n > REMEMBERED_CHARS:
            return self._last(piece)
        root, apart, whole = self.trie, self.apart, self.whole
        last, count = [-1] * (n + 1), [0] * (n + 1)
        last[0] = 0
        for s in range(n):
            before, e, nodes = last[s] * _PAIR, s, root
            for byte in piece[s:]:
                found = nodes.get(byte)
                if found is None:
                    break
                nodes, t, c = found
                e += 1
                if e == n:
                    if c >= 0 and (s == 0 or apart[before + c]) and whole[c]:
                        return count[s] + 1
                elif t >= 0 and last[e] < 0 and (s == 0 or apart[before + t]) and whole[t]:
                    last[e], count[e] = t, count[s] + 1
        return 0

    def _last(self, piece: bytes) -> int:
        n = 0
        for n in self._counts(piece):  # noqa: B007
            pass
        return n

    # chunks

    def _piece_pattern(self) -> re.Pattern:
        """The pattern of pieces over all code points, with the classes the library has (for chunks too long to be cut at once)."""
        if self._pattern is None:
            kinds: dict[str, list[int]] = {"letter": [], "number": [], "space": []}
            for lo in range(0, 0x110000, 1 << 14):
                points = [c for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000]
                inside = {a // 4 for _, (a, b) in self.cut("".join(f"a{chr(c)}a " for c in points)) if b - a == 3}
                single, twice = set(), {}
                for _, (a, b) in self.cut("".join(f"{chr(c)}{chr(c)} " for c in points)):
                    twice[a // 3] = 1
                    if b - a == 1:
                        single.add(a // 3)
                for i, c in enumerate(points):
                    kind = "letter" if i in inside else "number" if i in single else None if i in twice else "space"
                    if kind:
                        kinds[kind].append(c)
            letter, number, space = ("".join(f"\\U{c:08x}" for c in kinds[k]) for k in ("letter", "number", "space"))
            self._pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{letter}{number}{space}]+")
        return self._pattern

    def _cut(self, normal: str) -> Iterator[tuple[int, str]]:
        """(start, piece) of a normalised chunk."""
        if normal.isascii():
            for m in _ASCII_PIECE.finditer(normal):
                yield m.start(), m.group()
        elif max(normal) <= "\xff":
            for m in _LATIN_PIECE.finditer(normal):
                yield m.start(), m.group()
        elif len(normal) <= RUN:
            for _, (a, b) in self.cut(normal):
                yield a, normal[a:b]
        else:
            for m in self._piece_pattern().finditer(normal):
                yield m.start(), m.group()

    def _chunk_total(self, chunk: str) -> int:
        if self.mark and self.mark.search(chunk):
            return sum(1 if i % 2 else self.chunks[s] for i, s in enumerate(self.special.split(chunk)) if s) if self.special.search(chunk) else self._plain_total(chunk)
        return self._plain_total(chunk)

    def _plain_total(self, chunk: str) -> int:
        if chunk.isascii():
            return sum(map(self.ends.__getitem__, map(str.encode, _ASCII_PIECE.findall(chunk.lower()))))
        if max(chunk) <= "\xff":
            return sum(map(self.ends.__getitem__, map(str.encode, _LATIN_PIECE.findall(chunk.lower()))))
        return sum(self.ends[piece.encode()] for _, piece in self._cut(self.normal(chunk)))

    def _plain_prefixes(self, chunk: str) -> Iterator[int]:
        """Counts at the code points of a chunk in NFC that holds no special string."""
        normal = self.normal(chunk)
        steps = None if len(normal) == len(chunk) else list(accumulate(len(self.normal(c)) for c in chunk))
        base, at, i = 0, 0, 0
        for start, piece in self._cut(normal):
            while at < start:  # code points of no piece
                at += 1
                if steps is None or steps[i] == at:
                    yield base
                    i += 1
            data, here = piece.encode(), 0
            counts = self._counts(data)
            if piece in _LONG_CONTRACTIONS:
                quote = self.ends[b"'"]
                counts = iter((quote, quote + self.ends[data[1:2]], self.ends[data]))
            for c in piece:
                for _ in range(len(c.encode())):
                    here = next(counts)
                at += 1
                if steps is None or steps[i] == at:
                    yield base + here
                    i += 1
            base += here

    def chunk_prefixes(self, chunk: str) -> Iterator[int]:
        """Counts at the code points of a chunk without white space, in NFC; special strings are one token, their beginnings are plain text."""
        base, plain = 0, ""
        for i, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            if i % 2 == 0:
                here = 0
                for here in self._plain_prefixes(part):
                    yield base + here
                plain, after = part, base + here
            else:
                for k, here in enumerate(self._plain_prefixes(plain + part[:-1])):
                    if k >= len(plain):
                        yield base + here
                base = after + 1
                yield base

    # texts

    def nfc(self, text: str) -> str:
        """The text in NFC, but for special strings."""
        if text.isascii() or unicodedata.is_normalized("NFC", text):
            return text
        parts = self.special.split(text) if self.special else [text]
        return "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(parts))

    @staticmethod
    def slices(text: str, size: int = SLICE) -> Iterator[tuple[int, str]]:
        """(start, part) of runs of about ``size`` code points that end at white space."""
        lo = 0
        while lo < len(text):
            hi = lo + size
            if hi < len(text):
                hi = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi)) + 1
                if hi <= lo:
                    m = re.compile("[ \n]").search(text, lo + size)
                    hi = m.end() if m else len(text)
            yield lo, text[lo:hi]
            lo = hi

    def total(self, text: str) -> int:
        """Tokens of a whole text."""
        ask, n = self.chunks.__getitem__, 0
        for _, part in self.slices(text) if len(text) > SLICE else ((0, text),):
            n += sum(map(ask, self._chunks_of(part)))
        return n

    @staticmethod
    def _chunks_of(part: str) -> list[str]:
        return _CHUNK.findall(part) if any(c in part for c in _SEPARATORS) else part.split()

    def within(self, text: str, limit: int) -> int:
        """Code points of the longest prefix (in NFC) that has at most ``limit`` tokens."""
        text, used, fits = self.nfc(text), 0, 0
        for lo, part in self.slices(text, RUN):
            before = list(accumulate(map(self.chunks.__getitem__, self._chunks_of(part)), initial=used))
            if before[-1] > limit:
                k = max(0, bisect_right(before, limit) - 1)  # the chunk that passes the limit
                m = next(islice(_CHUNK.finditer(part), k, None))
                best = lo + m.start()
                if before[k] < limit:
                    for i, here in enumerate(self.chunk_prefixes(m.group())):
                        if before[k] + here <= limit:
                            best = lo + m.start() + i + 1
                return best
            used, fits = before[-1], lo + len(part)
        return fits

    def prefixes(self, text: str) -> Iterator[int]:
        """Token count of each prefix of 1, 2, ... code points of the text in NFC."""
        used = 0
        for _, part in self.slices(self.nfc(text)):
            at = 0
            for m in _CHUNK.finditer(part):
                yield from (used for _ in range(m.start() - at))
                here = 0
                for here in self.chunk_prefixes(m.group()):
                    yield used + here
                used, at = used + here, m.end()
            yield from (used for _ in range(len(part) - at))


@functools.lru_cache(maxsize=1)
def worker_counter(path: str, query: str) -> PrefixCounter:
    """The counter of this worker, with the words it met in earlier tasks of the query; another query starts anew, also if the file has changed."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, keep: list[str] | None = None, names: tuple[str, ...] = ("n_bytes", "n_tokens", "over_limit", "cut")) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but text, unless named) with n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and cut.

    ``cut``: code points (of the text in NFC) of the longest prefix with at most ``limit`` tokens. A null text counts as empty: 0 bytes, 0 tokens. Every row
    is counted for itself, with a null or repeated id too; an empty table gives no rows; result names that ``docs`` has raise an error, name them otherwise."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    kinds = (T.LongType(), T.LongType(), T.BooleanType(), T.LongType())
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = result_schema(kept, list(zip(names, kinds, strict=True)))
    query = uuid.uuid4().hex

    def run(batches):
        counter = worker_counter(vocabulary, query)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes, totals, cuts = [], [], []
            for cell in texts:
                text = cell.as_py() or ""
                n = counter.total(text)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                totals.append(n)
                cuts.append(counter.within(text, limit) if n > limit else len(counter.nfc(text)))
            arrays = [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[f"c{i}" for i in range(len(schema))])

    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("text_"))
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return out.mapInArrow(run, plain).toDF(*schema.names)


def prefix_table(docs: DataFrame, vocabulary: str, key: str = "doc_id", run: int = RUN) -> DataFrame:
    """(key, first, counts): the count of each prefix, in runs of ``run`` code points, so that no row grows with a text.

    ``counts[i]`` is the number of tokens of the prefix of ``first + i + 1`` code points (of the text in NFC). Empty and null texts have no rows. Rows that share a
    key can't be told apart by the look-ups below; number them first."""
    schema = T.StructType([docs.schema[key], T.StructField("first", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    query = uuid.uuid4().hex

    def rows(batches):
        counter = worker_counter(vocabulary, query)
        for batch in batches:
            for i in range(batch.num_rows):
                own, first, counts = batch.column(0).slice(i, 1), 0, []

                def flush(own=own):
                    return pa.RecordBatch.from_arrays([own, pa.array([first], pa.int64()), pa.array([counts], pa.list_(pa.int32()))], names=schema.names)

                for n in counter.prefixes(batch.column(1)[i].as_py() or ""):
                    counts.append(n)
                    if len(counts) == run:
                        yield flush()
                        first, counts = first + run, []
                if counts:
                    yield flush()

    return docs.select(F.col(key), "text").mapInArrow(rows, schema)


def longest_within(table: DataFrame, budgets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, budget, chars): the longest prefix of each asked (key, budget) that has at most ``budget`` tokens; 0 if none, or if the key has no text.

    Only the counts are read. A run's answer is its last fitting place, so that runs combine by a maximum before the shuffle."""
    asked = budgets.select(key, "budget")
    fits = F.array_max(F.transform("counts", lambda n, i: F.when(n <= F.col("budget"), i + 1)))
    found = table.join(asked.distinct(), key).groupBy(key, "budget").agg(F.max(F.col("first") + fits).alias("chars"))
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col("a.budget").eqNullSafe(F.col("b.budget"))
    return asked.alias("a").join(found.alias("b"), same, "left").select(f"a.{key}", "a.budget", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))


def tokens_at(table: DataFrame, places: DataFrame, key: str = "doc_id", run: int = RUN) -> DataFrame:
    """(key, chars, n_tokens): tokens of the prefix of each asked (key, chars); 0 for no characters, null past the text's end."""
    asked = places.select(key, "chars", ((F.col("chars") - 1 - F.pmod(F.col("chars") - 1, F.lit(run)))).cast("long").alias("first"))
    rows = asked.join(table, [key, "first"], "left")
    n = F.get("counts", (F.col("chars") - 1 - F.col("first")).cast("int"))
    return rows.select(key, "chars", F.when(F.col("chars") <= 0, 0).otherwise(n).cast("long").alias("n_tokens"))
