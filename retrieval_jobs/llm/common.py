"""Helpers that the operators share: table reads, numpy views of Arrow text, hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one numpy pass holds at a time (a longer document is a pass of its own).
BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: dict[str, str] = {}

#: Spark's setting that lets the shuffle files of a query go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a local session, as in tests, gets one of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return _OWN_DIRS[app]


def settled(df: DataFrame, by: str | None = None, fixed: bool = False) -> DataFrame:
    """``df`` computed once and kept as a table in the shared checkpoint folder: later reads survive lost executors.

    With ``by`` it is bucketed by that column, so that joins on it need not shuffle it; ``df`` should come as ``dealt`` by it.
    The shuffle files of the query that writes it go when it ends. ``fixed``: for a query that a loop repeats, its plan runs as it stands. The
    adaptive one takes a thread of the driver for every exchange, which stays for a minute, and a new plan after each."""
    spark = df.sparkSession
    name = f"settled_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    wanted = {CLEANUP: "true"} | ({ADAPTIVE: "false"} if fixed else {})
    before = {k: spark.conf.get(k, "true" if k == ADAPTIVE else "false") for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        if by:
            df.write.bucketBy(partitions(spark), by).option("path", path).saveAsTable(name)
        else:
            df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.table(name) if by else spark.read.schema(df.schema).parquet(path)


def _folders(*tables: DataFrame) -> list[str]:
    return sorted({f.rpartition("/")[0] for t in tables for f in t.inputFiles()})


def together(*tables: DataFrame) -> DataFrame:
    """Tables of ``settled`` that have one schema and no buckets, as one scan: plans don't grow with their number."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*_folders(*tables))


class Circle:
    """Tables of ``settled`` that are bucketed by one column, as the partitions of one table bucketed by it.

    It is read as one bucketed scan: a join or group by that column over all its tables needs no exchange, which a union of them would."""

    def __init__(self, spark: SparkSession, columns: str, by: str):
        """``columns``: their names and types, as in SQL."""
        self.spark, self.name = spark, f"circle_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.name} ({columns}, part int) using parquet partitioned by (part) clustered by ({by}) into {partitions(spark)} buckets location '{shared_dir(spark)}/{self.name}'")

    def add(self, table: DataFrame, part: int) -> None:
        for folder in _folders(table):  # none, if it has no rows
            self.spark.sql(f"alter table {self.name} add partition (part = {part}) location '{folder}'")

    def leave(self, part: int) -> None:
        """The partition is no longer read; its files stay."""
        self.spark.sql(f"alter table {self.name} drop if exists partition (part = {part})")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, by: str) -> DataFrame:
    """``df`` partitioned as a table that is bucketed by the column, which a join on it keeps."""
    return df.repartition(partitions(df.sparkSession), by)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables of ``settled`` that nothing reads any more; a plan that still did would fail, not find fewer rows."""
    for t in tables:
        for path in _folders(t) if t is not None else ():
            spark, name = t.sparkSession, path.rpartition("/")[2]
            if spark.catalog.tableExists(name):
                spark.sql(f"drop table {name}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            files.delete(folder, True)
            files.mkdirs(folder)


def crc_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n: the split rule of the learned operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded_sample(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones for the same input, picked by a hash of ``key``.

    Only keys are sorted at first; the payload is fetched by a join with the bounded list of keys. Where keys repeat,
    the bound holds for the rows, smallest first."""
    place = F.xxhash64(F.lit("sample"), F.col(key))
    keys = labelled.select(key).distinct().orderBy(place, key).limit(rows).select(F.col(key).alias("_key"))
    found = labelled.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return found.orderBy(place, key, *[c for c in labelled.columns if c != key]).limit(rows)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores as needed, so that no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def result_schema(kept: DataFrame, added) -> StructType:
    """Schema of ``kept`` with the columns ``added`` (name, type), which must be new."""
    schema = StructType(list(kept.schema.fields))
    for name, kind in added:
        if unused(kept, name) != name:
            raise ValueError(f"column {name} is there already: name the results otherwise")
        schema = schema.add(name, kind)
    return schema


def text_blocks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = BLOCK_BYTES):
    """(first row, row after the last, bytes, offsets) of runs of rows; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(buf: np.ndarray, offsets: np.ndarray):
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the document it is in."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {True: byte_codes(True), False: byte_codes(False)}
_POWERS_STEP = 256 << 10  # a worker keeps the powers, so only as many as its blocks need
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int):
    if len(_POWERS["up"]) < n:
        size = -(-(n - 1) // _POWERS_STEP) * _POWERS_STEP + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(buf: np.ndarray, lower: bool = True) -> np.ndarray:
    """Prefix sums of a polynomial of the bytes, from which hashes of spans are taken."""
    up, _ = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[lower][buf] * up[: len(buf)], out=sums[1:])
    return sums


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the bytes of each span, by prefix sums of a polynomial (``sums``, if they are at hand)."""
    sums = prefix_sums(buf, lower) if sums is None else sums
    _, down = _powers(len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def all_span_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of the span of ``width`` bytes at every place that has one."""
    _, down = _powers(len(sums))
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring values (len(hashes) - n + 1 of them)."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total = total * _BASE + hashes[k : k + len(total)]
    return mix(total)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = 5):
    """Distinct n-word shingle hashes of each document, sorted, as (values, offsets).

    A document of fewer words has its whole sequence as one shingle; one without words has none."""
    starts, ends, doc = words_of(buf, offsets)
    docs = len(offsets) - 1
    hashes = span_hashes(buf, starts, ends)
    count = np.bincount(doc, minlength=docs)
    begin = np.zeros(docs + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    rolled = window_hashes(hashes, n)
    owner = doc[: len(rolled)]
    whole = owner == doc[n - 1 :] if len(rolled) else np.zeros(0, bool)
    parts, owners = [rolled[whole]], [owner[whole]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = np.uint64(count[i])
        for h in hashes[begin[i] : begin[i + 1]]:
            own = np.uint64((int(own) * int(_BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        parts.append(mix(np.array([own], np.uint64)))
        owners.append(np.array([i]))
    values, owners = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[keep], owners[keep]
    out = np.zeros(docs + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=docs), out=out[1:])
    return values, out


#: Bits of a row of Spark's bitmap functions (4 KB).
_ROW_BITS = 32768


def bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """The bits of the numbers in the one column, modulo ``bits`` (a power of two), as bytes: of fixed size, whatever the input."""
    place = F.pmod(F.col(numbers.columns[0]).cast("long"), F.lit(bits))
    rows = numbers.select(place.alias("p")).groupBy((F.col("p") / _ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("p") % _ROW_BITS).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.coalesce(8).collect():  # at most bits / 32,768 rows, in one job and not one for each partition
        at = row["row"] * (_ROW_BITS // 8)
        out[at : at + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def packed_bits(*bitmaps: np.ndarray) -> list[bytes]:
    """Bitmaps as they are sent to tasks: few of their bits are set."""
    return [zlib.compress(b, 1) for b in bitmaps]


def unpacked_bits(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(b), np.uint8) for b in packed]


def has_bits(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit number is set."""
    place = numbers.view(np.int64) & np.int64(len(bitmap) * 8 - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected link table; component is the smallest reachable node.

    Alternates pointing every node to the smallest neighbour's label and shortcutting labels of
    labels. Each round is one pre-aggregated group-by, kept in the checkpoint folder."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("peer")).unionByName(
        links.select(F.col(b).alias("node"), F.col(a).alias("peer"))
    )
    edges = settled(both.where("node <> peer").distinct())
    label = settled(edges.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = edges.join(label.withColumnRenamed("node", "peer"), "peer").groupBy("node").agg(F.min("component").alias("near"))
        hop = label.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = (
            label.join(seen, "node", "left")
            .join(hop, "component", "left")
            .select("node", F.least("component", F.coalesce("near", "component"), F.coalesce("top", "component")).alias("component"), F.col("component").alias("old"))
        )
        new = settled(new)
        discard(label)
        label = new
        if label.where("component <> old").isEmpty():
            discard(edges)
            return label.select("node", "component")


def one_per_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` without null keys and with one row per key.

    Keys are usually distinct, which a scan of that column alone shows; only otherwise are rows
    grouped: of rows that share a key the one with the smallest text stays (null before text)."""
    rows = df.where(F.col(key).isNotNull())
    if rows.groupBy(key).count().where("count > 1").limit(1).count() == 0:
        return rows
    others = [c for c in rows.columns if c != key]
    first = F.min(F.struct(*[F.col(c) for c in (["text"] if "text" in others else []) + [c for c in others if c != "text"]])).alias("r")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"r.{c}").alias(c) for c in others])
