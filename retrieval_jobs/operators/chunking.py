"""Heading-aware chunking of Markdown.

Headings, parents and part numbers are scans over blocks of a document's lines and sections; long sections are cut each for
itself, and the short merge folds a document's sections in one row of the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrieval_jobs.functions.text import normalize_newlines
from retrieval_jobs.operators import segments
from retrieval_jobs.operators.segments import blocked, carried, earlier, totals, within

MAX_CHARS, MIN_CHARS, TITLE_CHARS = 2000, 500, 50
# Where long bodies are cut.
SEPARATORS = ("\n\n", "\n", " ", ",", "")
#: Finished sections that the merge keeps in one run.
RUN = 256


def split_headings(documents: DataFrame) -> DataFrame:
    """(doc_id, file_title, pos, level, title, body) of documents (doc_id, file_title, md).

    Headings have level 1 to 6 outside fences; fence lines vanish; the preamble stays unless empty; an empty document has no section.
    A document's lines are cut to blocks, each scanned in its row: it counts its headings for a start outside and inside a fence, and the
    scan over block totals says which holds. Body lines are joined in their block before they move to their section."""
    md = normalize_newlines(F.coalesce("md", F.lit("")))
    docs = documents.select("doc_id", "file_title", F.explode(F.array(F.split(md, "\n"))).alias("lines"))
    ranges = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / segments.ROWS).cast("int")), lambda b: F.struct(b.alias("_block"), F.slice("lines", b * segments.ROWS + 1, segments.ROWS).alias("lines")))
    blocks = docs.select("doc_id", "file_title", F.inline(ranges))
    level = lambda x: F.when(x.rlike(r"^\s*(```|~~~)"), 0).when(x.rlike(r"^\s*#{1,6}\s+.+"), F.length(F.regexp_extract(x, r"^\s*(#{1,6})\s", 1)))
    blocks = blocks.withColumn("lines", F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), level(x).alias("level"), x.alias("line"))))

    def step(state, x):
        head = F.array(F.struct(x["at"].alias("at"), x["level"].alias("level"), x["line"].alias("line"), (state["fences"] % 2).alias("inside")))
        return F.struct((state["fences"] + x["level"].eqNullSafe(0).cast("int")).alias("fences"), F.when(x["level"] > 0, F.concat(state["heads"], head)).otherwise(state["heads"]).alias("heads"))

    zero = F.struct(F.lit(0).alias("fences"), F.array().cast("array<struct<at:int,level:int,line:string,inside:int>>").alias("heads"))
    blocks = blocks.withColumn("scan", F.aggregate("lines", zero, step))
    heads = lambda start: F.filter("scan.heads", lambda h: h["inside"] == start)
    body = lambda first, end: F.transform(F.filter(F.slice("lines", first, end - first), lambda x: ~x["level"].eqNullSafe(0)), lambda x: x["line"])
    of = [F.col("scan.fences").alias("fences")]
    for start in (0, 1):
        lead = body(F.lit(1), F.coalesce(F.get(heads(start), 0)["at"], F.size("lines") + 1))
        of += [F.size(heads(start)).alias(f"heads{start}"), F.size(lead).alias(f"lead{start}"), F.length(F.array_join(lead, "")).alias(f"chars{start}")]
    before, whole = earlier(["doc_id"]), Window.partitionBy("doc_id")
    chosen = lambda name: F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    sums = blocks.select("doc_id", "_block", *of).withColumn("start", (F.coalesce(F.sum("fences").over(before), F.lit(0)) % 2).cast("int"))
    sums = sums.withColumn("earlier_heads", F.coalesce(F.sum(chosen("heads")).over(before), F.lit(0)))
    lead = lambda name: F.sum(F.when(F.col("earlier_heads") == 0, chosen(name))).over(whole)
    sums = sums.withColumn("preamble", ((lead("lead") > 1) | (lead("chars") > 0)).cast("int"))
    rows = carried(blocks, ["doc_id"], sums.select("doc_id", "_block", "start", "earlier_heads", "preamble"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(n)) for c, n in (("start", 0), ("earlier_heads", 0), ("preamble", 1))})
    rows = rows.select("doc_id", "file_title", "_block", "preamble", "earlier_heads", "lines", F.explode(F.array(heads(F.col("start")))).alias("heads"))

    def section(j):
        own, following = F.get("heads", j - 1), F.get("heads", j)
        text = body(F.coalesce(own["at"], F.lit(0)) + 1, F.coalesce(following["at"], F.size("lines") + 1))
        return F.struct(j.alias("no"), own["level"].alias("level"), own["line"].alias("title"), text.alias("text"))

    parts = rows.select("doc_id", "file_title", "_block", "preamble", "earlier_heads", F.inline(F.transform(F.sequence(F.lit(0), F.size("heads")), section)))
    parts = parts.select("doc_id", "file_title", "preamble", (F.col("earlier_heads") + F.col("no")).alias("section"), "_block", "level", "title", F.when(F.size("text") > 0, F.array_join("text", "\n")).alias("part"))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("_block", "part")))), lambda x: x["part"])
    keys = ["doc_id", "file_title", "section", "preamble"]
    sections = parts.groupBy(*keys).agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.coalesce(F.max("title"), F.lit("")).alias("title"), F.array_join(text, "\n").alias("body"))
    pos = (F.col("section") - 1 + F.col("preamble")).cast("int")
    return sections.where("title <> '' or body <> ''").select("doc_id", "file_title", pos.alias("pos"), "level", "title", "body")


def parent_titles(sections: DataFrame) -> DataFrame:
    """Adds parent_title: the nearest earlier heading of a smaller level, else the file title.

    The last heading of each level is kept within a block of sections and carried over blocks."""
    rows = blocked(sections, "pos")
    mine = {f"_last{k}": F.max(F.when(F.col("level") == k, F.struct("pos", "title"))) for k in range(1, 6)}
    blocks = totals(rows, ["doc_id"], **mine)
    blocks = blocks.select("doc_id", "_block", *[F.max(c).over(earlier(["doc_id"])).alias(f"{c}_before") for c in mine])
    rows = carried(rows.withColumns({c: last.over(within(["doc_id"], "pos", -1)) for c, last in mine.items()}), ["doc_id"], blocks)
    above = F.greatest(*[F.when(F.col("level") > k, F.coalesce(f"_last{k}", f"_last{k}_before")) for k in range(1, 6)])
    return rows.select(*sections.columns, F.coalesce(above["title"], F.col("file_title")).alias("parent_title"))


def split_text(text: str, limit: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the first separator of the list that occurs.

    Pieces short enough are packed greedily with the separator between them; longer ones are cut with the separators
    that follow. Separators between pieces are dropped; pieces are stripped and blank ones dropped."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep = separators[at]
    out: list[str] = []
    pack: list[str] = []
    size = 0
    for piece in [p for p in (text.split(sep) if sep else text) if p]:
        if len(piece) >= limit and sep:
            out.append(sep.join(pack))
            pack, size = [], 0
            out += split_text(piece, limit, separators[at + 1 :])
            continue
        grown = size + len(piece) + (len(sep) if pack else 0)
        if pack and grown > limit:
            out.append(sep.join(pack))
            pack, grown = [], len(piece)
        pack.append(piece)
        size = grown
    out.append(sep.join(pack))
    return [p for p in (x.strip() for x in out) if p]


def split_long(sections: DataFrame, most: int, linearize: bool = False) -> DataFrame:
    """Sections whose title (cut to 50), blank line and body exceed ``most`` are replaced by their pieces, with ``part``; ``linearize`` turns tables to sentences before.

    Each section is cut for itself; only texts that are too long, or hold tables, leave the JVM."""
    from .tables import linearized

    head = F.substring("title", 1, TITLE_CHARS)
    room = most - F.length(head) - 2

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, rooms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, r) for t, r in zip(texts, rooms, strict=True)], dtype=object)

    rows = sections.withColumn("body", linearized(F.col("body"))) if linearize else sections
    long = (F.length("body") > room) & (room > 0)
    rows = rows.withColumn("_pieces", F.when(long, cut(F.when(long, F.col("body")), room)))
    whole = F.coalesce(F.size("_pieces"), F.lit(0)) < 2
    rows = rows.select("*", F.posexplode(F.when(whole, F.array("body")).otherwise(F.col("_pieces"))).alias("_piece", "_text"))
    number = F.when(~whole, F.col("_piece") + 1)
    return rows.withColumns({"part": number, "title": F.when(whole, F.col("title")).otherwise(F.concat(head, F.lit("-"), number.cast("string"))), "body": F.col("_text")}).drop("_pieces", "_text")


def merge_short(sections: DataFrame, least: int) -> DataFrame:
    """While the parent is the same and the current body is below ``least``, the next body is appended; the title becomes the parent's, part 0. Renews pos.

    Sections (doc_id, file_title, pos, _piece, title, body, parent_title, part) are folded as one array a document; those done are
    kept in runs of ``RUN``, so that a step does not copy all of them."""
    kept = ("title", "body", "parent_title", "part")
    kind = "struct<title:string,body:string,parent_title:string,part:int>"
    docs = sections.groupBy("doc_id", "file_title").agg(F.array_sort(F.collect_list(F.struct("pos", "_piece", *kept))).alias("s"))

    def step(state, x):
        last = state["last"]
        joins = last.isNotNull() & last["parent_title"].eqNullSafe(x["parent_title"]) & (F.length(last["body"]) < least)
        body = F.concat(F.regexp_replace(last["body"], r"(?U)\s+\z", ""), F.lit("\n\n"), F.regexp_replace(x["body"], r"(?U)\A\s+", ""))
        merged = F.struct(x["parent_title"].alias("title"), body.alias("body"), x["parent_title"].alias("parent_title"), F.lit(0).alias("part"))
        closes = last.isNotNull() & ~joins
        full = closes & (F.size(state["run"]) >= RUN)
        done = F.when(full, F.concat(state["done"], F.array(state["run"]))).otherwise(state["done"])
        run = F.when(full, F.array(last)).when(closes, F.concat(state["run"], F.array(last))).otherwise(state["run"])
        return F.struct(done.alias("done"), run.alias("run"), F.when(joins, merged).otherwise(F.struct(*[x[c].alias(c) for c in kept])).alias("last"))

    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("run"), F.lit(None).cast(kind).alias("last"))
    end = lambda state: F.concat(F.flatten(state["done"]), state["run"], F.array(state["last"]))
    folded = docs.select("doc_id", "file_title", F.posexplode(F.aggregate("s", start, step, end)).alias("pos", "x"))
    return folded.select("doc_id", "file_title", "pos", *[f"x.{c}" for c in kept])


def size_sections(sections: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS, linearize: bool = False) -> DataFrame:
    """Long split, then short merge, of sections (doc_id, file_title, pos, title, body, parent_title); adds part and renews pos."""
    if not (most > least > 0):
        raise ValueError("limits must be positive and the largest above the least")
    return merge_short(split_long(sections, most, linearize), least)


def number_parts(sections: DataFrame) -> DataFrame:
    """Sections with ``part`` are renumbered from 1 per parent title, in document order, and their titles get the number.

    Blocks of sections count for themselves; what earlier blocks hold of a parent is added."""
    keys = ["doc_id", "parent_title"]
    rows = blocked(sections, "pos")
    some = F.col("part").isNotNull()
    blocks = totals(rows, keys, _n=F.count_if(some))
    blocks = blocks.select(*keys, "_block", F.sum("_n").over(earlier(keys)).alias("_before"))
    rows = carried(rows.withColumn("_own", F.count_if(some).over(within(keys, "pos"))), keys, blocks)
    rows = rows.withColumn("part", F.when(some, F.col("_own") + F.coalesce("_before", F.lit(0))).cast("int"))
    titled = F.when(some, F.concat("title", F.lit("-"), F.col("part").cast("string"))).otherwise(F.col("title"))
    return rows.withColumn("title", titled).select(*sections.columns)


def assemble_chunks(sections: DataFrame) -> DataFrame:
    """Chunks: content is title, blank line, body; chunk_id is a hash of document and position."""
    content = F.concat("title", F.lit("\n\n"), "body")
    return sections.select(F.xxhash64("doc_id", "file_title", "pos").alias("chunk_id"), "doc_id", "pos", "title", "parent_title", "file_title", content.alias("content"), "part")


def chunk_documents(documents: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS, linearize: bool = True) -> DataFrame:
    """documents (doc_id, file_title, md) to chunks."""
    sections = parent_titles(split_headings(documents))
    return assemble_chunks(number_parts(size_sections(sections, most, least, linearize)))
