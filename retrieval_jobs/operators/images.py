"""Image references of Markdown documents: context, use, and rewriting."""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrieval_jobs.functions.text import object_url

REFERENCE = r"!\[[^\]\n]*\]\(([^)\n]*)\)"


def image_references(documents: DataFrame) -> DataFrame:
    """(doc_id, ref_no, path) of every image reference, in order."""
    refs = F.regexp_extract_all("md", F.lit(REFERENCE), F.lit(1))
    return documents.select("doc_id", F.posexplode(refs).alias("ref_no", "path"))


def split_image_use(images: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images (doc_id, image_name) that their document refers to (the name occurs in a path), and those it doesn't."""
    refs = image_references(documents)
    used = images.join(refs, "doc_id").where(F.contains("path", "image_name")).select("doc_id", "image_name").distinct()
    return images.join(used, ["doc_id", "image_name"], "left_semi"), images.join(used, ["doc_id", "image_name"], "left_anti")


def is_heading(line: str) -> bool:
    level = len(line) - len(line.lstrip("#"))
    return 1 <= level <= 6 and line[level : level + 1].isspace()


def paragraphs(lines: list[str]) -> list[str]:
    """Runs of lines between blank lines and lines that are images."""
    parts = lambda line: not (bare := line.strip()) or (bare.startswith("![") and bare.endswith(")") and re.search(REFERENCE, bare) is not None)
    return ["\n".join(run) for apart, run in itertools.groupby(lines, parts) if not apart]


def nearest(parts: list[str], chars: int) -> list[str]:
    """Whole paragraphs while their length stays within ``chars``; the first always."""
    within = sum(total <= chars for total in itertools.accumulate(map(len, parts)))
    return parts[: max(1, within)]


def context_of(md: str, image: str, chars: int) -> tuple[str, str, str] | None:
    """Heading above, text before and text after the first reference to an image, within its section."""
    lines = md.split("\n")
    shows = [i for i, line in enumerate(lines) if any(image in path for path in re.findall(REFERENCE, line))]
    if not shows:
        return None
    heads = [i for i, line in enumerate(lines) if is_heading(line)]
    k = bisect.bisect_left(heads, shows[0])
    top, end = heads[k - 1] if k else -1, next((h for h in heads[k:] if h > shows[0]), len(lines))
    before = nearest(paragraphs(lines[top + 1 : shows[0]])[::-1], chars)[::-1]
    return lines[top] if top >= 0 else "", "\n\n".join(before), "\n\n".join(nearest(paragraphs(lines[shows[0] + 1 : end]), chars))


def image_context(documents: DataFrame, images: DataFrame, chars: int = 200) -> DataFrame:
    """(doc_id, image_name, heading, before, after) for each image that its document refers to."""
    names = images.groupBy("doc_id").agg(F.array_sort(F.collect_set("image_name")).alias("names"))

    def run(batches):
        for pdf in batches:
            rows = [(d, n, *c) for d, md, names in zip(pdf["doc_id"], pdf["md"], pdf["names"], strict=True) for n in names if (c := context_of(md or "", n, chars))]
            yield pd.DataFrame(rows, columns=["doc_id", "image_name", "heading", "before", "after"])

    return documents.join(names, "doc_id").select("doc_id", "md", "names").mapInPandas(run, "doc_id long, image_name string, heading string, before string, after string")


def attach_summaries(refs: DataFrame, summaries: DataFrame, endpoint: str, bucket: str) -> DataFrame:
    """(doc_id, refs: array of (name, summary, url)) of images (doc_id, file_title, image_name) with a summary (doc_id, image_name, summary)."""
    rows = refs.join(summaries, ["doc_id", "image_name"])
    entry = F.struct(F.col("image_name").alias("name"), "summary", object_url(F.col("file_title"), F.col("image_name"), endpoint, bucket).alias("url"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("refs"))


def rewrite_images(documents: DataFrame, refs: DataFrame) -> DataFrame:
    """``md`` with each reference to an image replaced by its summary and address, one image after another, in any case; the name may be part of a path."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, entries: pd.Series) -> pd.Series:
        out = []
        for md, items in zip(texts, entries, strict=True):
            for e in items if items is not None and md is not None else []:
                new, name = f"![{e['summary']}]({e['url']})", e["name"].lower()
                md = re.sub(REFERENCE, lambda m, new=new, name=name: new if name in m[1].lower() else m[0], md) if e["url"] else md
            out.append(md)
        return pd.Series(out)

    rows = documents.join(refs, "doc_id", "left")
    return rows.withColumn("md", F.when(F.col("refs").isNotNull(), run("md", F.coalesce("refs", F.array().cast(refs.schema["refs"].dataType)))).otherwise(F.col("md"))).drop("refs")
