"""Files and tables: Markdown, layout JSON, images, chunk and item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retrieval_jobs.functions.text import filled

from . import versions

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "webp", "bmp")  # fixed values; compared as written


def file_title(path: Column) -> Column:
    """The stem of a file's address, decoded."""
    return F.url_decode(F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_title, path, md) of the .md files below a folder; the title is the file's stem."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("value").alias("md"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.xxhash64("path").alias("doc_id"), file_title(F.col("path")).alias("file_title"), "path", "md")


def route_by_type(files: DataFrame, out_dir: str = "converted") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (path) by lower-cased suffix: Markdown, PDF (with the path of its Markdown), rejected."""
    rows = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    pdf = rows.where("suffix = 'pdf'").withColumn("md_path", F.concat_ws("/", F.lit(out_dir), "stem", F.concat("stem", F.lit(".md"))))
    return rows.where("suffix = 'md'"), pdf, rows.where("suffix not in ('md', 'pdf')")


def flatten_layout_json(df: DataFrame, column: str = "json") -> DataFrame:
    """(id columns, block_no, text) of layout JSON, flat or nested by page.

    A block's text is the first that is not blank of: content as a string; its paragraph_content contents joined by a space; its
    content; its table_body; the block's text. Blocks without a text drop."""
    top = F.try_parse_json(F.col(column)).cast("array<variant>")
    pages = F.transform(top, lambda p: F.coalesce(F.expr("null").cast("array<variant>"), F.try_variant_get(p, "$", "array<variant>"), F.array(p)))
    rows = df.select(*[c for c in df.columns if c != column], F.posexplode(F.flatten(pages)).alias("block_no", "b"))
    get = lambda path, kind="string": F.try_variant_get(F.col("b"), path, kind)
    spans = F.array_join(F.filter(F.transform(get("$.content.paragraph_content", "array<variant>"), lambda v: F.try_variant_get(v, "$.content", "string")), lambda x: x.isNotNull()), " ")
    plain = F.when(~F.startswith(F.coalesce(get("$.content"), F.lit("")), F.lit("{")), get("$.content"))
    text = F.coalesce(filled(plain), filled(spans), filled(get("$.content.content")), filled(get("$.content.table_body")), filled(get("$.text")))
    return rows.withColumn("text", text).drop("b").where("text is not null")


def list_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, image_name) of the image files of a folder; the bytes are never read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*suffixes)).withColumn("image_name", F.regexp_extract("path", r"([^/]+)$", 1))


def write_chunks(df: DataFrame, path: str, mode: str = "item", key: str = "item_name") -> None:
    """Chunks into the table "chunks" of the versioned tables at ``path``, in one step.

    ``item``: rows of the incoming items are replaced, the others of their buckets kept; ``full``: the table is replaced; ``append``: rows are added."""
    versions.commit(df.sparkSession, path, {"chunks": df}, mode, key)


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    return versions.read_table(spark, path, "chunks")


def append_item_names(df: DataFrame, path: str) -> None:
    """Append (file_title, item_name, dense, sparse) rows that have both vectors."""
    df.where((F.size("dense") > 0) & (F.size("sparse") > 0)).write.mode("append").parquet(path)
