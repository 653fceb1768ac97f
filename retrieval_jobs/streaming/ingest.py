"""Continuous import: files that arrive in a folder become chunks, entities, nodes, edges and mentions that replace their item's rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retrieval_jobs.operators import graph_build
from retrieval_jobs.operators.chunking import chunk_documents
from retrieval_jobs.operators.models import embed, hashed_encoder
from retrieval_jobs.sources import versions
from retrieval_jobs.sources.files import file_title

#: From (chunk_id, item_name, content, pos) to (chunk_id, item_name, pos, response), such as ``complete_once`` on a prompt.
Extract = Callable[[DataFrame], DataFrame]


def graph_tables(chunks: DataFrame, responses: DataFrame, encoder=hashed_encoder) -> dict[str, DataFrame]:
    """entities, nodes (with their states), edges and mentions of chunks and the responses for them. Each distinct name is embedded once."""
    parsed = graph_build.parse_responses(responses)
    entities, relations = graph_build.clean_entities(parsed), graph_build.clean_relations(parsed)
    states = graph_build.node_states(entities)
    rows = graph_build.entity_rows(entities, chunks)
    vectors = embed(rows.select("entity_name").distinct(), "entity_name", encoder)
    return {"entities": rows.join(vectors, "entity_name"), "nodes": states, "edges": graph_build.merge_edges(relations, states), "mentions": graph_build.merge_mentions(entities)}


def ingest_batch(documents: DataFrame, path: str, encoder=hashed_encoder, extract: Extract | None = None, batch: tuple[str, int] | None = None) -> bool:
    """Chunk and embed documents (doc_id, file_title, md), extract their graph where ``extract`` is given, and commit all tables at ``path`` in one step.

    The item is the file title; all rows of the documents' items are replaced, also where a document has no chunk or entity any more. A ``batch`` (writer, number)
    that was committed before changes nothing, so that a batch that was killed at any point and repeated leaves what one run leaves. Responses are written before
    they are used, so that nothing asks the model twice."""
    spark, work = documents.sparkSession, f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    if batch and versions.manifest(spark, path)["batches"].get(batch[0], -1) >= batch[1]:
        return False
    try:
        chunks = chunk_documents(documents).withColumn("item_name", F.col("file_title")).withColumn("chunk_id", F.xxhash64("doc_id", "pos"))
        tables = {"chunks": embed(chunks, "content", encoder)}
        if extract:
            asked = graph_build.valid_graph_chunks(chunks, F.col("file_title"))
            extract(asked).select("chunk_id", "item_name", "pos", "response").write.parquet(f"{work}/responses")
            tables |= graph_tables(asked, spark.read.parquet(f"{work}/responses"), encoder)
        items = documents.select(F.col("file_title").alias("item_name")).distinct()
        return versions.commit(spark, path, tables, "item", items=items, batch=batch)
    finally:
        versions._delete(spark, work)


def ingest_stream(spark: SparkSession, in_dir: str, table_path: str, checkpoint: str, encoder=hashed_encoder, extract: Extract | None = None, writer: str = "stream") -> StreamingQuery:
    """Import every new .md file of ``in_dir`` and stop when all are done.

    The checkpoint numbers the batches, and the tables remember the last number of each ``writer``: each file is imported once."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(in_dir)
    docs = files.select(F.col("value").alias("md"), F.col("_metadata.file_path").alias("path"))
    docs = docs.select(F.xxhash64("path").alias("doc_id"), file_title(F.col("path")).alias("file_title"), "md")
    run = lambda df, number: ingest_batch(df, table_path, encoder, extract, (writer, number))
    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
