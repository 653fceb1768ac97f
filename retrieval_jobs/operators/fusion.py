"""Reciprocal-rank fusion, reranking and the score-cliff cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieval_jobs.functions.text import filled

from .vectors import DIGITS, top_per

#: Weights of the legs: vector, hypothetical document, graph.
LEGS = (("vector", 1.0), ("hyde", 1.0), ("graph", 0.7))


def union_legs(legs: dict[str, DataFrame], weights: tuple[tuple[str, float], ...] = LEGS) -> DataFrame:
    """One table of all legs' rows (query_id, rank, chunk_id, ...) with leg, leg_no and weight; rows without a content drop and ranks close up."""
    out = None
    for no, (leg, weight) in enumerate(weights):
        if leg not in legs:
            continue
        rows = legs[leg].where("content is not null")
        by = Window.partitionBy("query_id").orderBy("rank")
        rows = rows.withColumn("rank", F.row_number().over(by)).withColumns({"leg": F.lit(leg), "leg_no": F.lit(no), "weight": F.lit(weight)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def rrf(legs: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """Sum of weight / (k + rank) per chunk; ties by first appearance (leg, rank); blank ids are skipped but keep their rank."""
    rows = legs.where(filled(F.col("chunk_id").cast("string")).isNotNull())
    score = F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), DIGITS).alias("score")
    first = F.min(F.struct("leg_no", "rank")).alias("first")
    fused = rows.groupBy("query_id", "chunk_id").agg(score, first)
    out = top_per(fused, ["query_id"], [F.desc("score"), F.col("first"), F.col("chunk_id")], top)
    return out.select("query_id", "chunk_id", "score", "rank")


def merge_sources(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local chunks (query_id, pos, chunk_id, title, content), then web texts (query_id, pos, url, title, content); blank contents drop."""
    rows = local.withColumns({"source": F.lit("local"), "_leg": F.lit(0)}).unionByName(web.withColumns({"source": F.lit("web"), "_leg": F.lit(1)}), allowMissingColumns=True)
    rows = rows.withColumn("content", filled(F.col("content"))).where("content is not null")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_leg", "pos"))).drop("_leg")


def words(c: Column) -> Column:
    """Distinct lower-cased words (runs of a-z, 0-9)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def overlap_score(query: Column, text: Column) -> Column:
    """Default relevance: share of the question's words that the text has."""
    q = words(query)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, words(text))) / F.size(q), DIGITS)).otherwise(F.lit(0.0))


def score_pairs(df: DataFrame, scorer=None, query: str = "query", text: str = "content") -> DataFrame:
    """``df`` with ``score`` for each (query, text): the word overlap, or a batch scorer built once per worker.

    ``scorer``: a function without arguments that returns f(list of (query, text)) -> list of floats."""
    if scorer is None:
        return df.withColumn("score", overlap_score(F.col(query), F.col(text)))
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        f = scorer()
        for pdf in batches:
            yield pdf.assign(score=[float(x) for x in f(list(zip(pdf[query], pdf[text], strict=True)))])

    return df.mapInPandas(run, schema)


def rerank(docs: DataFrame, scorer=None) -> DataFrame:
    """Documents (query_id, query, pos, content, ...) by score, ties by position; adds score and rank."""
    by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "pos")
    return score_pairs(docs, scorer).withColumn("rank", F.row_number().over(by))


def cliff_cut(ranked: DataFrame, most: int = 10, least: int = 3, gap_abs: float = 0.5, gap_ratio: float = 0.25) -> DataFrame:
    """From position ``least`` on, cut after the first gap to the next score that is large in itself or as a share; keep at most ``most``."""
    by = Window.partitionBy("query_id").orderBy("rank")
    following = F.lead("score").over(by)
    gap = F.col("score") - following
    steep = (gap >= gap_abs) | (gap / (F.abs("score") + 1e-6) >= gap_ratio)
    rows = ranked.where(F.col("rank") <= most).withColumn("_cut", F.when((F.col("rank") >= least) & steep, F.col("rank")))
    rows = rows.withColumn("_cut", F.min("_cut").over(Window.partitionBy("query_id")))
    return rows.where(F.col("_cut").isNull() | (F.col("rank") <= F.col("_cut"))).drop("_cut")
