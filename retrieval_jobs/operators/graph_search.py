"""From question entities to graph seeds, triples, weighted nodes and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrieval_jobs.functions.text import filled

from .vectors import top_per

SEED_WEIGHT, NEAR_WEIGHT = 2.0, 1.0
PAIR = ["query_id", "item_name"]
#: Nodes that are sent to the edges; beyond that both are shuffled.
BROADCAST_NODES = 50_000


def best_per_item(asked: DataFrame, hits: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The best hit of each asked (query_id, ext_pos, entity, item_name), with ``reason`` where none reaches ``min_score``.

    hits: (query_id, entity, item_name, entity_name, score)."""
    key = ["query_id", "entity", "item_name"]
    best = top_per(hits, key, [F.desc("score"), F.col("entity_name")], 1).select(*key, "entity_name", "score")
    rows = asked.join(best, key, "left")
    good = F.col("score") >= min_score
    reason = F.when(F.col("score").isNull(), "no hit").when(~good, "below minimum")
    return rows.select("query_id", "ext_pos", "entity", "item_name", F.when(good, F.col("entity_name")).alias("aligned"), F.when(good, F.col("score")).alias("score"), reason.alias("reason"))


def item_entity_pairs(aligned: DataFrame) -> DataFrame:
    """(query_id, pos, item_name, entity): distinct aligned pairs in order; blanks drop."""
    rows = aligned.select("query_id", "ext_pos", filled(F.col("item_name")).alias("item_name"), filled(F.col("aligned")).alias("entity")).where("item_name is not null and entity is not null")
    first = rows.groupBy("query_id", "item_name", "entity").agg(F.min("ext_pos").alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "item_name", "entity"))).select("query_id", "pos", "item_name", "entity")


def grams(text: Column, n: Column) -> Column:
    """The distinct runs of ``n`` characters of a text; the empty run for n = 0."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def name_index(nodes: DataFrame) -> DataFrame:
    """(item_name, gram, name): inverted index of lower-cased names by their runs of 0 to 3 characters."""
    low = F.lower("name")
    every = F.flatten(F.array(*[F.when(F.length(low) >= n, grams(low, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(4)]))
    return nodes.select("item_name", "name").distinct().select("item_name", F.explode(every).alias("gram"), "name")


def find_containing(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, pos, item_name, name): the names of the item that contain each pair's entity, in any case.

    A name that contains the entity has all its runs of 3 characters (of fewer, if it is shorter), so that only the names under the rarest of them are compared;
    an entity with a run that no name has is dropped before."""
    low = F.lower("entity")
    asked = pairs.select("query_id", "pos", "item_name", low.alias("low"), F.explode(grams(low, F.least(F.length(low), F.lit(3)))).alias("gram"))
    sizes = index.groupBy("item_name", "gram").agg(F.count("*").alias("names"))
    rarest = asked.join(sizes, ["item_name", "gram"], "left").groupBy("query_id", "pos", "item_name", "low").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("r"))
    rarest = rarest.where("r.names > 0").select("query_id", "pos", "item_name", "low", "r.gram")
    return rarest.join(index, ["item_name", "gram"]).where(F.contains(F.lower("name"), F.col("low"))).select("query_id", "pos", "item_name", "name")


def find_seeds(pairs: DataFrame, nodes: DataFrame, k: int = 3, total: int = 30) -> DataFrame:
    """(query_id, seed_no, item_name, name): the exact node of each pair, else up to ``k`` whose name contains the entity in any case; at most ``total`` per question.

    Entities that many questions ask for are looked for once."""
    keys = nodes.select("item_name", "name").distinct()
    exact = pairs.join(keys.withColumn("entity", F.col("name")), ["item_name", "entity"]).select("query_id", "pos", "item_name", "name")
    rest = pairs.join(keys.select("item_name", F.col("name").alias("entity")), ["item_name", "entity"], "left_anti")
    asked = rest.select("item_name", "entity").distinct().select(F.struct("item_name", "entity").alias("query_id"), F.lit(0).alias("pos"), "item_name", "entity")
    like = top_per(find_containing(asked, name_index(nodes)), ["query_id", "pos"], [F.col("name")], k).select("query_id.item_name", "query_id.entity", "name")
    like = rest.join(like, ["item_name", "entity"]).select("query_id", "pos", "item_name", "name")
    both = exact.unionByName(like).groupBy("query_id", "item_name", "name").agg(F.min("pos").alias("pos"))
    return top_per(both, ["query_id"], [F.col("pos"), F.col("name")], total, "seed_no").select("query_id", "seed_no", "item_name", "name")


def leads(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds of the leads alone, and (query_id, lead) of every question: its lead is the least question with the same seeds.

    Triples, weights and chunks follow from the seeds, so that they are found once for each lead; ``of_members`` gives them to all."""
    lists = seeds.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seed_no", "item_name", "name"))).alias("same"))
    first = lists.groupBy("same").agg(F.min("query_id").alias("lead"))
    return seeds.join(first.select(F.col("lead").alias("query_id")), "query_id", "left_semi"), lists.join(first, "same").select("query_id", "lead")


def of_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for the leads, for each of their questions."""
    return rows.withColumnRenamed("query_id", "lead").join(members, "lead").select(*rows.columns)


def one_hop(seeds: DataFrame, edges: DataFrame, per_seed: int = 100, total: int = 100) -> DataFrame:
    """(query_id, no, item_name, head, rel, tail): edges at either end of a seed, MENTIONED_IN excepted, in their own direction, once each.

    A node's first ``per_seed`` edges are taken before they meet the questions, so that no question meets more than those; repeated edges count once."""
    e = edges.where("type <> 'MENTIONED_IN'").select("item_name", "head", F.col("type").alias("rel"), "tail")
    asked = seeds.select("item_name", "name").distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_NODES else asked
    near = e.withColumn("name", F.explode(F.array_distinct(F.array("head", "tail")))).join(asked, ["item_name", "name"], "left_semi")
    rank = F.dense_rank().over(Window.partitionBy("item_name", "name").orderBy("rel", "head", "tail"))
    capped = near.withColumn("rank", rank).where(F.col("rank") <= per_seed).distinct()
    return dedupe_triples(seeds.join(capped, ["item_name", "name"]), total)


def dedupe_triples(triples: DataFrame, total: int = 100) -> DataFrame:
    """Distinct (item, head, rel, tail) per question by first appearance (seed_no, rank), at most ``total``."""
    first = triples.groupBy("query_id", "item_name", "head", "rel", "tail").agg(F.min(F.struct("seed_no", "rank")).alias("first"))
    return top_per(first, ["query_id"], [F.col("first"), F.col("rel"), F.col("head"), F.col("tail")], total, "no").select("query_id", "no", "item_name", "head", "rel", "tail")


def node_weights(seeds: DataFrame, triples: DataFrame) -> DataFrame:
    """(query_id, item_name, name, weight): seeds 2, other ends of triples 1; nothing for a question without triples."""
    ends = triples.select(*PAIR, F.explode(F.array("head", "tail")).alias("name"), F.lit(NEAR_WEIGHT).alias("weight"))
    rows = seeds.select(*PAIR, "name", F.lit(SEED_WEIGHT).alias("weight")).unionByName(ends)
    rows = rows.groupBy(*PAIR, "name").agg(F.max("weight").alias("weight"))
    return rows.join(triples.select("query_id").distinct(), "query_id", "left_semi")


def lookup_chunks(weights: DataFrame, mentions: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, rank, item_name, chunk_id, score, hits): chunks by summed weight, count, then id as text, all descending.

    Chunks of an item that mention the same names score alike for every question: each such kind of chunk is scored once, and its last ``limit`` ids stand for it.
    Repeated mentions count once."""
    met = mentions.select("item_name", F.col("chunk_id").cast("string").alias("chunk_id"), "name").repartition("item_name", "chunk_id")
    kinds = met.groupBy("item_name", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    kinds = top_per(kinds, ["item_name", "names"], [F.desc("chunk_id")], limit, "_n")
    scored = kinds.where("_n = 1").select("item_name", "names", F.explode("names").alias("name")).join(weights, ["item_name", "name"])
    scored = scored.groupBy("query_id", "item_name", "names").agg(F.sum("weight").alias("score"), F.count("*").alias("hits"))
    rows = scored.join(kinds, ["item_name", "names"])
    return top_per(rows, ["query_id"], [F.desc("score"), F.desc("hits"), F.desc("chunk_id")], limit).select("query_id", "rank", "item_name", "chunk_id", "score", "hits")


def graph_leg(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, mentions: DataFrame, limit: int = 100, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Pairs to ranked chunks: seeds, one hop, weights, mentions. ``keep`` may store the seeds, which are read several times."""
    own, members = leads(keep(find_seeds(pairs, nodes)))
    return of_members(lookup_chunks(node_weights(own, one_hop(own, edges)), mentions, limit), members)
