"""What searches shuffle grows with their tables, not with questions times rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retrieval_jobs.operators import fusion, graph_search, vectors
from retrieval_jobs.plans import queries


@pytest.fixture
def ranked(monkeypatch):
    """The numbers of rows that windows of the searches rank within questions."""
    counts, plain = [], vectors.top_per

    def counted(df, keys, *rest):
        if "query_id" in keys:
            counts.append(df.count())
        return plain(df, keys, *rest)

    for module in (graph_search, vectors):
        monkeypatch.setattr(module, "top_per", counted)
    return counts


def crowd(spark):
    """A node with 300 edges and 40 questions for it."""
    seeds = spark.range(40).select(F.col("id").alias("query_id"), F.lit(1).alias("seed_no"), F.lit("X").alias("item_name"), F.lit("hub").alias("name"))
    edges = spark.range(300).select(F.lit("X").alias("item_name"), F.lit("hub").alias("head"), F.lit("HAS_PART").alias("type"), F.format_string("t%03d", "id").alias("tail"))
    return seeds, edges


def test_a_node_meets_questions_with_its_first_edges_only(spark, ranked):
    seeds, edges = crowd(spark)
    repeated = edges.unionByName(edges).unionByName(edges)
    got = graph_search.one_hop(seeds, repeated, per_seed=10, total=7)
    assert max(ranked) <= 40 * 10
    assert sorted((r.query_id, r.no, r.tail) for r in got.collect()) == [(q, n + 1, f"t{n:03d}") for q in range(40) for n in range(7)]


def test_chunks_of_the_same_names_are_scored_once(spark, ranked):
    mentions = spark.range(900).select(F.lit("X").alias("item_name"), F.explode(F.array(F.lit("hub"), F.when(F.col("id") % 3 == 0, "odd"))).alias("name"), F.col("id").alias("chunk_id")).where("name is not null")
    weights = spark.createDataFrame([(q, "X", name, weight) for q in range(40) for name, weight in (("hub", 2.0), ("odd", 1.0))], "query_id long, item_name string, name string, weight double")
    got = graph_search.lookup_chunks(weights, mentions.unionByName(mentions), 310).collect()
    assert max(ranked) <= 40 * 2 * 310
    both, one = (sorted((str(i) for i in range(900) if (i % 3 == 0) == kind), reverse=True) for kind in (True, False))
    want = [(3.0, 2, c) for c in both] + [(2.0, 1, c) for c in one][:10]
    for q in (0, 39):
        assert [(r.score, r.hits, r.chunk_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == q] == want


def test_questions_with_the_same_seeds_share_their_answer(spark):
    seeds, edges = crowd(spark)
    more = spark.createDataFrame([(50, 1, "X", "t001"), (50, 2, "X", "hub"), (51, 1, "X", "hub"), (51, 2, "X", "t001"), (52, 1, "X", "gone")], seeds.schema)
    seeds = seeds.unionByName(more)
    own, members = graph_search.leads(seeds)
    assert sorted({r.query_id for r in own.collect()}) == [0, 50, 51, 52]
    one_by_one = sorted(map(str, graph_search.node_weights(seeds, graph_search.one_hop(seeds, edges)).collect()))
    shared = graph_search.of_members(graph_search.node_weights(own, graph_search.one_hop(own, edges)), members)
    assert sorted(map(str, shared.collect())) == one_by_one and len(one_by_one) == 42 * 101


def test_an_entity_asked_for_often_is_looked_for_once(spark, ranked):
    nodes = spark.range(100).select(F.lit("X").alias("item_name"), F.format_string("node %03d", "id").alias("name"))
    pairs = spark.range(50).select(F.col("id").alias("query_id"), F.lit(1).alias("pos"), F.lit("X").alias("item_name"), F.lit("NODE").alias("entity"))
    got = graph_search.find_seeds(pairs, nodes).collect()
    assert max(ranked) <= 50 * 3
    assert sorted((r.query_id, r.seed_no, r.name) for r in got) == [(q, n + 1, f"node {n:03d}") for q in range(50) for n in range(3)]


@pytest.mark.parametrize("name", ["j5_lookup_chunks", "j4_one_hop_a7_dedupe_triples", "a8_node_weights", "t13_triples_to_text"])
def test_graph_queries_about_a_common_node(spark, tmp_path, ranked, name):
    """Three names of one brand, 30 questions for them, 500 order lines each: no question is ranked against all lines."""
    part = spark.range(0, 1800, 20).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n"), (F.col("id") / 20 % 3).cast("int").cast("string"), F.lit(" x")).alias("p_name"), F.lit("B").alias("p_brand"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(1500).select(F.col("id").alias("l_orderkey"), (F.col("id") % 90 * 20).alias("l_partkey"), (F.col("id") % 700).alias("l_suppkey"), F.lit("N").alias("l_returnflag"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() > 1000
    assert max(ranked) <= 3 * 3 * 100 + 90 * 3


@pytest.mark.parametrize("name", ["p10_decide_route", "a6_item_entity_pairs", "a11_filter_confirmed", "a5_best_per_item"])
def test_matches_make_no_row_for_a_pair(spark, tmp_path, ranked, name):
    """2,000 vectors of one label, of which 100 ask: with rows for pairs, 199,900 would be ranked."""
    cells = np.random.default_rng(5).normal(size=(2000, 8)).round(3).astype("float32")
    cells[20:29] = cells[20]  # a question with more equals than it may name
    spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(cells)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() > 50
    assert max(ranked) <= 100 * 20
    got = [(r.query_id, r.entity_name, r.score) for r in queries._matches(spark, str(tmp_path)).collect()]
    unit = cells.astype(float) / np.sqrt((cells.astype(float) ** 2).sum(1))[:, None]
    want = [(q, c, -s) for q in range(0, 2000, 20) for s, c in sorted((-round(x, 6), str(i)) for i, x in enumerate(unit @ unit[q]) if i != q)[:5]]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("item", [None, "item_name"])
def test_sparse_search_makes_no_row_for_a_posting(spark, ranked, item):
    """40 questions and 4,000 chunks that all have the same word; the first chunks of the best win."""
    chunks = spark.range(4000).select(F.col("id").alias("chunk_id"), F.lit("X").alias("item_name"), F.create_map(F.lit("common"), F.when(F.col("id") < 3990, 1.0).otherwise(2.0)).alias("sparse"))
    asks = spark.range(40).select(F.col("id").alias("query_id"), F.lit("X").alias("item_name"), F.create_map(F.lit("common"), F.lit(1.0), F.lit("rare"), F.lit(9.0)).alias("q_sparse"))
    got = [(r.query_id, r["rank"], r.chunk_id, r.score) for r in vectors.sparse_topk(asks, chunks, 12, item).collect()]
    assert max(ranked) <= 40 * 12 * 2 * 8
    assert sorted(got) == [(q, n + 1, c, s) for q in range(40) for n, (c, s) in enumerate([(i, 2.0) for i in range(3990, 4000)] + [(0, 1.0), (1, 1.0)])]


@pytest.mark.parametrize(("heavy", "at_once"), [(0, 3), (2, 7), (512, 1 << 20)])
def test_products_of_blocks(monkeypatch, heavy, at_once):
    monkeypatch.setattr(vectors, "HEAVY", heavy)
    monkeypatch.setattr(vectors, "AT_ONCE", at_once)
    r = random.Random(7)
    for least in (-2, 1):
        maps = [[{f"w{w}": float(r.randint(least, 3)) for w in r.sample(range(30), r.randint(1, 9))} for _ in range(n)] for n in (6, 15)]
        blocks = []
        for part in maps:
            words = sorted({w for m in part for w in m})
            entries = [(words.index(w), x) for m in part for w, x in m.items()]
            starts = np.cumsum([0, *map(len, part)])
            blocks.append([pa.array(starts, pa.int32()), pa.array(words), pa.array([e[0] for e in entries], pa.int32()), pa.array([e[1] for e in entries])])
        want = [[sum(x * c[w] for w, x in q.items() if w in c) if set(q) & set(c) else -np.inf for c in maps[1]] for q in maps[0]]
        assert (vectors._sparse_scores(*blocks) == np.array(want)).all()


@pytest.mark.parametrize("name", ["c1_union_legs_a9_rrf", "w2_cliff_cut", "answer_context", "k1_rerank_u2_score_pairs"])
def test_texts_are_not_fused(spark, sf_dir, monkeypatch, name):
    """The legs are told whether a chunk has a text; the text itself would be shuffled for each leg."""
    seen, plain = [], fusion.union_legs

    def watched(legs):
        seen.extend(legs.values())
        return plain(legs)

    monkeypatch.setattr(fusion, "union_legs", watched)
    queries.QUERIES[name](spark, sf_dir)
    assert len(seen) == 3 and all({r.content for r in leg.select("content").distinct().collect()} == {""} for leg in seen)
