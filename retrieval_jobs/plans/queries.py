"""The registered queries of the retrieval operators, each over whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrieval_jobs.functions import text as T
from retrieval_jobs.operators import chunking, fusion, graph_build, graph_search, images, items, models, prompts, tables, vectors
from retrieval_jobs.operators import history as hist
from retrieval_jobs.sources import files, versions

from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def digest(c: str):
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


# chunking


@query("p1_normalize_newlines", f"WITH {V.MARKDOWN} SELECT doc_id, md5(md) AS md_md5 FROM md")
def p1(spark, d):
    return V.markdown(spark, d).withColumn("md", T.normalize_newlines(F.col("md"))).select("doc_id", digest("md"))


@query("t1_split_headings", f"WITH {V.SECTIONS} SELECT doc_id, pos, level, title, md5(body) AS body_md5 FROM sections")
def t1(spark, d):
    return chunking.split_headings(V.markdown(spark, d)).select("doc_id", "pos", "level", "title", digest("body"))


@query("t2_parent_titles", f"WITH {V.SECTIONS} SELECT doc_id, pos, title, parent_title FROM sections")
def t2(spark, d):
    return chunking.parent_titles(chunking.split_headings(V.markdown(spark, d))).select("doc_id", "pos", "title", "parent_title")


@query("t3_split_long")
def t3(spark, d):
    sections = chunking.parent_titles(chunking.split_headings(V.markdown(spark, d)))
    return chunking.size_sections(sections, 300, 1).select("doc_id", "pos", "title", "parent_title", "part", F.length("body").alias("chars"), digest("body"))


MERGED = f"""WITH RECURSIVE {V.SECTIONS},
r AS (SELECT doc_id, pos, 0 AS g, body AS cur, parent_title, title, 1 AS n FROM sections WHERE pos = 0 UNION ALL
  SELECT s.doc_id, s.pos, CASE WHEN r.parent_title = s.parent_title AND length(r.cur) < 500 THEN r.g ELSE r.g + 1 END,
    CASE WHEN r.parent_title = s.parent_title AND length(r.cur) < 500 THEN rtrim(r.cur, ' ' || chr(10)) || chr(10) || chr(10) || ltrim(s.body, ' ' || chr(10)) ELSE s.body END, s.parent_title, s.title,
    CASE WHEN r.parent_title = s.parent_title AND length(r.cur) < 500 THEN r.n + 1 ELSE 1 END FROM r JOIN sections s ON s.doc_id = r.doc_id AND s.pos = r.pos + 1),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY pos DESC) = 1),
m AS (SELECT *, CASE WHEN n > 1 THEN (row_number() OVER (PARTITION BY doc_id, parent_title, n > 1 ORDER BY g))::INTEGER END AS part FROM f),
w AS (SELECT doc_id, g::INTEGER AS pos, CASE WHEN n > 1 THEN parent_title || '-' || part::VARCHAR ELSE title END AS title, parent_title, cur AS body, part FROM m)"""


@query("t4_merge_short_w1_number_parts", f"{MERGED} SELECT doc_id, pos, title, parent_title, md5(body) AS body_md5, part FROM w")
def t4(spark, d):
    sections = chunking.parent_titles(chunking.split_headings(V.markdown(spark, d)))
    merged = chunking.merge_short(sections.withColumns({"_piece": F.lit(0), "part": F.lit(None).cast("int")}), 500)
    return chunking.number_parts(merged).select("doc_id", "pos", "title", "parent_title", digest("body"), "part")


@query("p9_assemble_chunks", f"{MERGED} SELECT doc_id, pos, title, md5(title || chr(10) || chr(10) || body) AS content_md5 FROM w")
def p9(spark, d):
    return chunking.chunk_documents(V.markdown(spark, d), 1 << 30, 500, linearize=False).select("doc_id", "pos", "title", digest("content"))


@query("chunk_documents")
def chunked(spark, d):
    return chunking.chunk_documents(V.markdown(spark, d)).select("doc_id", "pos", "title", "part", F.length("content").alias("chars"))


@query("t5_t6_linearize_tables")
def t56(spark, d):
    """Order lines as an HTML and as a pipe table per order."""
    li = V.read(spark, d, "lineitem")
    row = F.struct("l_linenumber", F.concat(F.lit("<tr><td>"), F.col("l_linenumber"), F.lit("</td><td>"), "l_returnflag", F.lit("</td><td>"), F.col("l_quantity"), F.lit("</td></tr>")).alias("h"),
                   F.concat(F.lit("|"), F.col("l_linenumber"), F.lit("|"), "l_returnflag", F.lit("|"), F.col("l_quantity"), F.lit("|")).alias("m"))
    docs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    html = F.concat(F.lit("<table><tr><th>line</th><th>flag</th><th>quantity</th></tr>"), F.array_join(F.transform("r", lambda x: x["h"]), ""), F.lit("</table>"))
    pipe = F.concat(F.lit("\n|line|flag|quantity|\n|-|-|-|\n"), F.array_join(F.transform("r", lambda x: x["m"]), "\n"))
    return docs.select("l_orderkey", tables.linearized(F.concat(html, pipe)).alias("told"))


# vectors and fusion


#: What Python workers get of blocks of vectors at a time, unless the session sets it; results run after a query returns, so that it is not put back.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _vectors(spark, d):
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    table = V.stored(V.chunk_vectors(spark, d))
    return V.questions(table), table


@query("j1_dense_topk_p4_filter_items", f"WITH {V.VECTORS} SELECT query_id, chunk_id, score, rank FROM dense")
def j1(spark, d):
    q, t = _vectors(spark, d)
    return vectors.dense_topk(q, t)


@query("j2_sparse_topk", f"WITH {V.VECTORS} SELECT query_id, chunk_id, score, rank FROM sparse")
def j2(spark, d):
    q, t = _vectors(spark, d)
    return vectors.sparse_topk(q, t, item="item_name")


@query("a10_j9_hybrid_search", f"WITH {V.VECTORS} SELECT query_id, chunk_id, score, rank FROM hybrid")
def j9(spark, d):
    q, t = _vectors(spark, d)
    return vectors.hybrid_search(q, t)


ALL_PAIRS = V.VECTORS.replace("ON q.item_name = t.item_name", "ON true").replace(" AND t.item_name = q.item_name", "")


@query("j9_hybrid_search_unconfined", f"WITH {ALL_PAIRS} SELECT query_id, chunk_id, score, rank FROM hybrid")
def j9_all(spark, d):
    """The use that looks names up among all items: no item filter."""
    q, t = _vectors(spark, d)
    return vectors.hybrid_search(q, t, item=None)


@query("j9_hybrid_search_entities", f"WITH {V.VECTORS.replace('0.5::DOUBLE * (1', '0.4::DOUBLE * (1').replace('0.5::DOUBLE * (0.5', '0.6::DOUBLE * (0.5')} SELECT query_id, chunk_id, score, rank FROM hybrid")
def j9_entities(spark, d):
    """The use that aligns entities: weights 0.4 and 0.6."""
    q, t = _vectors(spark, d)
    return vectors.hybrid_search(q, t, weights=(0.4, 0.6))


@query("p4_filter_items", f"WITH {V.VECTORS}, qi AS (SELECT chunk_id AS query_id, item_name FROM cv WHERE chunk_id % 20 = 0 UNION SELECT chunk_id, 'L' || (chunk_id % 7)::VARCHAR FROM cv WHERE chunk_id % 20 = 0) SELECT query_id, chunk_id, item_name FROM qi JOIN cv USING (item_name)")
def p4(spark, d):
    """Two items a question, which may be the same."""
    q, t = _vectors(spark, d)
    asked = q.select("query_id", F.array("item_name", F.concat(F.lit("L"), (F.col("query_id") % 7).cast("string"))).alias("item_names"))
    return vectors.filter_items(asked, t).select("query_id", "chunk_id", "item_name")


DOC_GRAPH = """dg AS (SELECT item_name, chunk_id, source, lang FROM cv JOIN documents ON doc_id = chunk_id),
sd AS (SELECT chunk_id AS query_id, item_name, source FROM dg WHERE chunk_id % 20 = 0 AND trim(source, ' ' || chr(10)) <> ''),
tr AS (SELECT DISTINCT query_id, sd.item_name, sd.source, lang FROM sd JOIN dg USING (item_name, source) WHERE lang IS NOT NULL AND lang <> source),
nw AS (SELECT query_id, item_name, source AS name, 2.0::DOUBLE AS weight FROM sd WHERE query_id IN (SELECT query_id FROM tr) UNION SELECT query_id, item_name, lang, 1.0::DOUBLE FROM tr),
mn AS (SELECT DISTINCT item_name, name, chunk_id::VARCHAR AS chunk_id FROM (SELECT item_name, source AS name, chunk_id FROM dg UNION ALL SELECT item_name, lang, chunk_id FROM dg) WHERE name IS NOT NULL),
gl AS (SELECT * FROM (SELECT query_id, nw.item_name, chunk_id, sum(weight) AS score, count(*) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY sum(weight) DESC, count(*) DESC, chunk_id DESC)::INTEGER AS rank
  FROM nw JOIN mn ON mn.item_name = nw.item_name AND mn.name = nw.name GROUP BY query_id, nw.item_name, chunk_id) WHERE rank <= 100)"""


def _graph_leg(spark, d, t):
    """Sources and languages of a label's documents as its graph; a question asks for its own document's source."""
    rows = t.select("item_name", "chunk_id").join(V.read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang"), "chunk_id")
    names = rows.select("item_name", "chunk_id", F.explode(F.array("source", "lang")).alias("name")).where("name is not null")
    edges = rows.where("source is not null and lang is not null").select("item_name", F.col("source").alias("head"), F.lit("HAS_PART").alias("type"), F.col("lang").alias("tail")).distinct()
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.lit(0).alias("ext_pos"), "item_name", F.col("source").alias("aligned"))
    return graph_search.graph_leg(graph_search.item_entity_pairs(asked), names.select("item_name", "name").distinct(), edges, names.select("item_name", "name", "chunk_id"), keep=V.stored)


@query("graph_leg", f"WITH {V.VECTORS}, {DOC_GRAPH} SELECT query_id, rank, item_name, chunk_id, score, hits FROM gl")
def graph_leg(spark, d):
    return _graph_leg(spark, d, V.chunk_vectors(spark, d))


FUSED = f"""WITH {V.VECTORS}, {DOC_GRAPH}, g0 AS (SELECT query_id, chunk_id::BIGINT AS chunk_id, rank FROM gl),
legs AS (SELECT query_id, chunk_id, rank, 0 AS leg_no, 1.0::DOUBLE AS w FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1, 1.0::DOUBLE FROM hybrid UNION ALL SELECT query_id, chunk_id, rank, 2, 0.7::DOUBLE FROM g0),
fu0 AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 6) AS score, min((leg_no, rank)) AS f FROM legs GROUP BY ALL),
fu AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, chunk_id)::INTEGER AS rank FROM fu0) WHERE rank <= 10)"""


def _fused(spark, d):
    q, t = _vectors(spark, d)
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    dense = vectors.dense_topk(q, t)
    dense = V.stored(dense)
    hyde = vectors.hybrid_fuse(dense, vectors.sparse_topk(q, t, item="item_name"))
    graph = _graph_leg(spark, d, t).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    # the fusion asks whether a chunk has a content, not for it
    there = docs.select("chunk_id", F.when(F.col("content").isNotNull(), "").alias("content"))
    legs = {name: vectors.backfill_chunks(hits.select("query_id", "chunk_id", "rank"), there, ["content"]) for name, hits in (("vector", dense), ("hyde", hyde), ("graph", graph))}
    return fusion.rrf(fusion.union_legs(legs)), docs


@query("c1_union_legs_a9_rrf", f"{FUSED} SELECT query_id, chunk_id, score, rank FROM fu")
def a9(spark, d):
    return _fused(spark, d)[0]


CUT = """, cl AS (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nx FROM fu),
ct AS (SELECT *, min(CASE WHEN rank >= 3 AND ((score - nx) >= 0.5 OR (score - nx) / (abs(score) + 1e-6) >= 0.25) THEN rank END) OVER (PARTITION BY query_id) AS c FROM cl),
cut AS (SELECT query_id, chunk_id, score, rank FROM ct WHERE c IS NULL OR rank <= c)"""


@query("w2_cliff_cut", f"{FUSED}{CUT} SELECT query_id, chunk_id, score, rank FROM cut")
def w2(spark, d):
    return fusion.cliff_cut(_fused(spark, d)[0])


@query("answer_context", f"{FUSED}{CUT} SELECT query_id, chunk_id, score, rank, md5(text) AS content_md5 FROM cut JOIN documents ON doc_id = chunk_id")
def answer_context(spark, d):
    """Flagship: vector, hybrid and graph legs fused, cut and filled with the chunk texts."""
    fused, docs = _fused(spark, d)
    cut = V.stored(fusion.cliff_cut(fused))
    return vectors.backfill_chunks(cut, vectors.wanted(docs, cut), ["content"]).select("query_id", "chunk_id", "score", "rank", digest("content"))


@query("j6_backfill_chunks", f"WITH {V.VECTORS} SELECT query_id, rank, chunk_id, lang, source FROM hybrid LEFT JOIN documents ON doc_id = chunk_id")
def j6(spark, d):
    q, t = _vectors(spark, d)
    docs = V.read(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id")
    return vectors.backfill_chunks(vectors.hybrid_search(q, t), docs, ["lang", "source"]).select("query_id", "rank", "chunk_id", "lang", "source")


@query("k1_rerank_u2_score_pairs", f"""{FUSED}, wd AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
k AS (SELECT query_id, chunk_id, fu.rank AS pos, CASE WHEN len(a.w) > 0 THEN round(len(list_intersect(a.w, b.w))::DOUBLE / len(a.w), 6) ELSE 0.0 END AS score FROM fu JOIN wd a ON a.doc_id = query_id JOIN wd b ON b.doc_id = chunk_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos)::INTEGER AS rank FROM k""")
def k1(spark, d):
    fused, docs = _fused(spark, d)
    fused = V.stored(fused)
    docs = vectors.wanted(docs, fused.select(F.explode(F.array("query_id", "chunk_id")).alias("chunk_id")))
    rows = vectors.backfill_chunks(fused.select("query_id", "chunk_id", F.col("rank").alias("pos")), docs, ["content"])
    asked = docs.select(F.col("chunk_id").alias("query_id"), F.col("content").alias("query"))
    return fusion.rerank(rows.join(asked, "query_id")).select("query_id", "chunk_id", "pos", "score", "rank")


@query("c2_merge_sources", f"""{FUSED}, lo AS (SELECT query_id, 0 AS leg, rank AS pos, chunk_id::VARCHAR AS chunk_id, 'local' AS source, trim(text, ' ' || chr(10)) AS content FROM fu JOIN documents ON doc_id = chunk_id),
we AS (SELECT q.chunk_id AS query_id, 1 AS leg, item_id AS pos, NULL AS chunk_id, 'web' AS source, trim(text, ' ' || chr(10)) AS content FROM cv q JOIN benchmark ON item_id = q.chunk_id // 20 WHERE q.chunk_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY leg, pos)::INTEGER AS pos, chunk_id, source, md5(content) AS content_md5 FROM (SELECT * FROM lo UNION ALL SELECT * FROM we) WHERE content <> ''""")
def c2(spark, d):
    fused, docs = _fused(spark, d)
    local = vectors.backfill_chunks(fused.select("query_id", "chunk_id", F.col("rank").cast("long").alias("pos")), docs, ["content"]).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    q, _ = _vectors(spark, d)
    web = V.read(spark, d, "benchmark").withColumnRenamed("item_id", "pos").join(q.select("query_id"), F.col("pos") == F.floor(F.col("query_id") / 20)).select("query_id", "pos", F.col("text").alias("content"))
    return fusion.merge_sources(local, web).select("query_id", "pos", "chunk_id", "source", digest("content"))


@query("p3_valid_vectors", f"WITH {V.VECTORS} SELECT chunk_id, item_name FROM cv WHERE len(dense) > 0")
def p3(spark, d):
    return vectors.valid_vectors(V.chunk_vectors(spark, d)).select("chunk_id", "item_name")


@query("p5_embedding_text", "SELECT doc_id, md5(source || chr(10) || text) AS t_md5 FROM documents")
def p5(spark, d):
    return V.read(spark, d, "documents").withColumn("t", T.embedding_text(F.col("source"), F.col("text"))).select("doc_id", digest("t"))


@query("u1_embed")
def u1(spark, d):
    return models.embed(V.read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "dense", F.size("sparse").alias("tokens"))


@query("u3_complete", "SELECT conv_id, turn, length(coalesce(text, '')) || ' characters, first ' || substr(coalesce(text, ''), 1, 1) AS response FROM conversations")
def u3(spark, d):
    """Every turn of every conversation is a prompt, many of them the same; the model stands in for one that tells what it got."""
    turns = V.read(spark, d, "conversations").select("conv_id", "turn", "text")
    answers = f"{V.work_dir(spark)}/answers_{uuid.uuid4().hex}"
    return models.complete_once(turns, "text", lambda: lambda prompt: f"{len(prompt)} characters, first {prompt[:1]}", answers).select("conv_id", "turn", "response")


@query("t18_sparse_from_csr", "SELECT vec_id, e.i - 1 AS token, embedding[e.i]::DOUBLE AS weight FROM embeddings, unnest(range(1, len(embedding) + 1)) AS e(i)")
def t18(spark, d):
    rows = V.read(spark, d, "embeddings").withColumn("half", F.floor(F.size("embedding") / 2).cast("int"))
    # one matrix a vector: rows 1 and 2 are its halves, after an empty row 0
    indices = F.sequence(F.lit(0), F.size("embedding") - 1).cast("array<int>")
    part = lambda row: T.sparse_row(indices, F.col("embedding").cast("array<double>"), F.array(F.lit(0), F.lit(0), F.col("half"), F.size("embedding")), F.lit(row))
    return rows.select("vec_id", F.explode(F.map_concat(part(1), part(2))).alias("token", "weight")).withColumn("token", F.col("token").cast("long"))


# graph


def _graph(spark, d):
    parsed = graph_build.parse_responses(V.extractions(spark, d))
    entities = graph_build.clean_entities(parsed)
    return parsed, entities, graph_build.clean_relations(parsed)


@query("p2_valid_graph_chunks", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'kg_chunk_temp_' || doc_id::VARCHAR ELSE doc_id::VARCHAR END AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN lang ELSE source END AS item_name, md5(trim(text, ' ' || chr(10))) AS content_md5 FROM documents WHERE trim(text, ' ' || chr(10)) <> '' AND CASE WHEN doc_id % 7 = 0 THEN lang ELSE source END IS NOT NULL")
def p2(spark, d):
    docs = V.read(spark, d, "documents")
    rows = docs.select(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("chunk_id"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).otherwise(" ").alias("item_name"), F.col("text").alias("content"), F.col("doc_id").alias("pos"), "lang")
    return graph_build.valid_graph_chunks(rows, F.col("lang")).select("chunk_id", "item_name", digest("content"))


@query("t9_parse_extraction", "SELECT l_orderkey::VARCHAR || '/' || p_brand AS chunk_id, CASE WHEN l_orderkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE 2 * count(*) END::BIGINT AS entities FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand")
def t9(spark, d):
    return graph_build.parse_responses(V.extractions(spark, d)).select("chunk_id", "status", F.size("entities").cast("long").alias("entities"))


@query("p6_clean_entities", f"WITH {V.ENTITIES} SELECT chunk_id, item_name, name, label, description FROM ent")
def p6(spark, d):
    return _graph(spark, d)[1].select("chunk_id", "item_name", "name", "label", "description")


@query("p7_clean_relations", f"WITH {V.ENTITIES} SELECT chunk_id, item_name, head, type, tail FROM rel")
def p7(spark, d):
    return _graph(spark, d)[2].select("chunk_id", "item_name", "head", "type", "tail")


@query("a1_merge_nodes", f"WITH {V.ENTITIES} SELECT item_name, name, array_to_string(labels, ',') AS labels, description, source_chunk_id FROM nodes")
def a1(spark, d):
    return graph_build.merge_nodes(_graph(spark, d)[1]).withColumn("labels", F.array_join("labels", ",")).select("item_name", "name", "labels", "description", "source_chunk_id")


@query("a2_merge_mentions", f"WITH {V.ENTITIES} SELECT DISTINCT item_name, name, chunk_id FROM ent")
def a2(spark, d):
    return graph_build.merge_mentions(_graph(spark, d)[1])


@query("a3_merge_edges", f"WITH {V.ENTITIES} SELECT DISTINCT item_name, head, type, tail FROM rel")
def a3(spark, d):
    _, entities, relations = _graph(spark, d)
    return graph_build.merge_edges(relations, graph_build.merge_nodes(entities))


def _in_batches(spark, d):
    """Three imports: the first two hold every third order, the last one the rest and the second again."""
    parsed = graph_build.parse_responses(V.extractions(spark, d))
    batch = lambda *rest: parsed.where((F.col("pos") % 3).isin(*rest))
    nodes = edges = mentions = None
    for part in (batch(1), batch(0), batch(2, 0)):
        entities, relations = graph_build.clean_entities(part), graph_build.clean_relations(part)
        states, met = graph_build.node_states(entities), graph_build.merge_mentions(entities)
        nodes = graph_build.fold_nodes(nodes, states) if nodes else states
        mentions = graph_build.fold_mentions(mentions, met) if mentions else met
        edges = graph_build.fold_edges(edges, relations, nodes) if edges else graph_build.merge_edges(relations, nodes)
    return nodes, edges, mentions


@query("a1_fold_nodes", f"WITH {V.ENTITIES} SELECT item_name, name, array_to_string(labels, ',') AS labels, description, source_chunk_id FROM nodes")
def a1_fold(spark, d):
    return graph_build.nodes_of(_in_batches(spark, d)[0]).withColumn("labels", F.array_join("labels", ","))


@query("a2_fold_mentions", f"WITH {V.ENTITIES} SELECT DISTINCT item_name, name, chunk_id FROM ent")
def a2_fold(spark, d):
    return _in_batches(spark, d)[2]


@query("a3_fold_edges", f"WITH {V.ENTITIES} SELECT DISTINCT item_name, head, type, tail FROM rel")
def a3_fold(spark, d):
    return _in_batches(spark, d)[1]


@query("a4_entity_rows", f"WITH {V.ENTITIES} SELECT DISTINCT item_name, name AS entity_name, chunk_id AS source_chunk_id, substr('chunk ' || chunk_id || ' ' || repeat('x', 300), 1, 200) AS context FROM ent")
def a4(spark, d):
    chunks = V.extractions(spark, d).select("chunk_id", F.concat(F.lit("chunk "), "chunk_id", F.lit(" "), F.repeat(F.lit("x"), 300)).alias("content"))
    return graph_build.entity_rows(_graph(spark, d)[1], chunks)


@query("a12_extraction_stats", f"WITH {V.ENTITIES}, c AS (SELECT DISTINCT l_orderkey::VARCHAR || '/' || p_brand AS chunk_id FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT DISTINCT chunk_id FROM ent) SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM o) AS succeeded, (SELECT count(*) FROM c) - (SELECT count(*) FROM o) AS failed, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations")
def a12(spark, d):
    return graph_build.extraction_stats(*_graph(spark, d))


@query("a12_failed_chunks", f"WITH {V.ENTITIES}, c AS (SELECT DISTINCT l_orderkey::VARCHAR || '/' || p_brand AS chunk_id, l_orderkey % 11 = 0 AS bad FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT chunk_id, CASE WHEN bad THEN 'bad response' ELSE 'no valid entity' END AS reason FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM ent)")
def a12_failed(spark, d):
    parsed, entities, _ = _graph(spark, d)
    return graph_build.failed_chunks(parsed, entities)


@query("g1_import_in_batches", f"""WITH {V.ENTITIES}, late AS (SELECT DISTINCT item_name FROM li WHERE right(item_name, 1) = '1')
SELECT item_name, name, array_to_string(labels, ',') AS labels, description, source_chunk_id FROM nodes SEMI JOIN late USING (item_name)
UNION ALL SELECT item_name, name, array_to_string(list_sort(list_distinct(list(label))), ','), coalesce(arg_max(description, (pos, seq, chunk_id)) FILTER (description IS NOT NULL), ''), arg_min(chunk_id, (pos, seq, chunk_id)) FROM ent WHERE pos % 2 = 1 AND item_name NOT IN (FROM late) GROUP BY item_name, name""")
def g1(spark, d):
    """All tables of a graph committed in two batches, of which the second replaces some items and is repeated; the nodes as they are then."""
    path, responses = f"{V.work_dir(spark)}/tables_{uuid.uuid4().hex}", V.extractions(spark, d)
    late = F.right(F.col("item_name"), F.lit(1)) == "1"
    for number, part in enumerate((responses.where("pos % 2 = 1"), responses.where(late), responses.where(late))):
        parsed = graph_build.parse_responses(part)
        entities, relations = graph_build.clean_entities(parsed), graph_build.clean_relations(parsed)
        states = graph_build.node_states(entities)
        tables = {"nodes": states, "edges": graph_build.merge_edges(relations, states), "mentions": graph_build.merge_mentions(entities)}
        versions.commit(spark, path, tables, items=part, batch=("import", min(number, 1)))
    return graph_build.nodes_of(versions.read_table(spark, path, "nodes")).withColumn("labels", F.array_join("labels", ","))


@query("s6_replace_by_item", "SELECT p_brand AS item_name, p_name AS name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45) UNION ALL SELECT p_brand, upper(p_name) FROM part WHERE p_size > 45")
def s6(spark, d):
    part = V.read(spark, d, "part")
    return graph_build.replace_by_item(part.select(F.col("p_brand").alias("item_name"), F.col("p_name").alias("name")), part.where("p_size > 45").select(F.col("p_brand").alias("item_name"), F.upper("p_name").alias("name")))


def _found(spark, d):
    """Seeds and triples of the leads, the members of the leads, mentions."""
    nodes, edges, mentions = V.graph(spark, d)
    own, members = graph_search.leads(V.stored(graph_search.find_seeds(V.entity_pairs(spark, d), nodes)))
    return own, graph_search.one_hop(own, edges), members, mentions


@query("j3_find_seeds", f"WITH {V.GRAPH} SELECT query_id, seed_no, item_name, name FROM seeds")
def j3(spark, d):
    return graph_search.find_seeds(V.entity_pairs(spark, d), V.graph(spark, d)[0])


@query("j4_one_hop_a7_dedupe_triples", f"WITH {V.GRAPH} SELECT query_id, no, item_name, head, rel, tail FROM tr")
def j4(spark, d):
    _, triples, members, _ = _found(spark, d)
    return graph_search.of_members(triples, members)


@query("a8_node_weights", f"WITH {V.GRAPH} SELECT query_id, item_name, name, weight FROM nw")
def a8(spark, d):
    own, triples, members, _ = _found(spark, d)
    return graph_search.of_members(graph_search.node_weights(own, triples), members)


@query("j5_lookup_chunks", f"WITH {V.GRAPH} SELECT query_id, rank, item_name, chunk_id, score, hits FROM lk")
def j5(spark, d):
    own, triples, members, mentions = _found(spark, d)
    return graph_search.of_members(graph_search.lookup_chunks(graph_search.node_weights(own, triples), mentions), members)


@query("t13_triples_to_text", f"WITH {V.GRAPH} SELECT query_id, no, '[' || item_name || '] ' || head || ' -(' || rel || ')-> ' || tail AS told FROM tr")
def t13(spark, d):
    told = T.triples_to_text(F.col("item_name"), F.col("head"), F.col("rel"), F.col("tail")).alias("told")
    return j4(spark, d).select("query_id", "no", told)


MATCHES = """cv AS (SELECT vec_id, 'L' || label::VARCHAR AS item_name, embedding::DOUBLE[] AS v FROM embeddings),
al AS (SELECT q.vec_id AS query_id, q.item_name AS entity, t.item_name, t.vec_id::VARCHAR AS entity_name, round(list_dot_product(q.v, t.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(t.v, t.v))), 6) AS score FROM cv q JOIN cv t ON q.item_name = t.item_name WHERE q.vec_id % 20 = 0 AND t.vec_id <> q.vec_id),
mt AS (SELECT query_id, entity, item_name, entity_name, score FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_name) <= 5)"""


def _matches(spark, d):
    """The 5 nearest other vectors of a question's label, as hits of its one entity."""
    e = V.read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("item_name"), "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "item_name", F.col("embedding").alias("q_dense"))
    table = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "item_name", F.col("embedding").alias("dense"))
    # the question's own vector takes one of the 6 places at most
    hits = vectors.dense_topk(q, table, 6).where(F.col("chunk_id") != F.col("query_id").cast("string")).drop("rank")
    hits = vectors.top_per(hits, ["query_id"], [F.desc("score"), F.col("chunk_id")], 5)
    return hits.join(q.select("query_id", "item_name"), "query_id").select("query_id", F.col("item_name").alias("entity"), "item_name", F.col("chunk_id").alias("entity_name"), "score")


ASKED = "asked AS (SELECT vec_id AS query_id, item_name AS entity, item_name FROM cv WHERE vec_id % 20 = 0)"
BEST = f"WITH {MATCHES}, {ASKED}, b AS (SELECT a.*, m.entity_name, m.score FROM asked a LEFT JOIN (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_name) = 1) m USING (query_id, entity, item_name))"


def _aligned(spark, d):
    hits = _matches(spark, d)
    asked = V.read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("ext_pos"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("entity"))
    return graph_search.best_per_item(asked.withColumn("item_name", F.col("entity")), hits, 0.25)


@query("a5_best_per_item", f"{BEST} SELECT query_id, item_name, CASE WHEN score >= 0.25 THEN entity_name END AS aligned, CASE WHEN score >= 0.25 THEN score END AS score, CASE WHEN score IS NULL THEN 'no hit' WHEN score < 0.25 THEN 'below minimum' END AS reason FROM b")
def a5(spark, d):
    return _aligned(spark, d).select("query_id", "item_name", "aligned", "score", "reason")


@query("a6_item_entity_pairs", f"{BEST} SELECT query_id, 1 AS pos, item_name, entity_name AS entity FROM b WHERE score >= 0.25")
def a6(spark, d):
    return graph_search.item_entity_pairs(_aligned(spark, d))


# items

NAMED = f"""WITH {MATCHES}, sc AS (SELECT query_id, entity_name, round(score + 0.3, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_name) AS k FROM mt),
hi AS (SELECT query_id, count(*) FILTER (score >= 0.7) AS h FROM sc GROUP BY ALL),
al2 AS (SELECT query_id, coalesce(string_agg(entity_name, ',' ORDER BY k) FILTER (h = 1 AND k = 1), '') AS confirmed,
  coalesce(string_agg(entity_name, ',' ORDER BY k) FILTER (k <= 3 AND ((h > 1 AND score >= 0.7) OR (h = 0 AND score >= 0.6))), '') AS options FROM sc JOIN hi USING (query_id) GROUP BY ALL)"""


def _named(spark, d):
    rows = _matches(spark, d).select("query_id", F.lit(0).alias("ext_pos"), F.col("entity").alias("extracted_name"), F.col("entity_name").alias("item_name"), F.round(F.col("score") + 0.3, 6).alias("score"))
    return items.align_items(rows), rows


@query("t19_align_items", f"{NAMED} SELECT query_id, confirmed, options FROM al2")
def t19(spark, d):
    return _named(spark, d)[0].select("query_id", F.array_join("confirmed", ",").alias("confirmed"), F.array_join("options", ",").alias("options"))


@query("p10_decide_route", f"{NAMED} SELECT query_id, CASE WHEN confirmed <> '' THEN 'search' WHEN options <> '' THEN 'clarify' ELSE 'fallback' END AS route, CASE WHEN confirmed <> '' THEN NULL WHEN options <> '' THEN 'Which item do you mean: ' || replace(options, ',', '、') || '?' ELSE 'No matching item was found; please name it.' END AS reply FROM al2")
def p10(spark, d):
    return items.decide_route(_named(spark, d)[0])


@query("a11_filter_confirmed", f"{NAMED}, b AS (SELECT query_id, entity_name AS item_name, score, max(score) OVER (PARTITION BY query_id) AS top FROM sc) SELECT query_id, item_name, score FROM b WHERE round(top - score, 9) <= 0.05")
def a11(spark, d):
    rows = V.stored(_named(spark, d)[1])
    confirmed = rows.select("query_id", F.lit(0).alias("pos"), "item_name")
    return items.filter_confirmed(confirmed, rows, 0.05).select("query_id", "item_name", "score")


@query("w4_item_context", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, trim(c, ' ') AS c FROM l WHERE trim(c, ' ') <> ''), t AS (SELECT doc_id, k, '[' || k::VARCHAR || '] ' || c AS c FROM k WHERE k <= 3), u AS (SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t) SELECT doc_id, substr(string_agg(c, chr(10) || chr(10) ORDER BY k), 1, 400) AS context FROM u WHERE b <= 400 GROUP BY doc_id")
def w4(spark, d):
    chunks = V.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    return items.item_context(chunks, 3, 400)


@query("p8_fill_item_name", "SELECT doc_id, CASE WHEN source IS NULL OR right(source, 1) IN ('1', '2') OR NOT regexp_matches(source, '[0-9]$') THEN source ELSE 'item of ' || source END AS item_name FROM documents")
def p8(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", F.col("source").alias("file_title"))
    last = F.substring("file_title", -1, 1)
    known = docs.select("file_title").distinct().where("file_title is not null").select("file_title", F.when(last == "1", " Unknown ").when(last == "2", "").otherwise(F.when(F.col("file_title").rlike("[0-9]$"), F.concat(F.lit("item of "), "file_title"))).alias("item_name"))
    return items.fill_item_name(docs, known).select("doc_id", "item_name")


@query("p11_resolve_query", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR trim(text, ' ' || chr(10)) = '' OR text IS NULL THEN role ELSE trim(text, ' ' || chr(10)) END AS asked FROM conversations")
def p11(spark, d):
    return V.read(spark, d, "conversations").select("conv_id", "turn", items.resolve_query(F.col("role"), F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text"))).alias("asked"))


@query("t10_parse_query_entities", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE substr(p_name, 1, 15) || CASE WHEN substr(p_type, 1, 15) <> substr(p_name, 1, 15) THEN '|' || substr(trim(p_type), 1, 15) ELSE '' END END AS names FROM part")
def t10(spark, d):
    part = V.read(spark, d, "part")
    json = F.to_json(F.struct(F.array(F.col("p_name"), F.lit(" "), F.concat(F.lit(" "), "p_type"), F.col("p_name")).alias("entities")))
    response = F.when(F.col("p_partkey") % 7 == 0, '{"entities": "x"').otherwise(F.concat(F.lit("```json\n"), json, F.lit("\n```")))
    return part.select("p_partkey", F.array_join(T.parse_query_entities(response), "|").alias("names"))


@query("t11_parse_item_names", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS items, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN p_name ELSE 'about ' || p_name END AS rewritten FROM part")
def t11(spark, d):
    part = V.read(spark, d, "part")
    rewritten = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" about "), "p_name"))
    json = F.to_json(F.struct(F.array(F.concat("p_brand", F.lit(" ")), F.lit("")).alias("item_names"), rewritten.alias("rewritten_query")))
    x = T.parse_item_names(F.when(F.col("p_partkey") % 7 == 0, "sorry").otherwise(json), F.col("p_name"))
    return part.select("p_partkey", F.array_join(x["item_names"], "|").alias("items"), x["rewritten_query"].alias("rewritten"))


ASKED_OF_PART = """CASE p_partkey % 5 WHEN 0 THEN p_brand || ' how to use it?' WHEN 1 THEN 'is ' || upper(p_brand) || ' - good，' WHEN 2 THEN 'what about ' || replace(p_brand, '#', ' # ') || ' then！'
  WHEN 3 THEN p_brand || '?' ELSE 'nothing of the kind ' || p_partkey::VARCHAR END"""


@query("t12_strip_item_names", f"WITH q AS (SELECT p_partkey, p_brand, {ASKED_OF_PART} AS q FROM part), s AS (SELECT *, trim(regexp_replace(regexp_replace(q, '(?i)' || replace(p_brand, '#', '\\s*#\\s*'), '', 'g'), '[\\s-]+', ' ', 'g'), ' ,，。?？!！') AS s FROM q) SELECT p_partkey, CASE WHEN s = '' THEN q ELSE s END AS asked FROM s")
def t12(spark, d):
    part = V.read(spark, d, "part").withColumn("q", F.expr(ASKED_OF_PART.replace("p_partkey::VARCHAR", "string(p_partkey)")))
    return part.select("p_partkey", items.strip_item_names(F.col("q"), F.array("p_brand")).alias("asked"))


# history and prompts


@query("w5_recent_messages", f"WITH {V.HISTORY}, r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, _id) <= 3) SELECT session_id, _id, row_number() OVER (PARTITION BY session_id ORDER BY ts, _id)::INTEGER AS pos FROM r")
def w5(spark, d):
    return hist.recent_messages(V.history(spark, d), 3).select("session_id", "_id", "pos")


@query("t14_format_history", f"WITH {V.HISTORY} SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'U' ELSE 'A' END || ': ' || text, chr(10) ORDER BY ts, _id) AS history FROM h WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY ALL")
def t14(spark, d):
    return hist.format_history(hist.recent_messages(V.history(spark, d), 1 << 30), {"user": "U", "assistant": "A"})


@query("t14_format_history_raw", f"WITH {V.HISTORY} SELECT session_id, string_agg(coalesce(role, '') || ': ' || trim(text, ' ' || chr(10)), chr(10) ORDER BY ts, _id) AS history FROM h WHERE trim(text, ' ' || chr(10)) <> '' GROUP BY ALL")
def t14_raw(spark, d):
    return hist.format_history(hist.recent_messages(V.history(spark, d), 1 << 30))


@query("s7_save_messages", f"WITH {V.HISTORY} SELECT _id, CASE WHEN ts = 1 THEN 'edited' ELSE text END AS text FROM h")
def s7(spark, d):
    old = V.history(spark, d)
    edited = old.where("ts = 1").withColumn("text", F.lit("edited"))
    return hist.save_messages(old, edited.unionByName(edited.withColumn("_id", F.concat(F.lit("unknown "), "_id")))).select("_id", "text")


@query("c3_delete_session", f"WITH {V.HISTORY} SELECT _id FROM h WHERE session_id NOT IN (SELECT session_id FROM h WHERE role = 'system')")
def c3(spark, d):
    old = V.history(spark, d)
    return hist.delete_sessions(old, old.where("role = 'system'").select("session_id"))[0].select("_id")


@query("c3_deleted_counts", f"WITH {V.HISTORY} SELECT session_id, count(*) AS removed FROM h WHERE session_id IN (SELECT session_id FROM h WHERE role = 'system') GROUP BY ALL")
def c3b(spark, d):
    old = V.history(spark, d)
    return hist.delete_sessions(old, old.where("role = 'system'").select("session_id"))[1]


@query("c4_backfill_item_names", f"WITH {V.HISTORY} SELECT _id, CASE WHEN item_names IS NULL AND role = 'user' THEN 'x,y' ELSE array_to_string(item_names, ',') END AS item_names, item_names IS NULL AND role = 'user' AS changed FROM h")
def c4(spark, d):
    old = V.history(spark, d)
    new = old.where("role = 'user'").select("_id", F.array(F.lit("x"), F.lit("y")).alias("items"))
    return hist.backfill_item_names(old, new).select("_id", F.array_join("item_names", ",").alias("item_names"), "changed")


def _entries(spark, d):
    return V.read(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("text").alias("entry"), F.lit(300).alias("budget"))


@query("w3_budget_prefix", 'WITH e AS (SELECT conv_id AS query_id, turn AS pos, length(text) AS n FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e), o AS (SELECT *, min(CASE WHEN b + n > 300 THEN pos END) OVER (PARTITION BY query_id) AS o FROM c) SELECT query_id, pos, (o IS NULL OR pos < o) AS fits, (300 - coalesce(max(CASE WHEN o IS NULL OR pos < o THEN b + n + 2 END) OVER (PARTITION BY query_id), 0))::BIGINT AS "left" FROM o')
def w3(spark, d):
    return prompts.budget_prefix(_entries(spark, d), 2).select("query_id", "pos", "fits", F.col("left").cast("long").alias("left"))


@query("w3_budget_prefix_history", 'WITH e AS (SELECT conv_id AS query_id, turn AS pos, length(text) AS n FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, sum(n + 1) OVER (PARTITION BY query_id ORDER BY pos) AS u FROM e), o AS (SELECT *, min(CASE WHEN u > 300 THEN pos END) OVER (PARTITION BY query_id) AS o FROM c) SELECT query_id, pos, (o IS NULL OR pos < o) AS fits, (300 - max(CASE WHEN o IS NULL OR pos <= o THEN u END) OVER (PARTITION BY query_id))::BIGINT AS "left" FROM o')
def w3h(spark, d):
    return prompts.budget_prefix(_entries(spark, d), 1, charge_first=True).select("query_id", "pos", "fits", F.col("left").cast("long").alias("left"))


@query("t15_format_docs", f"""{FUSED} SELECT query_id, rank, '[' || rank::VARCHAR || '] [source=local] [chunk_id=' || chunk_id::VARCHAR || '] [score=' || printf('%.4f', score) || ']' || chr(10) || source AS told FROM fu JOIN documents ON doc_id = chunk_id""")
def t15(spark, d):
    fused, _ = _fused(spark, d)
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("content"))
    rows = vectors.backfill_chunks(fused, docs, ["content"])
    told = T.format_doc(F.col("rank"), F.lit("local"), F.col("chunk_id"), F.lit(None).cast("string"), F.lit(""), F.col("score"), F.col("content"))
    return rows.select("query_id", "rank", told.alias("told"))


@query("t16_build_prompt", """WITH q AS (SELECT DISTINCT conv_id AS query_id FROM conversations), e AS (SELECT conv_id AS query_id, turn AS pos, text AS t, role FROM conversations WHERE text IS NOT NULL),
d0 AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e WHERE role = 'assistant'),
d1 AS (SELECT *, min(CASE WHEN b + length(t) > 500 THEN pos END) OVER (PARTITION BY query_id) AS o FROM d0),
d2 AS (SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) FILTER (o IS NULL OR pos < o) AS txt, 500 - coalesce(max(b + length(t) + 2) FILTER (o IS NULL OR pos < o), 0) AS lft FROM d1 GROUP BY ALL),
ds AS (SELECT query_id, coalesce(txt, '') AS docs, coalesce(lft, 500) AS lft FROM q LEFT JOIN d2 USING (query_id)),
h0 AS (SELECT e.*, lft, sum(length(t) + 1) OVER (PARTITION BY query_id ORDER BY pos) AS u FROM e JOIN ds USING (query_id) WHERE role = 'user'),
h1 AS (SELECT *, min(CASE WHEN u > lft THEN pos END) OVER (PARTITION BY query_id) AS o FROM h0),
h2 AS (SELECT query_id, string_agg(t, chr(10) ORDER BY pos) FILTER (o IS NULL OR pos < o) AS txt FROM h1 GROUP BY ALL),
p AS (SELECT query_id, docs, coalesce(txt, '') AS hist FROM ds LEFT JOIN h2 USING (query_id))
SELECT query_id, md5('Answer the question from the material.' || chr(10) || chr(10) || 'Question: q' || query_id::VARCHAR || chr(10) || chr(10) || 'Material:' || chr(10) || CASE docs WHEN '' THEN '(no material)' ELSE docs END || chr(10) || chr(10) || 'Conversation:' || chr(10) ||
  CASE hist WHEN '' THEN '(no conversation)' ELSE hist END || chr(10) || chr(10) || 'Relations:' || chr(10) || '(no relations)' || chr(10)) AS prompt_md5 FROM p""")
def t16(spark, d):
    e = _entries(spark, d).drop("budget").join(V.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "role"), ["query_id", "pos"])
    asked = V.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct().withColumn("question", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    part = lambda role: e.where(F.col("role") == role).select("query_id", "pos", "entry")
    return prompts.build_prompt(asked, part("assistant"), part("user"), part("nobody"), 500).select("query_id", digest("prompt"))


@query("t17_answer_images", "SELECT page_id, 'See page' AS told, regexp_replace(url, '[?#].*', '') || '.png' AS images FROM pages")
def t17(spark, d):
    # the same image twice, and an address that is no image
    x = T.answer_images(F.concat(F.lit("See page  \n【图片】\n"), F.regexp_replace("url", "[?#].*", ""), F.lit(".png\nhttp://h/x.txt\n"), F.regexp_replace("url", "[?#].*", ""), F.lit(".png")))
    return V.read(spark, d, "pages").select("page_id", x["text"].alias("told"), F.array_join(x["images"], "|").alias("images"))

# sources and images


@query("s2_route_by_type", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' ELSE 'rejected' END AS route, CASE WHEN page_id % 3 = 1 THEN 'converted/f' || page_id::VARCHAR || '/f' || page_id::VARCHAR || '.md' END AS md_path FROM pages")
def s2(spark, d):
    suffix = F.when(F.col("page_id") % 3 == 0, ".MD").when(F.col("page_id") % 3 == 1, ".Pdf").otherwise(".docx")
    rows = V.read(spark, d, "pages").select("page_id", F.concat(F.lit("in/f"), F.col("page_id").cast("string"), suffix).alias("path"))
    md, pdf, rejected = files.route_by_type(rows)
    part = lambda df, name: df.select("page_id", F.lit(name).alias("route"), *([F.col("md_path")] if "md_path" in df.columns else [F.lit(None).cast("string").alias("md_path")]))
    return part(md, "md").unionByName(part(pdf, "pdf")).unionByName(part(rejected, "rejected"))


@query("s9_object_url", "SELECT doc_id, 'http://store:9000/kb/' || coalesce(source, 'none') || '/' || doc_id::VARCHAR || '.png' AS url FROM documents")
def s9(spark, d):
    docs = V.read(spark, d, "documents")
    return docs.select("doc_id", T.object_url(F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".png")), "store:9000", "kb").alias("url"))


@query("s3_flatten_layout_json", "SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS told FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''")
def s3(spark, d):
    """Each conversation as pages of blocks, in the four shapes a block's text has."""
    c = V.read(spark, d, "conversations")
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("v"))), r'^\{"v":|\}$', "")
    quoted = F.when(F.col("text").isNull(), '""').otherwise(quoted)
    k = F.col("turn") % 4
    block = F.when(k == 0, F.concat(F.lit('{"type":"t","content":'), quoted, F.lit("}"))).when(k == 1, F.concat(F.lit('{"type":"p","content":{"paragraph_content":[{"content":'), quoted, F.lit("}]}}"))).when(k == 2, F.concat(F.lit('{"content":{"table_body":'), quoted, F.lit("}}"))).otherwise(F.concat(F.lit('{"text":'), quoted, F.lit("}")))
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    json = F.concat(F.lit("["), F.array_join(F.transform("bs", lambda x: F.concat(F.lit("["), x["b"], F.lit("]"))), ","), F.lit("]"))
    rows = files.flatten_layout_json(docs.select("conv_id", F.transform("bs", lambda x: x["turn"]).alias("turns"), json.alias("json")))
    return rows.select("conv_id", F.element_at("turns", F.col("block_no") + 1).alias("turn"), F.col("text").alias("told"))


def _illustrated(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", F.col("source").alias("file_title"), "text")
    md = F.concat(F.lit("# Head\n"), F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), F.lit("\n\n![a](img/"), F.col("doc_id").cast("string"), F.lit(".png)\n\n"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "file_title", md.alias("md")), docs.select("doc_id", "file_title", F.explode(F.array(F.concat(F.col("doc_id").cast("string"), F.lit(".png")), F.lit("spare.png"))).alias("image_name"))


@query("j7_split_image_use", "SELECT doc_id, doc_id::VARCHAR || '.png' AS image_name, TRUE AS used FROM documents UNION ALL SELECT doc_id, 'spare.png', FALSE FROM documents")
def j7(spark, d):
    docs, names = _illustrated(spark, d)
    used, unused = images.split_image_use(names, docs)
    return used.select("doc_id", "image_name", F.lit(True).alias("used")).unionByName(unused.select("doc_id", "image_name", F.lit(False).alias("used")))


@query("t7_image_context")
def t7(spark, d):
    docs, names = _illustrated(spark, d)
    return images.image_context(docs, names)


@query("j8_t8_rewrite_images", "SELECT doc_id, md5('# Head' || chr(10) || string_split(coalesce(text, ''), chr(10))[1] || chr(10) || chr(10) || '![pic ' || doc_id::VARCHAR || '](http://s/b/' || coalesce(source, 'none') || '/' || doc_id::VARCHAR || '.png)' || chr(10) || chr(10) || coalesce(text, '')) AS md_md5 FROM documents")
def t8(spark, d):
    docs, names = _illustrated(spark, d)
    docs, names = (x.withColumn("file_title", F.coalesce("file_title", F.lit("none"))) for x in (docs, names))
    told = names.where("image_name <> 'spare.png'").select("doc_id", "image_name", F.concat(F.lit("pic "), F.col("doc_id").cast("string")).alias("summary"))
    refs = images.attach_summaries(names, told, "s", "b")
    return images.rewrite_images(docs, refs).select("doc_id", digest("md"))
