"""Hand-worked cases of the operators."""

import pytest
from pyspark.sql import functions as F

from retrieval_jobs.functions import text as T
from retrieval_jobs.operators import chunking, fusion, graph_build, graph_search, history, images, items, models, prompts, tables, vectors
from retrieval_jobs.sources import files


def test_headings_and_parents(spark):
    md = "\r\n".join(["pre", "# A", "body a", "```", "# not heading", "```", "## A1", "x", "  ### A1a", "y", "## A2", "z", "# B", "w"])
    docs = spark.createDataFrame([(1, "T", md), (2, "E", ""), (3, "N", "\n"), (4, "J", "# A\n### C\nt"), (5, "X", None)], "doc_id long, file_title string, md string")
    got = [tuple(r) for r in chunking.parent_titles(chunking.split_headings(docs)).orderBy("doc_id", "pos").select("doc_id", "title", "body", "parent_title").collect()]
    assert got[:6] == [(1, "", "pre", "T"), (1, "# A", "body a\n# not heading", "T"), (1, "## A1", "x", "# A"), (1, "  ### A1a", "y", "## A1"), (1, "## A2", "z", "# A"), (1, "# B", "w", "T")]
    assert got[6:] == [(3, "", "\n", "N"), (4, "# A", "", "J"), (4, "### C", "t", "# A")]


def test_split_text_contract():
    assert chunking.split_text("aaaa bbbb cccc", 10) == ["aaaa bbbb", "cccc"]
    long = "word " * 300 + "x" * 50
    pieces = chunking.split_text(long, 40)
    assert max(map(len, pieces)) <= 40 and "".join(pieces).replace(" ", "") == long.replace(" ", "")


def test_merge_and_number(spark):
    rows = [("P", b) for b in ("aa", "bb", "cccccccc")] + [("Q", "d")] + [("P", b) for b in ("e", "f")]
    df = spark.createDataFrame([(1, "F", i, f"t{i}", b, p) for i, (p, b) in enumerate(rows)], "doc_id long, file_title string, pos int, title string, body string, parent_title string")
    got = [(r.title, r.body, r.part) for r in chunking.number_parts(chunking.size_sections(df, 1000, 5)).orderBy("pos").collect()]
    assert got == [("P-1", "aa\n\nbb", 1), ("t2", "cccccccc", None), ("t3", "d", None), ("P-2", "e\n\nf", 2)]
    with pytest.raises(ValueError):
        chunking.size_sections(df, 5, 10)


def test_tables():
    assert tables.linearize_tables("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table>") == "\n\n- 【a】：b。\n- 【c】：无。\n\n"
    assert tables.linearize_tables("<table><tr><th>N</th><th>X</th><th>Y</th></tr><tr><td>p</td><td>1</td><td>-</td></tr></table>").strip() == "- 【p】(对应N)：X为1。"
    assert tables.linearize_tables("<table><tr><td></td><td>X</td></tr><tr><td>p</td><td>1</td></tr></table>").strip() == "- 【p】：X为1。"
    spans = tables.linearize_tables('<table><tr><th>A</th><th>B</th></tr><tr><td rowspan="2">k</td><td>1</td></tr><tr><td>2</td></tr></table>').strip()
    assert spans == "- 【k】(对应A)：B为1。\n- 【k】(对应A)：B为2。"
    assert tables.linearize_tables("x\n| a | b |\n|---|---|\n| 1 | 2 |\ny").split() == ["x", "-", "【1】(对应a)：b为2。", "y"]
    assert tables.linearize_tables("| a | b |\n|:-:|---|\n| 1 | |\n|---|---|\n|  | - |\n| 2 | 无 | 3 |").strip() == "- 【1】\n- 【2】(对应a)：属性2为3。"
    for same in ("a | b\n|---|", "| a |\n| b |", "|a|\n| |-|", "<table>", "</table> <table><p>x</p></table>", "<TABLE></table>"):
        assert tables.linearize_tables(same) == same
    assert tables.linearize_tables("p <TABLE border=1><tr><td>k</td><td>v</td></tr></TABLE> q") == "p \n\n- 【k】：v。\n\n q"


def test_entities_and_relations(spark):
    response = '{"entities":[{"name":" x ","label":"Tool"},{"name":"x","label":"Tool"},{"name":"x","label":"Part"},{"name":"y","label":"Planet"},{"name":"","label":"Tool"},{"name":"abcdefghijklmnopqrst","label":"Tool"}],"relations":[{"head":"x","tail":"x","type":"FOO"},{"head":"x","tail":"y","type":"AFFECTS"}]}'
    df = spark.createDataFrame([("1", "I", 1, response), ("2", "I", 2, "oops"), ("3", "I", 3, '```json\n{"entities":null}\n```'), ("4", "I", 4, None)], "chunk_id string, item_name string, pos long, response string")
    parsed = graph_build.parse_responses(df)
    assert {r.chunk_id: (r.status, len(r.entities)) for r in parsed.collect()} == {"1": ("ok", 6), "2": ("error", 0), "3": ("ok", 0), "4": ("error", 0)}
    entities = graph_build.clean_entities(parsed)
    assert sorted((r.name, r.label) for r in entities.collect()) == [("abcdefghijklmno", "Tool"), ("x", "Part"), ("x", "Tool")]
    relations = graph_build.clean_relations(parsed)
    assert [(r.head, r.type, r.tail) for r in relations.collect()] == [("x", "RELATED_TO", "x")]
    stats = graph_build.extraction_stats(parsed, entities, relations).collect()[0]
    assert tuple(stats) == (4, 1, 3, 3, 1)
    failed = {r.chunk_id: r.reason for r in graph_build.failed_chunks(parsed, entities).collect()}
    assert failed == {"2": "bad response", "3": "no valid entity", "4": "bad response"}


def test_merge_nodes(spark):
    df = spark.createDataFrame([("1", "I", 1, 0, "x", "Tool", "d1"), ("2", "I", 2, 0, "x", "Part", None), ("3", "I", 3, 0, "x", "Tool", "d3")], "chunk_id string, item_name string, pos long, seq int, name string, label string, description string")
    r = graph_build.merge_nodes(df).collect()[0]
    assert (r.labels, r.description, r.source_chunk_id) == (["Part", "Tool"], "d3", "1")


def test_rrf(spark):
    legs = {leg: spark.createDataFrame([(1, i, str(c), "t") for i, c in enumerate(ids, 1)], "query_id long, rank int, chunk_id string, content string") for leg, ids in (("vector", [1, 2, 3]), ("hyde", [2, 1, 4]), ("graph", [5, 1]))}
    got = [(r.chunk_id, r.score) for r in fusion.rrf(fusion.union_legs(legs)).orderBy("rank").collect()]
    assert got == [("1", 0.043813), ("2", 0.032522), ("3", 0.015873), ("4", 0.015873), ("5", 0.011475)]


@pytest.mark.parametrize(("scores", "kept"), [([5.0, 4.9, 4.8, 4.7, 1.0], 4), ([5.0, 1.0, 0.9], 3), ([1.0] * 12, 10), ([1.0], 1), ([5.0, None, None, None], 4)])
def test_cliff(spark, scores, kept):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores, 1)], "query_id long, rank int, score double")
    assert fusion.cliff_cut(df).count() == kept


def test_graph_search(spark):
    nodes = spark.createDataFrame([("I", n) for n in ("battery", "battery cover", "Battery case", "old battery box")], "item_name string, name string")
    pairs = spark.createDataFrame([(1, 1, "I", "battery"), (2, 1, "I", "BATTERY")], "query_id long, pos int, item_name string, entity string")
    got = graph_search.find_seeds(pairs, nodes).orderBy("query_id", "seed_no").collect()
    assert [(r.query_id, r.name) for r in got] == [(1, "battery"), (2, "Battery case"), (2, "battery"), (2, "battery cover")]
    seeds = spark.createDataFrame([(1, 1, "I", "A")], "query_id long, seed_no int, item_name string, name string")
    edges = spark.createDataFrame([("I", "A", "X", "B"), ("I", "A", "X", "C"), ("I", "A", "MENTIONED_IN", "D")], "item_name string, head string, type string, tail string")
    mentions = spark.createDataFrame([("I", n, c) for c, names in (("c1", "AB"), ("c2", "A"), ("c3", "BC")) for n in names], "item_name string, name string, chunk_id string")
    triples = graph_search.one_hop(seeds, edges)
    assert triples.count() == 2
    found = graph_search.lookup_chunks(graph_search.node_weights(seeds, triples), mentions).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.hits) for r in found] == [("c1", 3.0, 2), ("c3", 2.0, 2), ("c2", 2.0, 1)]
    assert graph_search.node_weights(seeds, triples.where("false")).count() == 0


def test_alignment_and_routes(spark):
    rows = [(1, 0, "n", "a", 0.72), (1, 0, "n", "b", 0.71), (2, 0, "b", "a", 0.72), (2, 0, "b", "b", 0.71), (3, 0, "n", "a", 0.75), (4, 0, "n", "a", 0.65), (4, 0, "n", "b", 0.61), (4, 0, "n", "c", 0.59), (5, 0, "n", "a", 0.1)]
    aligned = items.align_items(spark.createDataFrame(rows, "query_id long, ext_pos int, extracted_name string, item_name string, score double"))
    assert {r.query_id: (r.confirmed, r.options) for r in aligned.collect()} == {1: ([], ["a", "b"]), 2: (["b"], []), 3: (["a"], []), 4: ([], ["a", "b"]), 5: ([], [])}
    assert {r.query_id: r.route for r in items.decide_route(aligned).collect()} == {1: "clarify", 2: "search", 3: "search", 4: "clarify", 5: "fallback"}
    scores = spark.createDataFrame([(1, 0, c, s) for c, s in (("a", 0.9), ("b", 0.88), ("c", 0.7))], "query_id long, pos int, item_name string, score double")
    assert sorted(r.item_name for r in items.filter_confirmed(scores.drop("score"), scores.drop("pos")).collect()) == ["a", "b"]


def test_strip_item_names(spark):
    df = spark.createDataFrame([("RS-12数字万用表如何测量直流电压", ["RS PRO RS-12 数字万用表"]), ("abc", ["abc"]), (None, None)], "q string, n array<string>")
    assert [r[0] for r in df.select(items.strip_item_names(F.col("q"), F.col("n"))).collect()] == ["如何测量直流电压", "abc", None]
    df = spark.createDataFrame([("How does the ab-12  work? rs 9", ["AB-12", "RS-9 (Pro)"]), ("pro (x) at a.b\\E", ["(x)", "a.b\\E"]), ("keep a-b", ["a"]), ("no names", [])], "q string, n array<string>")
    assert [r[0] for r in df.select(items.strip_item_names(F.col("q"), F.col("n"))).collect()] == ["How does the work? 9", "pro at", "keep b", "no names"]


def test_budget(spark):
    df = spark.createDataFrame([(1, i, "x" * n, 12) for i, n in enumerate((4, 4, 9, 1), 1)], "query_id long, pos int, entry string, budget int")
    got = prompts.budget_prefix(df, 2).orderBy("pos").collect()
    assert [r.fits for r in got] == [True, True, False, False] and got[0]["left"] == 0


def test_history(spark):
    rows = [(f"m{i}", "s", "user", f"t{i}", None, None, float(i)) for i in range(1, 13)] + [("z", "o", "system", "t", None, ["k"], 1.0)]
    df = spark.createDataFrame(rows, "_id string, session_id string, role string, text string, rewritten_query string, item_names array<string>, ts double")
    mine = df.where("session_id = 's'")
    assert [r.ts for r in history.recent_messages(mine).orderBy("pos").collect()] == [float(i) for i in range(3, 13)]
    assert [r.ts for r in history.recent_messages(mine, order="first").orderBy("pos").collect()] == [float(i) for i in range(1, 11)]
    changed = history.backfill_item_names(df, spark.createDataFrame([("m1", ["x"]), ("z", ["x"])], "_id string, items array<string>"))
    assert {r._id: r.item_names for r in changed.where("_id in ('m1', 'm2', 'z')").collect()} == {"m1": ["x"], "m2": None, "z": ["k"]}
    left, gone = history.delete_sessions(df, spark.createDataFrame([("o",)], "session_id string"))
    assert left.count() == 12 and gone.collect()[0].removed == 1
    new = spark.createDataFrame([(None, "s", "user", "new", None, None, 99.0), ("m1", "s", "user", "edit", None, None, 1.0), ("nope", "s", "user", "n", None, None, 1.0)], df.schema)
    saved = history.save_messages(df, new)
    assert saved.count() == 14 and saved.where("_id = 'm1'").collect()[0].text == "edit"


def test_answer_images(spark):
    text = "See\n【图片】\nhttp://h/a b.png\nhttp://h/x.txt\nhttp://h/a b.png"
    r = spark.createDataFrame([(text,), ("plain",), (None,)], "a string").select(T.answer_images(F.col("a")).alias("x")).select("x.*").collect()
    assert (r[0].text, r[0].images) == ("See", ["http://h/a%20b.png"]) and r[1].images == [] and r[2].text == ""


def test_images(spark):
    docs = spark.createDataFrame([(1, "# H\np1\n\n![x](i/ba.png)\n\np2\n# N\n![y](i/BA.PNG)")], "doc_id long, md string")
    names = spark.createDataFrame([(1, "ba.png")], "doc_id long, image_name string")
    r = images.image_context(docs, names).collect()[0]
    assert (r.heading, r.before, r.after) == ("# H", "p1", "p2")
    refs = spark.createDataFrame([(1, [("a.png", "pic", "http://u")])], "doc_id long, refs array<struct<name:string,summary:string,url:string>>")
    assert images.rewrite_images(docs, refs).collect()[0].md.count("![pic](http://u)") == 2


def test_vectors(spark):
    t = spark.createDataFrame([(1, "I", [1.0, 0.0], {"a": 2.0}), (2, "I", [0.6, 0.8], {"a": 1.0, "b": 5.0}), (3, "J", [1.0, 0.0], {"a": 9.0}), (4, "I", [], {})], "chunk_id long, item_name string, dense array<float>, sparse map<string,double>")
    q = spark.createDataFrame([(7, "I", [1.0, 0.0], {"b": 1.0})], "query_id long, item_name string, q_dense array<float>, q_sparse map<string,double>")
    assert [(r.chunk_id, r.score) for r in vectors.dense_topk(q, t).orderBy("rank").collect()] == [(1, 1.0), (2, 0.6)]
    assert [(r.chunk_id, r.score) for r in vectors.sparse_topk(q, t, item="item_name").collect()] == [(2, 5.0)]
    assert [r.chunk_id for r in vectors.hybrid_search(q, t).orderBy("rank").collect()] == [2, 1]
    assert vectors.valid_vectors(t).count() == 3


def test_models(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "text string")
    assert models.embed(df, "text").select(F.size("dense").alias("n")).collect()[0].n == models.DIM

    def client():
        calls = []

        def ask(prompt):
            calls.append(prompt)
            if prompt == "c":
                raise RuntimeError("down")
            return prompt.upper() if len(calls) > 1 else 1 / 0

        return ask

    assert {r.text: r.response for r in models.complete(df.coalesce(1), "text", client, wait=0.0).collect()} == {"a b": "A B", "c": ""}


def test_files_and_stream(spark, tmp_path):
    from retrieval_jobs.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.md").write_text("# A\nbody one")
    (tmp_path / "in" / "two.md").write_text("# B\nbody two")
    (tmp_path / "in" / "x.PNG").write_bytes(b"1")
    (tmp_path / "in" / "y.png").write_bytes(b"1")
    assert sorted(r.file_title for r in files.read_markdown(spark, str(tmp_path / "in")).collect()) == ["one", "two"]
    assert [r.image_name for r in files.list_images(spark, str(tmp_path / "in")).collect()] == ["y.png"]
    out, ck = str(tmp_path / "chunks"), str(tmp_path / "ck")
    ingest_stream(spark, str(tmp_path / "in"), out, ck).awaitTermination()
    assert files.read_chunks(spark, out).count() == 2
    (tmp_path / "in" / "three.md").write_text("# C\nbody three")
    ingest_stream(spark, str(tmp_path / "in"), out, ck).awaitTermination()
    got = files.read_chunks(spark, out)
    assert sorted(r.file_title for r in got.collect()) == ["one", "three", "two"]
    files.write_chunks(got.where("item_name = 'one'"), out, "item")
    assert files.read_chunks(spark, out).count() == 3
    path, got = str(tmp_path / "items"), files.read_chunks(spark, out)
    for _ in range(2):
        files.append_item_names(got.select("file_title", "item_name", "dense", "sparse"), path)
    assert spark.read.parquet(path).count() == 6


def test_partition_count_does_not_matter(spark, sf_dir):
    from retrieval_jobs.plans import queries

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted(map(tuple, queries.answer_context(spark, sf_dir).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert run(1) == run(16)


def test_blocks_change_nothing(spark, monkeypatch):
    """Documents scanned in blocks of three rows give what one block gives; null ids and repeated headings included."""
    from retrieval_jobs.operators import segments

    md = "\n".join(["", "pre"][i % 2] if i < 4 else ("```" if i % 13 == 0 else "#" * (1 + i * 7 % 6) + f" h{i % 4}" if i % 3 == 0 else f" l{i} " * (i % 5)) for i in range(120))
    docs = spark.createDataFrame([(1, "A", md), (2, "B", "# x\n" * 9 + "y"), (3, "C", "\n# x"), (4, "D", "a\n\n\nb\n\n"), (5, "E", "```\n# x\n```\n## y\n" * 5), (6, "F", "")], "doc_id long, file_title string, md string")

    def run():
        sections = chunking.parent_titles(chunking.split_headings(docs))
        return [sorted(map(str, df.collect())) for df in (sections, chunking.number_parts(chunking.size_sections(sections, 60, 20)))]

    whole = run()
    monkeypatch.setattr(segments, "ROWS", 3)
    assert run() == whole and len(whole[0]) > 30
    assert chunking.split_headings(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() > 0


def test_alignment_of_several_names(spark):
    """The names of a question in order: lists grow, nothing is listed twice, options stay beside later confirmed names."""
    rows = [(1, 2, "x", "c", 0.65), (1, 2, "x", "a", 0.66), (1, 0, "a", "a", 0.9), (1, 0, "a", "b", 0.8), (1, 1, "y", "b", 0.7), (1, 1, "y", "d", 0.71), (1, 1, "y", "a", 0.9), (1, 1, "y", "e", 0.7), (1, 3, "d", "d", 0.95), (1, 4, "z", None, None)]
    got = items.align_items(spark.createDataFrame(rows, "query_id long, ext_pos int, extracted_name string, item_name string, score double")).collect()
    assert [(r.confirmed, r.options) for r in got] == [(["a", "d"], ["d", "b", "c"])]


def test_sparse_search_against_all_products(spark):
    """Pruned postings give the best of all inner products, with common words, weights below zero, ties and questions of several items."""
    import random

    r = random.Random(3)
    common = [f"c{i}" for i in range(4)]
    chunk = lambda: {w: round(r.choice([-1, 1, 1, 1]) * r.random() ** 4 * 8, 3) for w in common + [f"w{r.randint(0, 60)}" for _ in range(6)]}
    rows = [(i, f"I{i % 2}", chunk()) for i in range(400)] + [(900, "I0", {}), (901, "I0", None), (902, None, {"c0": 9.0}), (903, "I0", {"c0": 0.0})]
    rows += [(904 + i, "I1", rows[1][2]) for i in range(8)]
    asks = [(q, f"I{(q + j) % 2}", chunk()) for q in range(30) for j in range(1 + q % 3 // 2)] + [(77, "I0", {"none": 1.0}), (78, "I1", {"w5": 1.0}), (79, "I1", rows[1][2])]
    t = spark.createDataFrame(rows, "chunk_id long, item_name string, sparse map<string,double>")
    q = spark.createDataFrame(asks, "query_id long, item_name string, q_sparse map<string,double>")
    for item in ("item_name", None):
        want: dict = {}
        for i, own, words in asks if item else {a[0]: a for a in asks}.values():
            for c, other, weights in rows:
                if weights and set(weights) & set(words) and (not item or own == other):
                    want.setdefault(i, []).append((-round(sum(w * weights.get(x, 0) for x, w in words.items()), 6), c))
        best = {(i, n, c, -s) for i, hits in want.items() for n, (s, c) in enumerate(sorted(hits)[:5], 1)}
        asked = q if item else spark.createDataFrame(list({a[0]: a for a in asks}.values()), q.schema)
        got = {(x.query_id, x.rank, x.chunk_id, x.score) for x in vectors.sparse_topk(asked, t, item=item).collect()}
        assert got == best and len(best) > 100


def test_scores_are_shown_as_printf_shows_them(spark, duck):
    """Scores of six digits halfway between two of four: the exact binary value decides."""
    rows = spark.range(5, 100000, 10).select((F.col("id") * 10 / 1000000.0).alias("s"))
    told = T.format_doc(F.lit(1), *[F.lit(None).cast("string")] * 4, F.col("s"), F.lit("x"))
    got = {r.s: r.told for r in rows.select("s", told.alias("told")).collect()}
    want = duck.sql("SELECT s, '[1] [score=' || printf('%.4f', s) || ']' || chr(10) || 'x' AS told FROM (SELECT i * 10 / 1000000.0::DOUBLE AS s FROM range(5, 100000, 10) t(i))").df()
    assert len(got) == 10000 and got[0.01635].startswith("[1] [score=0.0163]")
    assert got == dict(zip(want.s, want.told, strict=True))
    nothing = spark.range(1).select(T.format_doc(F.lit(1), *[F.lit(None).cast("string")] * 4, F.lit(None).cast("double"), F.lit("x")).alias("told"))
    assert nothing.first().told == "[1]\nx"
