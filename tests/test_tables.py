"""Versioned tables, the whole import, kept answers, block search, name index and spans."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrieval_jobs.operators import graph_build, graph_search, models, tables, vectors
from retrieval_jobs.sources import files, versions
from retrieval_jobs.streaming import ingest


def rows(df):
    return sorted(map(str, df.collect()))


def state(spark, path):
    return {name: rows(versions.read_table(spark, path, name)) for name in versions.manifest(spark, path)["tables"]}


def frame(spark, data, columns="item_name string, n int"):
    return spark.createDataFrame(data, columns)


def test_replaced_items_and_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read_table(spark, path, "a") is None and versions.manifest(spark, path)["tables"] == {}
    versions.commit(spark, path, {"a": frame(spark, [("x", 1), ("y", 2), (None, 3)]), "b": frame(spark, [("x", 1), ("z", 5)])})
    versions.commit(spark, path, {"a": frame(spark, [("x", 7), (None, 8)]), "b": frame(spark, [])})
    assert rows(versions.read_table(spark, path, "a")) == rows(frame(spark, [("x", 7), ("y", 2), (None, 8)]))  # null items are replaced, not doubled
    assert rows(versions.read_table(spark, path, "b")) == rows(frame(spark, [("z", 5)]))  # x has no row in b any more
    versions.commit(spark, path, {"a": frame(spark, [])}, items=frame(spark, [("y", 0)]))
    assert rows(versions.read_table(spark, path, "a")) == rows(frame(spark, [("x", 7), (None, 8)]))
    versions.commit(spark, path, {"a": frame(spark, [("x", 9)])}, mode="append")
    assert versions.read_table(spark, path, "a").count() == 3
    before = versions.read_table(spark, path, "a")
    versions.commit(spark, path, {"a": frame(spark, [("q", 1)])}, mode="full")
    assert before.count() == 3 and rows(versions.read_table(spark, path, "a")) == rows(frame(spark, [("q", 1)]))  # readers keep what they opened
    assert versions.vacuum(spark, path) > 0 and versions.vacuum(spark, path) == 0
    assert rows(versions.read_table(spark, path, "a")) == rows(frame(spark, [("q", 1)])) and versions.read_table(spark, path, "b").count() == 1


def test_failure_in_the_middle_and_repetition(spark, tmp_path):
    path = str(tmp_path / "t")
    good = {"a": frame(spark, [("x", 1)]), "b": frame(spark, [("x", 2)])}
    versions.commit(spark, path, good, batch=("w", 1))
    want = state(spark, path)
    broken = frame(spark, [("x", 9)]).withColumn("n", F.when(F.col("n") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, path, {"a": frame(spark, [("x", 8), ("y", 8)]), "b": broken}, batch=("w", 2))
    assert state(spark, path) == want
    assert not versions.commit(spark, path, {"a": frame(spark, [("x", 5)])}, batch=("w", 1)) and state(spark, path) == want
    assert versions.commit(spark, path, {"a": frame(spark, [("x", 5)])}, batch=("w", 2))
    (tmp_path / "t" / "manifests" / f"{99:012d}").write_text('{"tables": {')  # a writer died while it wrote its manifest
    assert rows(versions.read_table(spark, path, "a")) == rows(frame(spark, [("x", 5)]))
    versions.commit(spark, path, {"a": frame(spark, [("y", 6)])})
    assert versions.read_table(spark, path, "a").count() == 2 and versions.manifest(spark, path)["taken"] == 100


def test_two_writers(spark, tmp_path, monkeypatch):
    path, create, other = str(tmp_path / "t"), versions._create, []

    def late(spark, name, text):
        if not other:
            other.append(1)
            versions.commit(spark, path, {"a": frame(spark, [("x", 1), ("y", 1)])})
        return create(spark, name, text)

    monkeypatch.setattr(versions, "_create", late)
    versions.commit(spark, path, {"a": frame(spark, [("x", 2), ("z", 2)])})
    assert rows(versions.read_table(spark, path, "a")) == rows(frame(spark, [("x", 2), ("y", 1), ("z", 2)]))
    assert not list(tmp_path.glob("t/data/*/new"))


def extract(chunks):
    """Every capitalised word is a part; neighbours are related."""
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Z]\w+"), F.lit(0)))
    entity = F.transform(words, lambda w: F.struct(w.alias("name"), F.lit("Part").alias("label"), F.concat(w, F.lit(" in "), F.col("chunk_id")).alias("description")))
    pair = F.transform(F.slice(words, 2, 99), lambda w, i: F.struct(F.get(words, i).alias("head"), F.lit("HAS_PART").alias("type"), w.alias("tail")))
    return chunks.select("chunk_id", "item_name", "pos", F.to_json(F.struct(entity.alias("entities"), pair.alias("relations"))).alias("response"))


def documents(spark, **texts):
    return spark.createDataFrame([(i, name, md) for i, (name, md) in enumerate(sorted(texts.items()))], "doc_id long, file_title string, md string")


def test_import_of_all_tables(spark, tmp_path, monkeypatch):
    first = documents(spark, pump="# Pump\nThe Rotor drives the Shaft.", fan="# Fan\nThe Blade.")
    second = documents(spark, pump="# Pump\nThe Valve holds.", gone="")
    once, again = str(tmp_path / "once"), str(tmp_path / "again")
    assert ingest.ingest_batch(first, once, extract=extract, batch=("s", 0))
    assert {r.name for r in versions.read_table(spark, once, "nodes").collect()} >= {"Rotor", "Shaft", "Blade"}
    assert ingest.ingest_batch(second, once, extract=extract, batch=("s", 1))
    names = {(r.item_name, r.name) for r in versions.read_table(spark, once, "nodes").collect()}
    assert ("pump", "Valve") in names and ("pump", "Rotor") not in names and ("fan", "Blade") in names
    assert {"chunks", "entities", "nodes", "edges", "mentions"} == set(versions.manifest(spark, once)["tables"])
    assert all(len(r.dense) and r.sparse for r in versions.read_table(spark, once, "entities").collect())

    create = versions._create
    monkeypatch.setattr(versions, "_create", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        ingest.ingest_batch(first, again, extract=extract, batch=("s", 0))
    monkeypatch.setattr(versions, "_create", create)
    assert versions.manifest(spark, again)["tables"] == {}
    for batch, docs in ((0, first), (0, first), (1, second), (1, second)):
        ingest.ingest_batch(docs, again, extract=extract, batch=("s", batch))
    assert state(spark, again) == state(spark, once)
    assert not ingest.ingest_batch(first, again, extract=extract, batch=("s", 1)) and state(spark, again) == state(spark, once)


def test_answers_are_kept(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "answers")

    def client():
        def ask(prompt):
            with open(calls, "a") as f:
                f.write(prompt + "\n")
            return "" if prompt == "fails" else prompt.upper()

        return ask

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "fails")], "id int, p string")
    want = {1: "A", 2: "B", 3: "A", 4: "", 5: ""}
    for _ in range(2):
        assert {r.id: r.response for r in models.complete_once(df, "p", client, path, wait=0.0).collect()} == want
    more = df.unionByName(spark.createDataFrame([(6, "c")], "id int, p string"))
    assert models.complete_once(more, "p", client, path).columns == ["id", "p", "response"]
    said = calls.read_text().split("\n")[:-1]
    assert sorted(x for x in said if x in "abc" and x) == ["a", "b", "c"] and said.count("fails") == 3  # what failed is asked again


def test_block_search_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 16)
    data = [(i, f"i{i % 3}", rng.normal(size=6).round(1).tolist()) for i in range(200)]
    data += [(200 + i, "i0", [1.0] + [0.0] * 5) for i in range(60)]  # equals
    data += [(300, "i0", [0.0] * 6), (301, "i1", None), (302, "i1", [1.0, 2.0]), (303, "i2", [float("nan")] * 6), (304, None, [1.0] * 6)]
    t = spark.createDataFrame(data, "chunk_id long, item_name string, dense array<double>")
    q = t.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "item_name", F.col("dense").alias("q_dense"))
    real = {i: (item, np.array(v)) for i, item, v in data if v and len(v) == 6 and np.isfinite(v).all() and any(v)}
    for item in ("item_name", None):
        got = {}
        for r in vectors.dense_topk(q, t, 5, item).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        for i, (own, v) in real.items():
            if i % 10 == 0 and (own or item is None):
                near = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 6), j) for j, (other, w) in real.items() if item is None or other == own)[:5]
                assert [c for c, _ in got[i]] == [j for _, j in near]
                assert np.allclose([s for _, s in got[i]], [-s for s, _ in near], atol=2e-6)
        assert not {300, 301, 302, 303} & set(got)
    plan = vectors.dense_topk(q, t)._jdf.queryExecution().toString()
    assert "Nested" not in plan and "Cartesian" not in plan


def test_name_index_against_contains(spark):
    rnd = random.Random(4)
    names = ["".join(rnd.choices("abAé中 ", k=rnd.randint(1, 7))) for _ in range(120)]
    nodes = spark.createDataFrame([(f"i{i % 2}", n) for i, n in enumerate(names)], "item_name string, name string")
    asked = ["a", "AB", "é中", "aba", "ABab", "zz", "b a", "中", "A" * 9]
    pairs = spark.createDataFrame([(k, 1, f"i{k % 2}", e) for k, e in enumerate(asked)], "query_id int, pos int, item_name string, entity string")
    got = {(r.query_id, r.name) for r in graph_search.find_containing(pairs, graph_search.name_index(nodes)).collect()}
    want = {(k, n) for k, e in enumerate(asked) for i, n in enumerate(names) if i % 2 == k % 2 and e.lower() in n.lower()}
    assert got == want and want
    plan = graph_search.find_seeds(pairs, nodes)._jdf.queryExecution().toString()
    assert "Nested" not in plan and "Cartesian" not in plan


def test_batches_fold_in_any_order(spark):
    rnd = random.Random(6)
    data = [(str(c), "i", c, s, rnd.choice("xy"), rnd.choice(["Part", "Tool"]), rnd.choice([None, f"d{c}-{s}"])) for c in range(8) for s in range(2)]
    e = spark.createDataFrame(data, "chunk_id string, item_name string, pos int, seq int, name string, label string, description string")
    parts = [graph_build.node_states(e.where(F.col("pos").isin(*p))) for p in ([3, 4], [0, 7], [1, 2, 5, 6], [0, 7])]
    folded = parts[0]
    for p in parts[1:]:
        folded = graph_build.fold_nodes(folded, p)
    assert rows(graph_build.nodes_of(folded)) == rows(graph_build.merge_nodes(e))


def test_wide_and_long_spans():
    say = tables.linearize_html_tables
    table = "<table><tr><th>n</th><th>v</th></tr><tr><td rowspan='99999999'>p</td><td>1</td></tr><tr><td>2</td></tr></table>"
    assert say(table) == say(table.replace("99999999", "2"))
    assert say("<table><tr><td colspan='999999999999'>a</td></tr><tr><td>b</td></tr></table>").count("【") >= 1
    over = "<table><tr><th>h</th><th rowspan=3>x</th></tr><tr><td colspan=2>c</td></tr><tr><td>d</td></tr></table>"
    assert "x为x" in say(over)  # the longer span goes on below a shorter one that crosses it


def test_chunk_modes_in_json(spark, tmp_path):
    files.write_chunks(frame(spark, [("x", 1)]), str(tmp_path / "c"))
    last = sorted((tmp_path / "c" / "manifests").glob("0*"))[-1]
    assert set(json.loads(last.read_text())) == {"tables", "batches"}
