"""The pipeline's stages: columns, effects, and clean documents that stay."""

import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from retrieval_jobs.llm import common, secrets

from .test_exact import brute_join, documents


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns
        out = corpus_pipeline.settled(out)
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in out.collect()} == {c for _, c in brute_join(rows).values()}
        if name == "secrets":
            token = re.compile('token = "[0-9a-f]{40}"')
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert out.count() == docs.count()
            for r in out.collect():
                assert r.text == token.sub('token = "[SECRET]"', texts[r.doc_id])
        docs = out
        sizes.append(docs.count())
    assert sizes[1] >= 0.99 * sizes[0] and sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_awkward_rows(spark, sf_dir):
    docs = documents(spark, [None, "", "x", "the same text of a few words here"] * 2, [(None, "no id but a fine text", "en", None, 5)])
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.settled(stage(spark, docs, sf_dir))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, ["a"]).where("false"), sf_dir).count() == 0


def test_mixing_keeps_rows_of_null_and_repeated_ids(spark, sf_dir):
    """Every row with words comes out at most once, with its own text, words and copies."""
    def same(rows):
        docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return docs, corpus_pipeline.mix_to_weights(spark, docs, sf_dir).collect()

    # the tree has one leaf, whose budget is half of all tokens: exactly that many words come out
    docs, got = same([(None, f"n{k}") for k in range(10)] + [(7, f"r{k}") for k in range(6)] + [(8, "x")] * 4)
    assert sum(r.n_tokens * r.copies for r in got) == 10 and len(got) == 10
    texts = [r.text for r in docs.collect()]
    assert all([r.text for r in got].count(t) <= texts.count(t) for t in {r.text for r in got})
    # lone ids: all rows are null, or all share one
    for one in (None, 7):
        _, got = same([(one, "w " * (k + 1)) for k in range(20)])
        assert got and all(r.n_tokens == len(r.text.split()) and r.copies == 1 for r in got)
        assert len({r.text for r in got}) == len(got) and 85 <= sum(r.n_tokens for r in got) <= 105


def test_workers_get_small_batches(spark, sf_dir):
    """After a stage texts of any length reach a worker a few MB at a time; a limit that the session sets itself stays."""
    docs = documents(spark, ["word " * 2000] * 2000).coalesce(1)
    before = spark.conf.get(corpus_pipeline.BATCH, None)
    spark.conf.unset(corpus_pipeline.BATCH)

    def bytes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    try:
        corpus_pipeline.identify_language(spark, docs.where("false"), sf_dir)
        got = docs.select("text").mapInArrow(bytes_of, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 2000
        assert max(r["bytes"] for r in got) < 2 * corpus_pipeline.BATCH_BYTES < sum(r["bytes"] for r in got)
        spark.conf.set(corpus_pipeline.BATCH, "1m")
        corpus_pipeline.identify_language(spark, docs.where("false"), sf_dir)
        assert spark.conf.get(corpus_pipeline.BATCH) == "1m"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)
        if before is not None:
            spark.conf.set(corpus_pipeline.BATCH, before)


def test_labelled_findings_start_no_python(spark):
    """The templates are literals: a list of Python rows is read by Python workers of their own on every executor."""
    assert "ExistingRDD" not in secrets.labelled_findings(spark)._jdf.queryExecution().executedPlan().toString()


def test_powers_are_kept_for_what_was_hashed(monkeypatch):
    """A worker that hashes small blocks keeps small tables; they grow with a longer text and stay the same powers."""
    monkeypatch.setattr(common, "_POWERS", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    small = [p.copy() for p in common._powers(1000)]
    assert len(common._POWERS["up"]) <= 300_000
    for short, long in zip(small, common._powers(common.BLOCK_BYTES + 1), strict=True):
        assert (short == long[:1000]).all() and len(long) == common.BLOCK_BYTES + 1
    assert (common._POWERS["up"] * common._POWERS["down"] == 1).all()
