"""Token counts, source divergence and phrases against plain versions and DuckDB SQL on awkward rows."""

import collections
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retrieval_jobs.llm import common, divergence, phrases, queries, token_counts
from tests.test_oracles import rows

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_tokens long, rank string"


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


ODD = "ab'stre  \n!.,<|>-09éüßİΣ中ệ̸́\x1c 　①ǅ"


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(st.sampled_from(ODD), max_size=24), st.text(max_size=12), st.text(st.sampled_from("<|endoftext|> a'll"), max_size=30)))
def test_every_prefix_as_the_library(counter, library, text):
    text = text.encode("utf-8", "ignore").decode()
    whole = counter.nfc(text)
    want = library([whole[: k + 1] for k in range(len(whole))]) if whole else []
    assert list(counter.prefixes(text)) == want
    assert counter.total(text) == library([text])[0]
    for limit in (0, 2, 5):
        assert counter.within(text, limit) == max([0, *(k + 1 for k, n in enumerate(want) if n <= limit)])


def test_long_words(counter, library):
    for text in ("a" * 30_000, "é中a1" * 2_000 + "'s!!é'll", "<|endoftext|>" * 3 + "x<|endoftext|", "-" * 9_000):
        assert counter.total(text) == library([text])[0]


def test_latin_words_need_no_library(counter, library, monkeypatch):
    """All of Latin-1 in random order: the pieces and counts of the library, which is not asked."""
    rng = random.Random(5)
    latin = [chr(c) for c in range(1, 256)]
    texts = ["".join(rng.choices(latin, k=40)) for _ in range(300)] + ["".join(rng.choices("ÀÉßªº²¼µ×'sa1ré", k=30)) for _ in range(300)]
    want = library(texts)
    monkeypatch.setattr(counter, "cut", None)
    monkeypatch.setattr(counter, "normal", None)
    assert [counter.total(t) for t in texts] == want


def test_words_asked_again_are_remembered(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 40)
    asked = []
    kept = token_counts._Remembered(lambda w: asked.append(w) or 0)
    for i in range(500):
        assert kept["often"] == kept[f"once {i}"] == 0
        assert len(kept) + len(kept.older) <= 40
    assert asked.count("often") == 1


def test_a_worker_keeps_its_counter_for_a_query():
    first = token_counts.worker_counter(PATH, "one")
    assert token_counts.worker_counter(PATH, "one") is first
    assert token_counts.worker_counter(PATH, "two") is not first


def test_whole_texts_as_the_library(spark, sf_dir, library):
    got = queries.op11_token_counts(spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    texts = docs["text"].fillna("")
    assert got["n_tokens"].loc[docs.index].tolist() == library(texts.tolist())
    assert got["n_bytes"].loc[docs.index].tolist() == [len(t.encode()) for t in texts]
    assert (got["over_limit"] == (got["n_tokens"] > 2048)).all() and got["over_limit"].any()
    for doc in got.index[got["over_limit"]][:3]:
        cut = got["cut"][doc]
        assert library([texts[doc][:cut]])[0] <= 2048 < library([texts[doc][: cut + 40]])[0]


def test_budgets_from_the_table(spark, counter):
    text = "Hello worlds, don't we'll <|endoftext|> go? " * 300
    docs = spark.createDataFrame([(1, text), (2, "ab cd"), (3, None), (4, "")], "doc_id long, text string")
    table = token_counts.prefix_table(docs, PATH)
    want = list(counter.prefixes(text))
    pieces = {(r.doc_id, r.first): r.counts for r in table.collect()}
    assert sum((pieces[k] for k in sorted(pieces) if k[0] == 1), []) == want and set(k[0] for k in pieces) == {1, 2}
    asked = spark.createDataFrame([(1, 0), (1, 7), (1, 2000), (1, 10**6), (2, 1), (3, 5), (9, 5)], "doc_id long, budget long")
    got = {(r.doc_id, r.budget): r.chars for r in token_counts.longest_within(table, asked).collect()}
    for budget in (0, 7, 2000, 10**6):
        assert got[1, budget] == counter.within(text, budget)
    assert got[2, 1] == counter.within("ab cd", 1) and got[3, 5] == got[9, 5] == 0
    places = spark.createDataFrame([(1, 0), (1, 1), (1, 4096), (1, 4097), (2, 5), (2, 6)], "doc_id long, chars long")
    got = {(r.doc_id, r.chars): r.n_tokens for r in token_counts.tokens_at(table, places).collect()}
    assert got == {(1, 0): 0, (1, 1): want[0], (1, 4096): want[4095], (1, 4097): want[4096], (2, 5): 2, (2, 6): None}


def test_token_counts_of_awkward_rows(spark, library):
    docs = spark.createDataFrame([(1, None, None, None, 5, "x"), (None, "", "en", "a", 5, "x"), (2, "Tie tie", "en", "a", 5, "x"), (2, "Tie tie", "en", "a", 5, "x"), (None, "x", None, None, 5, "x")], DOCS)
    with pytest.raises(ValueError, match="n_tokens"):
        token_counts.count_tokens(docs, PATH)
    got = token_counts.count_tokens(docs, PATH, limit=1, names=("bytes", "tokens", "over", "cut"))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "rank", "bytes", "tokens", "over", "cut"]
    assert sorted(map(tuple, got.select("bytes", "tokens", "over", "cut").collect())) == [(0, 0, False, 0), (0, 0, False, 0), (1, 1, False, 1), (7, 2, True, 4), (7, 2, True, 4)]
    assert token_counts.count_tokens(docs.limit(0), PATH, keep=["doc_id"]).count() == 0


def odd_documents(spark):
    """Nulls, repeats, case and punctuation variants of one term in one document, ties, other scripts, white space that isn't ASCII, a language without terms."""
    rnd = random.Random(3)
    words = ["Alpha", "alpha,", "ALPHA", "beta", "beta;x", "gämma", "ÉTÉ", "été", "中文 字", "d1d", "(eps)", "eps'eps", "x y", "\x0b", "zeta\x00eta"]
    out = [(None if i % 9 == 0 else i // 2, None if i % 13 == 0 else rnd.choice([" ", "\n", "\t"]).join(rnd.choices(words, k=rnd.randint(0, 12))), rnd.choice(["en", "en", "fr", None, "xx"]), rnd.choice(["a", "b", "b", None, ""]), i, "r") for i in range(300)]
    out += [(7, "only once", "zz", "s", 1, "r"), (7, "", "zz", "t", 1, "r"), (8, "rare " * 3 + "w" * 70_000, "en", "long", 1, "r")]
    return spark.createDataFrame(out, DOCS)


def as_sql(sql, docs):
    con = duckdb.connect()
    con.register("frame", docs.toPandas())
    con.sql("create table documents as select * from frame")
    return con.sql(sql.format(docs="documents")).df()


def equal(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_divergence_of_awkward_rows(spark, monkeypatch):
    docs = odd_documents(spark)
    got = divergence.divergence(docs).toPandas()
    equal(got, as_sql(divergence.SQL, docs))
    assert {("pair", "en"), ("term", "en"), ("pair", "zz")} <= set(zip(got["part"], got["lang"], strict=True)) and not (got[got["lang"] == "zz"]["part"] == "term").any()
    monkeypatch.setattr(divergence, "TILE", 2)  # several tiles and groups
    monkeypatch.setattr(divergence, "GROUP_TERMS", 3)
    assert rows(divergence.divergence(docs).toPandas()) == rows(got)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_terms_held_by_several_chunks_of_a_document(spark):
    """A term under several chunks: its documents lie between the largest chunk and the sum, and decide."""
    variants = ["word", "Word,", "WORD!"]
    near = [(i, " ".join(variants[: 1 + i % 3]) if i < 29 else "other", "en", "a" if i % 2 else "b", 1, "") for i in range(60)]
    over = [(i, f"{variants[i % 3]} edge", "fr", "a", 1, "") for i in range(30)]
    docs = spark.createDataFrame(near + over, DOCS)
    got = divergence.divergence(docs).toPandas()
    equal(got, as_sql(divergence.SQL, docs))
    kept = {(r.lang, r.term) for r in divergence.term_uses(docs.withColumn("group", F.xxhash64("lang", "source"))).collect()}
    assert kept == {("en", "other"), ("fr", "word"), ("fr", "edge")}


def test_keys_that_clash_are_chosen_anew(spark, monkeypatch):
    docs = odd_documents(spark).na.fill("", ["text", "lang", "source"]).withColumn("group", F.xxhash64("lang", "source"))
    want = rows(divergence.term_uses(docs).toPandas())
    found = divergence.chunk_documents
    monkeypatch.setattr(divergence, "chunk_documents", lambda d, salt=0: found(d, salt).withColumn("key", F.col("key") if salt else F.lit(1).cast("long")))
    assert rows(divergence.term_uses(docs).toPandas()) == want


def repeated(spark, times=130):
    rnd = random.Random(5)
    common = ["the", "of", "a", "b,", "c", "D.", "e\tf"]
    passage = "One two  three four five six"
    out = [(i if i % 7 else None, " ".join(rnd.choices(common, k=rnd.randint(0, 30))) + (f" {passage}" if i % 2 else f"\n{passage}! ha ha ha ha ha ha") if i % 11 else None, rnd.choice(["en", "en", None, "und"]), "s", i, "") for i in range(2 * times)]
    return spark.createDataFrame(out, DOCS)


@pytest.mark.parametrize("shards", [1, 3])
def test_phrases_of_awkward_rows(spark, shards):
    docs = repeated(spark)
    got = phrases.collocations(docs, shards=shards).toPandas()
    equal(got, as_sql(phrases.SQL, docs))
    assert len(got) and got["phrase"].str.count(" ").max() == 4
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_frequencies_of_all_lengths(spark):
    """Every frequent phrase has its exact count, whenever in the circle it became active."""
    docs = repeated(spark, 70).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    want = collections.Counter()
    for lang, text in docs.collect():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for mark in ".,;:!?\x0a\x0b\x0c\x0d":
            lower = lower.replace(mark, "\n")
        for piece in lower.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            want[lang, ""] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    want[lang, " ".join(words[i : i + n])] += 1
    for least in (5, 40):
        got = {(r.lang, r.phrase): r.n for r in phrases.frequent_phrases(docs, least).collect()}
        assert got == {k: n for k, n in want.items() if n >= least or k[1] == ""}


def test_plans_of_phrases_do_not_grow_with_the_steps(spark, monkeypatch):
    """The driver holds the plans of every step: each scans its three counts, what is likely in them for each, and all that was found before at once.
    What a step adds is found by a plan that runs as it stands, without a thread for each exchange."""
    sizes, kept = [], phrases.settled

    def settled(df, by=None, fixed=False):
        sizes.append((by, fixed, len(df._jdf.queryExecution().executedPlan().collectLeaves().mkString("\n").split("FileScan parquet")) - 1))
        return kept(df, by, fixed)

    monkeypatch.setattr(phrases, "settled", settled)
    phrases.frequent_phrases(repeated(spark, 70).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), 40)
    assert sum(by == "h" for by, _, _ in sizes) == sum(fixed for _, fixed, _ in sizes) > 4
    assert max(n for _, _, n in sizes) <= 13
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_a_step_sums_its_counts_where_they_lie(spark):
    """No count of a circle goes through an exchange, and only the newest parts are read; bitmaps come to the driver in one job."""
    circle = common.Circle(spark, "h long, n long", "h")
    tables = [common.settled(spark.createDataFrame(rows, "h long, n long").repartition(4, "h"), by="h") for rows in ([(1, 9), (2, 9), (3, 1)], [(1, 3), (3, 4), (4, 2)], [(1, 1), (3, 2), (4, 9)])]
    for k, t in enumerate(tables):
        circle.add(t, k)
    circle.add(common.settled(spark.createDataFrame([], "h long, n long"), by="h"), 3)
    new = phrases._reached(circle.rows(), 3, None, 7)
    spark.conf.set(common.ADAPTIVE, "false")
    try:
        plan = phrases._reached(circle.rows(), 3, None, 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(common.ADAPTIVE)
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    assert {r.h for r in new.collect()} == {1, 2, 3, 4}
    circle.leave(0)
    assert {r.h for r in phrases._reached(circle.rows(), 2, spark.createDataFrame([(4,)], "h long"), 6).collect()} == {3}
    circle.drop()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("bits of many partitions", "")
    try:
        bits = common.bitmap(spark.range(0, 1 << 20, 40_000).select("id"), 1 << 20)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bits of many partitions")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setJobGroup("others", "")
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == list(range(0, 1 << 20, 40_000))
    assert len(jobs) <= 2
