"""Learned operators: brute force where exact, held-out accuracy otherwise, and edge cases."""

import html
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from retrieval_jobs.llm import decontamination, hmm, html_extraction, language_id, quality, queries
from retrieval_jobs.llm.common import text_blocks

from .test_exact import LOWER, documents


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op4_language_id(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    truth = docs.select("doc_id", "lang", "text").toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.held_out.items())
    assert (held.lang_pred == truth.lang.loc[held.index]).mean() > 0.95
    assert got.rejected.mean() < 0.02
    model = language_id.train(docs)
    odd = documents(spark, [None, "", "123 !?", "Да нет", "x" * 100000])
    r = {x.doc_id: x for x in language_id.identify(odd, model, ["doc_id"]).collect()}
    assert [r[i].lang_pred for i in range(3)] == ["und"] * 3 and all(r[i].rejected and r[i].score == 0 for i in range(3)) and r[3].lang_pred != "und"
    assert language_id.identify(odd.where("false"), model, odd.columns).count() == 0


def test_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(i, f"x{i}", f"a{i}", "src1", 0) for i in range(9)] + [(100 + i, "the cat and the dog", "en", "src1", 0) for i in range(9)] + [(200 + i, "der hund und die katze", "de", "src1", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(language_id.train(docs).languages) == ["de", "en"]


def test_quality(spark, sf_dir):
    got = queries.op6_quality_classifier(spark, sf_dir).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    both = got.join(labels, how="inner")
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    held = both[both.held_out]  # rows whose labels were not learned
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items()) and len(held) > 10
    assert (held.predicted == held.quality).mean() >= max(held.quality.mean(), 1 - held.quality.mean())
    assert held.score[held.quality == 1].mean() > held.score[held.quality == 0].mean() + 0.2
    model = quality.fit(["good text here", "$$$ %%% &&&"] * 5, [1, 0] * 5, least_steps=10)
    odd = documents(spark, [None, "", "y" * 200000])
    assert quality.score(odd, model, ["doc_id"]).count() == 3
    assert quality.score(odd.where("false"), model, ["doc_id"]).count() == 0


def test_quality_chunks_cover_everything():
    for size in (0, 1, 511, 512, 513, 1000, 5000):
        start, end, _ = quality.chunk_starts(np.array([0, size]))
        covered = np.zeros(size, bool)
        for s, e in zip(start, end, strict=True):
            covered[s:e] = True
        assert covered.all()


def test_decontamination(spark):
    item = "the train leaves at 7 and travels 120 km in 2 hours so what is its mean speed then"
    other = item.replace("7", "9").replace("120", "300").replace("2 hours", "3 hours")
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and then some more words to make it long enough"
    noise = " ".join(f"n{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    texts = [f"{noise} {item} {noise}", f"{noise} {other} {noise}", noise, None, "", f"{noise} " + " ".join(long.split()[:16]), item.upper(), "a b"]
    bench = spark.createDataFrame([(1, item), (2, long), (3, None), (None, item), (4, "a b")], "item_id long, text string")
    docs = documents(spark, texts, [(None, item, None, None, 0)])
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert sorted(got) == [(0, 1), (1, 1), (5, 2), (6, 1), (7, 4)]
    assert not got[0, 1].reparameterised and got[1, 1].reparameterised
    shuffled = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, broadcast_windows=0).collect()}
    assert shuffled == set(got)
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == {2, 3, 4, None}
    assert decontamination.contaminated(docs.where("false"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    item = "take 5 red balls and 5 blue balls from the box of 5 and count what is left"
    docs = documents(spark, [item.replace("5", "8"), "take 1 red balls and 2 blue balls from the box of 3 and count what is left"])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(docs, bench).collect()] == [0]


def test_names_that_open_sentences(spark):
    item = "Alice has 5 apples. Bob gives her 3. How many does Alice have now?"
    copy = item.replace("Alice", "Carol").replace("Bob", "Dave").replace("5", "8").replace("3", "6")
    mixed = copy.replace("does Carol", "does Erin")  # one name stands for two
    noise = "some other words come here and there again. "
    docs = documents(spark, [copy, noise * 9 + copy, item, noise * 9, item.replace("apples. Bob", "apples, Bob").replace("Alice", "Carol"), mixed.replace("How many", "How few")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (2_000_000, 0):
        got = {r.doc_id: r.reparameterised for r in decontamination.contaminated(docs, bench, broadcast_windows=most).collect()}
        assert got == {0: True, 1: True, 2: False, 4: True}


def test_items_without_a_template_window(spark):
    items = ["Compute 12 + 35 * 4 - 7", "日本の首都はどこですか", "photosynthesis requires sunlight", "yes", "1 2 3 4 5 6 7 8 9 10 11 12"]
    around = "before it come words {} and after it come more"
    texts = [around.format(t) for t in items] + ["これは問題です。日本の首都はどこですか。答えは東京です", "yes", around.format("Compute 12 + 36 * 4 - 7"), around.format("1 2 3 4 5 6 7 8 9 10 12 11"), "日本の首都は東京です"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (2_000_000, 0):
        got = decontamination.contaminated(documents(spark, texts), bench, broadcast_windows=most).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 1), (6, 3)]


def test_hmm_counts_and_base(spark):
    texts = ["the cat sat", None, "", "the the dog", "The Dog ran away " * 300, "  "] + [f"word{i % 7} the cat" for i in range(40)]
    docs = documents(spark, texts, [(None, "x", None, None, 0)])
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in hmm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [0] for i, t in enumerate(texts)}
    count: dict = {}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    assert set(got) == set(words)
    for i, w in words.items():
        base = sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in count for x in w), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and np.isfinite(got[i].score)
    assert hmm.score_texts(docs.where("false"), F.lit(True)).count() == 0


def test_forward_is_exact(monkeypatch):
    rng = np.random.default_rng(5)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    k = hmm.STATES
    model = hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((hmm.CLASSES, k)), 0))
    lengths = [1, 3, 7, 50, 64, 65, 200]
    classes = rng.integers(0, hmm.CLASSES, sum(lengths))
    begin = np.r_[0, np.cumsum(lengths)]
    monkeypatch.setattr(hmm, "PIECE", 16)
    got = hmm.forward(model, classes, begin)
    for i in range(len(lengths)):
        a, total = model.start, 0.0
        for t, c in enumerate(classes[begin[i] : begin[i + 1]]):
            a = (a if t == 0 else a @ model.move) * model.emit[c]
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_baum_welch_raises_likelihood():
    rng = np.random.default_rng(6)
    classes = np.concatenate([rng.choice([1, 2, 3] if i % 2 else [7, 8, 9], 60) for i in range(40)])
    begin = np.arange(0, len(classes) + 1, 60)
    share = (np.bincount(classes, minlength=hmm.CLASSES) + 0.01) / (len(classes) + 0.01 * hmm.CLASSES)
    emit = share[:, None] * (0.5 + rng.random((hmm.CLASSES, hmm.STATES)))
    model = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), np.full((hmm.STATES, hmm.STATES), 1 / hmm.STATES), emit / emit.sum(0))
    scores = []
    for _ in range(6):
        scores.append(hmm.forward(model, classes, begin).sum())
        begun, move, e = hmm.expected_counts(model, classes, begin)
        assert e.sum() == pytest.approx(len(classes))
        model = hmm.maximised(begun, move, e, share)
    assert scores[-1] > scores[0]


def test_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, sf_dir).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article[1])) if article else ""
        assert got[r.page_id].text == " ".join(html.unescape(plain).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<div class='nav'>a</div>"), (4, "u", "<article><p>" + "Long text, really. " * 20000)], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_extraction.extract_pages(odd, html_extraction.DEFAULT).collect()}
    assert texts[1] == texts[2] == texts[3] == "" and len(texts[4]) > 300000


def test_html_left_out_and_self_closed_tags():
    """Optional and missing end tags, self-closed and custom elements lose no text; what is hidden stays hidden."""
    first, second = "The first paragraph has words, and a few more of them.", "The second paragraph has words, and it goes on for a while."
    inside = lambda x: f"<html><body><article><p>{first}</p>{x}<p>{second}</p></article></body></html>"
    odd = [
        '<svg width="9" viewBox="0 0 1 1"/>', "<iframe src='x'/>", "<iframe src='x'/><iframe src='y'></iframe>", "<button>Share", "<div><button>Share</div>", "<select><option>One<option>Two", "<noscript>Off",
        "<button>Share<button>Like</button>", "<svg><g><svg/></g><text>drawn</text></svg>", "<svg><svg>in</svg>out</svg>", "<button>Share</button>", "<template><div>later</template>", "<noscript><p>Off</p></noscript>",
        "<textarea>typed <p></textarea>", "<script>if (a<b) '<p>'</script>", "<style/></style>", "<title-bar></title-bar>", "<select-box></select-box>", "<template/>",
    ]
    pages = [inside(x) for x in odd]
    for top in ("<head><title>T</title>", "<head><title>T", "<head><meta charset=utf-8><title>T</title></head>", "<title>T <p> T</title>"):
        pages.append(f"<!doctype html><html>{top}<body><article><p>{first}</p><p>{second}</p></article></body></html>")
    pages.append(f"<head><title>T</title><article><p>{first}</p><p>{second}</p></article>")
    pages.append(inside("<button>Share") + "<footer><button>Up</button></footer>")
    for page in pages:
        assert html_extraction.extract(page, html_extraction.DEFAULT) == f"{first} {second}", page


def test_min_cut_is_minimal():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        gain = rng.normal(0, 2, n).round(2).tolist()
        edges = [(int(a), int(b), float(round(rng.random() * 2, 2))) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b]

        def cost(side, gain=gain, edges=edges):
            return sum(max(-g, 0) if s else max(g, 0) for g, s in zip(gain, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extraction.min_cut(gain, edges)) == pytest.approx(best, abs=1e-9)


def test_blocks_are_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "bb" * 10, ""])], names=["text"])
    runs = list(text_blocks(batch, max_bytes=3))
    assert [(lo, hi) for lo, hi, _, _ in runs][0][0] == 0 and sum(hi - lo for lo, hi, _, _ in runs) == 4


def test_texts_are_not_shuffled_to_drop_contaminated_ones(spark):
    """The search for items ends before its few ids meet the texts: no text waits in a shuffle beside it."""
    item = "How many apples does the farmer sell on the market in one long week"
    docs = documents(spark, [f"Before it. {item}. After it.", "nothing of that kind is said in these few words", None])
    out = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "MapInArrow" not in plan and "BroadcastHashJoin" in plan
    assert [r.doc_id for r in out.collect()] == [1, 2]
