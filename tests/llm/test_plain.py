"""Operators and stages against plain versions of themselves, and on awkward tables."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retrieval_jobs.llm import common, decontamination, hmm, html_extraction, language_id, mixing, quality, secrets

from .test_exact import SCHEMA, brute_join, documents

#: Names that the operators use for columns of their own.
CLASHES = ["score", "rejected", "lang_pred", "_text", "text_read", "gone", "component", "row_number", "findings", "domain", "n_tokens", "copies", "mixed", "language_found", "id"]


def test_language_scores_match_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 7)  # texts span many pieces
    model = language_id.fit(["the cat and the dog " * 3, "der hund und die katze " * 3] * 10, ["en", "de"] * 10, epochs=2)
    texts = ["the dog", "die katze und", "a", "der hund " * 40, "", None, "12", "naïve café 9", "the dog"]
    got = {r.doc_id: r for r in language_id.identify(documents(spark, texts), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        z, n = np.zeros(2), 0
        for size in language_id.GRAMS:
            for a in range(len(data) - size + 1):
                z, n = z + model.scores[language_id.buckets(data[a : a + size], size)[0]], n + 1
        p = np.exp((z / max(1, n) + model.bias) / model.temperature)
        p /= p.sum()
        if any(c.isalpha() for c in t or ""):
            assert got[i].lang_pred == model.languages[int(p.argmax())] and got[i].score == pytest.approx(p.max(), rel=1e-6) and got[i].rejected == (got[i].score < model.threshold)
        else:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[0].score == got[8].score


def test_language_ties_and_repeats(spark):
    model = language_id.Model(["aa", "bb"], np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.0)
    docs = documents(spark, ["word"])
    rows = language_id.identify(docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), model, ["doc_id"]).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("aa", 0.5)] * 3
    with pytest.raises(ValueError):
        language_id.identify(docs.withColumn("Score", F.lit(1)), model, ["doc_id", "Score"])


def test_quality_matches_plain_convolution():
    rng = np.random.default_rng(3)
    m = quality.Model(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=quality.FILTERS), rng.normal(size=quality.FILTERS), 0.3)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 4, 511, 512, 513, 1500)]
    got = quality.probabilities(m, np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])])
    for t, p in zip(texts, got, strict=True):
        pools, at = [], 0
        while len(t) and (at == 0 or at + quality.CHUNK - quality.STRIDE < len(t)):
            chunk = np.r_[t[at : at + quality.CHUNK], np.zeros(quality.WIDTH, np.uint8)]
            size = min(quality.CHUNK, len(t) - at)
            pools.append(np.max([sum(m.table[k][chunk[i + k]] for k in range(quality.WIDTH)) for i in range(size)], axis=0))
            at += quality.STRIDE
        pool = np.maximum(np.array(pools) + m.shift, 0) if pools else np.zeros((1, quality.FILTERS))
        z = float(pool.mean(0) @ m.mean_w + pool.max(0) @ m.max_w + m.bias)
        assert p == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-4, abs=1e-9)


def test_quality_ties_and_repeats(spark):
    m = quality.Model(np.zeros((quality.WIDTH, 256, quality.FILTERS), np.float32), np.zeros(quality.FILTERS, np.float32), np.zeros(quality.FILTERS), np.zeros(quality.FILTERS), float(np.log(0.3 / 0.7)) + 1e-12)
    docs = documents(spark, ["word", None, ""])
    rows = quality.score(docs.unionByName(docs), m, ["doc_id"]).collect()
    assert len(rows) == 6 and all(r.predicted == 1 and r.score == pytest.approx(0.3) for r in rows)  # on the threshold


def plain_template(text):
    out = []
    for word in re.findall(r"[^\x20\x09-\x0d]+", text):
        bare = word.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
        if not bare:
            continue
        number = any(c.isdigit() for c in bare) and all(c in "0123456789.,:/+-%$" for c in bare)
        kind = "#" if number else "unit" if out and out[-1][0] == "#" and bare in decontamination.UNITS else bare
        out.append((kind, bare if kind in ("#", "unit") else None))
    return out


def plain_contaminated(docs, items):
    """Every window of every document against every window of every item."""
    w = decontamination.WINDOW
    windows = lambda t: [(k, t[k : k + w]) for k in range(len(t) - w + 1) if sum(v is None for _, v in t[k : k + w]) >= decontamination.LITERALS]
    found = set()
    for (d, doc), (i, item) in itertools.product(docs.items(), items.items()):
        a, b = windows(plain_template(doc)), windows(plain_template(item))
        lines = collections.defaultdict(list)
        for (p, x), (q, y) in itertools.product(a, b):
            if [k for k, _ in x] == [k for k, _ in y]:
                lines[p - q].append((q, [(u, v) for (_, u), (_, v) in zip(y, x, strict=True) if u is not None]))
        good = [line for line in lines.values() if all(len(v) == 1 for v in slots(line).values())]
        at = {q for line in good for q, _ in line}
        if b and (len(at) / len(b) >= 0.75 or max((len({q for q, _ in line}) for line in good), default=0) >= 9):
            found.add((d, i))
    return found


def slots(line):
    out = collections.defaultdict(set)
    for _, pairs in line:
        for u, v in pairs:
            out[u].add(v)
    return out


def test_decontamination_matches_nested_loops(spark):
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + k)}" for k in range(12)] + ["kg", "miles"]

    def text(n):
        return " ".join(str(rng.integers(1, 30)) + rng.choice(["", ",", "%"]) if rng.random() < 0.25 else str(rng.choice(words)) for _ in range(n))

    items = {k: text(int(rng.integers(8, 25))) for k in range(12)}
    items = {k: t for k, t in items.items() if len(plain_template(t)) >= 8}
    swap = lambda t: re.sub(r"\d+", lambda m: str(int(m[0]) + 100), t)
    docs = {}
    for k, t in items.items():
        docs[10 * k] = f"{text(15)} {t} {text(15)}"
        docs[10 * k + 1] = f"{text(9)} {swap(t)} {text(9)}"  # other numbers
        docs[10 * k + 2] = re.sub(r"\d+", lambda _: str(rng.integers(1, 500)), t)  # numbers that may not agree
        docs[10 * k + 3] = " ".join(t.split()[: len(t.split()) * 2 // 3]) + " " + text(10)
        docs[10 * k + 4] = text(40)
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs.items()], SCHEMA)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = plain_contaminated(docs, items)
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(frame.unionByName(frame), bench).collect()]  # repeated rows count once
    assert sorted(got) == sorted(want) and {(10 * k, k) for k in items} <= want and {(10 * k + 1, k) for k in items} <= want


def test_forest_expression_is_the_forest(spark):
    found = secrets.labelled_findings(spark, 300)
    model = secrets.train(found)
    f = secrets.features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit("")))
    from pyspark.ml.linalg import Vectors

    for r in found.withColumn("f", f).withColumn("s", secrets.forest_expression(model, F.col("f"))).select("f", "s").limit(120).collect():
        x = Vectors.dense([r.f[name] for name in secrets.FEATURES])
        assert r.s == pytest.approx(np.mean([t.predict(x) for t in model.trees]))


def test_expected_counts_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(hmm, "PIECE", 5)
    begin = np.r_[0, np.cumsum([1, 3, 5, 6, 17, 23, 40])]
    classes = rng.integers(0, 9, begin[-1])
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(hmm.STATES), 0), norm(rng.random((hmm.STATES, hmm.STATES)) + 0.05, 1), norm(rng.random((hmm.CLASSES, hmm.STATES)) + 0.01, 0))
    want = [np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.CLASSES, hmm.STATES))]
    for a, b in itertools.pairwise(begin):
        c = classes[a:b]
        al, be = np.zeros((len(c), hmm.STATES)), np.ones((len(c), hmm.STATES))
        al[0] = m.start * m.emit[c[0]]
        for t in range(1, len(c)):
            al[t] = al[t - 1] @ m.move * m.emit[c[t]]
        for t in range(len(c) - 2, -1, -1):
            be[t] = m.move @ (m.emit[c[t + 1]] * be[t + 1])
        g = al * be / al[-1].sum()
        want[0] += g[0]
        for t in range(len(c)):
            want[2][c[t]] += g[t]
            if t:
                want[1] += m.move * np.outer(al[t - 1], m.emit[c[t]] * be[t]) / al[-1].sum()
    for x, y in zip(hmm.expected_counts(m, classes, begin), want, strict=True):
        assert np.abs(x - y).max() < 1e-10


SOUP = """<html><body><div><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Contact us</a></li></ul></div>
<div><h1>Rivers</h1><p>The river rises in the hills, and it runs for two hundred miles to the sea.</p><p>How long?</p><p>It takes about nine days, as the
surveyors of the last century found out.</p><p>Yes</p><p>Boats went down with wood and salt, and came back with cloth and wine.</p></div>
<div><a href=/t>Terms</a> <a href=/p>Privacy</a></div></body></html>"""


def test_the_cut_corrects_single_blocks():
    """On a page that tells nothing, blocks that alone look like boilerplate stay with the content around them."""
    blocks = html_extraction.blocks_of(SOUP)
    gain, edges = html_extraction.terms(blocks, html_extraction.DEFAULT)
    cut = html_extraction.min_cut(gain, edges)
    changed = [b.text for b, g, inside in zip(blocks, gain, cut, strict=True) if inside != (g > 0)]
    assert changed == ["Yes"]
    text = html_extraction.extract(SOUP, html_extraction.DEFAULT)
    assert text.startswith("The river rises") and "? It takes" in text and "out. Yes Boats" in text and "Home" not in text and "Terms" not in text


def test_pages_that_tell_nothing(spark, sf_dir):
    """Trained on the given pages, most blocks of the same pages without telling tags and classes are labelled right."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    weights = html_extraction.fit(pages)
    right = total = changed = 0
    for page in pages:
        want = html_extraction.labels_of(html_extraction.blocks_of(page))
        bare = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|aside|main|header)\b[^>]*>", r"<\1div>", page))
        blocks = html_extraction.blocks_of(bare)
        gain, edges = html_extraction.terms(blocks, weights)
        cut = html_extraction.min_cut(gain, edges)
        right += sum(a == b for a, b in zip(want, cut, strict=True))
        changed += sum((g > 0) != c for g, c in zip(gain, cut, strict=True))
        total += len(want)
    assert right / total > 0.9
    soup = html_extraction.extract(SOUP, weights)
    assert soup.startswith("Rivers The river") and "Yes" in soup and "Home" not in soup and "Terms" not in soup
    assert html_extraction.extract("<article><p>Long text, really good.</p>< 3 left over here", weights).endswith("< 3 left over here")


A = "The first paragraph has words, and a few more of them, so it is prose."
B = "The second paragraph has words too, and it goes on for a while, as prose does."
C = "I liked this very much, thank you, and I will read the next one as well, of course."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><p>{A}</p></article><section class="comments"><article class="user_comment"><p>{C}</p><p>{C}</p></article></section>', A),
        (f'<article><p>{A}</p></article><section id="comments"><article><p>{C}</p></article></section>', A),
        (f'<div><p>{A}</p><p>{B}</p></div><section class="comments"><article><p>{C}</p></article></section>', f"{A} {B}"),
        (f"<article><p>{A}</p></article><aside><article><p>{C}</p></article></aside>", A),
        (f'<article><p>{A}</p><section id="share-prices"><p>{B}</p></section></article>', f"{A} {B}"),
        (f'<article><p>{A}</p><blockquote class="ad-lib">{B}</blockquote></article>', f"{A} {B}"),
        (f"<article><p>{A}</p><ul><li><a href=/m>Milk</a></li><li>Eggs</li></ul></article>", f"{A} Milk Eggs"),
        (f"<body><form method=post><nav><a href=/>Home</a></nav><div><p>{A}</p><p>{B}</p></div><footer>(c) us</footer></form>", f"{A} {B}"),
        (f"<body><form><table><tr><td><p>{A}</p><p>{B}</p></td></tr></table></form>", f"{A} {B}"),
        (f'<article><header><h1>Its title</h1></header><p>{A}</p><div class="ad">{C}</div><div class="related-posts"><p>{C}</p></div></article>', f"Its title {A}"),
        (f'<div id="content"><h1>Head</h1><p>{A}</p></div><div id="sidebar-left"><p>{C}</p></div><div class="site-footer">{C}</div><div class="cookie-notice">{C}</div>', f"Head {A}"),
        (f'<main><article><p>{A}</p></article><form class="newsletter"><p>Write down your e-mail, please, and we will send you news.</p></form></main>', A),
        (f'<div class="post"><div class="post-header"><h1>Head</h1></div><div class="comment-list"><p>{C}</p></div><p>{B}</p></div>', f"Head {B}"),
        (f'<div class="postBody hasSidebar"><p>{A}</p></div><div class="shareButtons">{C}</div><div role="complementary">{C}</div>', A),
    ],
)
def test_regions_within_regions(page, want):
    """Comments, asides and forms hold articles and the other way round; words that only begin like a region's name tell nothing."""
    assert html_extraction.extract(page, html_extraction.DEFAULT) == want


def test_the_cut_lowers_the_error_on_pages_of_one_element(spark, sf_dir):
    """Learned on half of the pages; in the other half every element becomes a plain division."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]
    model = html_extraction.fit(pages[::2])
    alone = joint = 0
    for page in pages[1::2]:
        want = html_extraction.labels_of(html_extraction.blocks_of(page))
        bare = re.sub(r"<(/?)(article|nav|footer|p|h1|li|ul)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))
        blocks = html_extraction.blocks_of(bare)
        gain, edges = html_extraction.terms(blocks, model)
        alone += sum((g > 0) != bool(w) for g, w in zip(gain, want, strict=True))
        joint += sum(c != bool(w) for c, w in zip(html_extraction.min_cut(gain, edges), want, strict=True))
    assert joint < alone


def test_html_repeated_and_null_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One sentence, of some words, is here.</p>", "x")] * 2 + [(None, None, None, "x")], "page_id long, url string, html string, text string")
    rows = html_extraction.extract_pages(pages, html_extraction.DEFAULT).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and (rows[2].text, rows[2].n_chars) == ("", 0)


def test_bounded_sample_bounds_rows(spark):
    rows = spark.createDataFrame([(k % 3, str(k)) for k in range(500)], "doc_id long, text string")
    assert common.bounded_sample(rows, "doc_id", 10).count() == 10
    assert sorted(r.text for r in common.bounded_sample(rows, "doc_id", 10).collect()) == sorted(r.text for r in common.bounded_sample(rows.orderBy(F.desc("text")), "doc_id", 10).collect())


def test_settled_needs_a_shared_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    table = common.settled(spark.range(7))
    assert table.count() == 7 and "settled_" in table.inputFiles()[0] and spark.conf.get(common.CLEANUP) == "false"
    path = table.inputFiles()[0].rpartition("/")[0]
    common.discard(table, None)
    assert spark.read.schema("id long").parquet(path).count() == 0 and spark.conf.get("spark.checkpoint.dir") == before


def test_a_discarded_table_is_not_read_as_empty(spark):
    table = common.settled(spark.range(7))
    common.discard(table)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        table.agg(F.sum("id")).collect()


# the pipeline's stages


def clashing(docs):
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"own {c} "), F.col("doc_id").cast("string")))
    return docs


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, sf_dir, name):
    texts = ["the cat and the dog sit in the sun " * 4, 'the key is token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" in the file', "die katze und der hund " * 5]
    docs = clashing(documents(spark, texts * 4))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"own {c} {r.doc_id}" for c in CLASHES)


def test_near_duplicate_stage_keeps_different_texts_that_share_an_id(spark, sf_dir):
    text = lambda k: " ".join(f"{chr(97 + k)}{j}" for j in range(30))
    rows = [(1, text(0)), (1, text(1)), (1, text(0)), (2, text(0) + " more"), (None, text(2)), (None, text(2)), (None, text(1)), (3, None), (4, None), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(1, text(0)), (1, text(1)), (None, text(2)), (3, None), (4, None), (5, ""), (None, None)], key=str)


def test_language_stage_judges_each_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, docs.first().text, "en", "s", 0), (7, "12 34 !!", "en", "s", 0), (7, None, None, None, None)], SCHEMA)
    both = docs.unionByName(odd.select(*docs.columns))
    model = language_id.train(both)
    want = collections.Counter((r.doc_id, r.text) for r in language_id.identify(both, model, ["doc_id", "text"]).collect() if not r.rejected)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.identify_language(spark, both, sf_dir).collect())
    assert got == want and got[(7, "12 34 !!")] == 0 and got[(None, docs.first().text)] == 1


def test_decontamination_stage_drops_what_the_operator_finds(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    planted = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.concat("text", F.lit(" "), F.lit(bench.orderBy(F.desc(F.length("text"))).first().text)))
    both = docs.unionByName(planted).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    bad = {r.doc_id for r in decontamination.contaminated(both, bench).collect()}
    got = collections.Counter(r.doc_id for r in corpus_pipeline.decontaminate(spark, both, sf_dir).collect())
    assert got == collections.Counter(r.doc_id for r in both.collect() if r.doc_id not in bad) and {r.doc_id for r in planted.collect()} <= bad and got[None] == 1


def test_secret_stage_redacts_planted_secrets(spark, sf_dir):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(f' token = "{token}" end'))).otherwise(F.col("text")))
    before = {r.doc_id: r.text for r in docs.collect()}
    plain = re.compile('token = "[0-9a-f]{40}"')
    got = corpus_pipeline.redact_secrets(spark, docs, sf_dir).collect()
    assert len(got) == len(before) and sum(token in (t or "") for t in before.values()) > 50
    for r in got:
        assert r.text == (plain.sub('token = "[SECRET]"', before[r.doc_id]) if before[r.doc_id] is not None else None)


def test_mixing_stage_is_the_operator(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: (r.domain, r.n_tokens, r.copies) for r in mixing.mix_sources(docs).collect()}
    got = {r.doc_id: (r.domain, r.n_tokens, r.copies) for r in corpus_pipeline.mix_to_weights(spark, docs, sf_dir).collect()}
    # the stage orders rows by their numbers, so that only the choice inside a leaf's last epoch may differ
    spent = lambda x: collections.Counter({d: sum(n * c for dd, n, c in x.values() if dd == d) for d in {v[0] for v in x.values()}})
    a, b = spent(want), spent(got)
    assert set(a) == set(b) and all(abs(a[d] - b[d]) <= 0.1 * a[d] + 20000 for d in a)
    assert {r.doc_id: r.text for r in corpus_pipeline.mix_to_weights(spark, docs, sf_dir).collect()}.items() <= {r.doc_id: r.text for r in docs.collect()}.items()


def test_near_duplicate_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in brute_join([(r.doc_id, r.text) for r in docs.collect()]).values()})
