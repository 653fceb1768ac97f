"""Exact operators against brute force, and edge cases."""

import collections
import hashlib
import re

import numpy as np
import pytest

from retrieval_jobs.llm import jaccard_join, mixing, neighbours, queries, secrets, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, extra=()):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def awkward(seed=3):
    """Copies, near copies, shared passages, long runs, empty, blank, null and short texts."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    base, passage = text(120), text(60)
    near = [" ".join(w if rng.random() > 0.01 else "zz" for w in base.split()) for _ in range(30)]
    return ["", None, "  \n", "one", "a b c d", base, base, *near, base.upper(), "x" * 5000, "ab" * 700, text(4000), *[f"{text(30)} {passage} {text(30)}" for _ in range(25)], passage, base + " " + base, "a b c d"]


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mark[s] += 1
                mark[s + 100] -= 1
            seen.add(b[s : s + 100])
        gone = np.cumsum(mark[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "copies"), [(512, 4096), (2, 4096), (512, 3)])
def test_suffix_dedup(spark, monkeypatch, hot, copies):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "COPIES", copies)
    texts = awkward()
    got = suffix_dedup.remove_repeats(documents(spark, texts, [(None, "null id", None, None, 0)])).collect()
    want = brute_repeats(list(enumerate(texts)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_anchors_from_one_pass_of_sums():
    """Blocks, anchors and the hashes of both come from prefix sums taken once; each window lies in one block, at the anchor of least hash."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        offsets = np.r_[0, np.cumsum(rng.integers(0, 260, rng.integers(0, 6)))].astype(np.int64)
        buf = rng.integers(97, 99, offsets[-1]).astype(np.uint8)
        sums = suffix_dedup.prefix_sums(buf, lower=False)
        spans = [int(suffix_dedup.span_hashes(buf, np.array([p]), np.array([p + 24]), lower=False)[0]) for p in range(len(buf) - 23)]
        want = [(d, w, min(range(w, w + 77), key=lambda p: (spans[p] >> 32, p))) for d in range(len(offsets) - 1) for w in range(offsets[d], offsets[d + 1] - 99)]
        blocks = list(zip(*(x.tolist() for x in suffix_dedup.anchored_blocks(sums, offsets)), strict=True))
        assert [(d, w, a) for d, first, n, a in blocks for w in range(first, first + n)] == want
        assert all(a[0] != b[0] or a[3] != b[3] for a, b in zip(blocks, blocks[1:], strict=False))
        at = np.array([a for *_, a in blocks], np.int64)
        assert suffix_dedup.span_hashes(buf, at, at + 24, sums=sums).tolist() == [spans[a] for a in at]


def test_suffixes_are_compared_inside_their_anchor(monkeypatch):
    """Ranges are those of brute force, with NUL bytes and uneven ends; no comparison reaches over more suffixes than an anchor has."""
    rng, reach, minima = np.random.default_rng(5), [0], suffix_dedup.range_minima

    def watched(values, a, b):
        reach.append(int((b - a).max(initial=0)) + 1)
        return minima(values, a, b)

    monkeypatch.setattr(suffix_dedup, "range_minima", watched)
    blocks, want = [], set()
    for anchor in range(200):
        base, seen = rng.choice(np.array([0, 97, 98], np.uint8), 176), {}
        for _ in range(rng.integers(1, 9)):
            text = base.copy()
            text[rng.integers(0, 176, rng.integers(0, 3))] = 99
            lo, hi = np.sort(rng.integers(0, 77, 2))  # first and last window
            blocks.append((len(blocks), int(rng.integers(0, 1000)), int(76 - lo), text[lo : hi + 100].tobytes(), anchor))
            doc, start, _, data, _ = blocks[-1]
            for w in range(hi - lo + 1):
                if seen.setdefault(data[w : w + 100], doc) != doc:
                    want.add((doc, start + w))
    doc, start, at, data, anchor = zip(*blocks, strict=True)
    found = suffix_dedup.repeated_windows(np.array(doc), np.array(start), np.array(at), list(data), np.array(anchor))
    assert {(d, w) for d, s, e in zip(*(x.tolist() for x in found), strict=True) for w in range(s, e - 99)} == want
    assert 1 < max(reach) < 8


def test_suffix_dedup_empty_and_repeated(spark):
    docs = documents(spark, ["x " * 100])
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0
    assert suffix_dedup.remove_repeats(docs.unionByName(docs)).count() == 1


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                top[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("widespread", [16, 2])
def test_jaccard_join(spark, monkeypatch, widespread):
    monkeypatch.setattr(jaccard_join, "WIDESPREAD", widespread)
    texts = awkward() + awkward(4)
    got = jaccard_join.join_documents(documents(spark, texts, [(None, "null id", None, None, 0)])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(list(enumerate(texts)))


def test_jaccard_boundary_and_chain(spark):
    """75 of 100 links, just below doesn't; a chain is one component although its ends don't link."""
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w[a : a + 104]) for a in (0, 14, 28, 60, 200)]
    got = jaccard_join.join_documents(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(list(enumerate(texts)))
    assert jaccard_join.join_documents(documents(spark, ["a"]).where("false")).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)]))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(b) and 100 * both >= 75 * union:
            assert jaccard_join.may_link(len(a), jaccard_join.bitmap(a), len(b), jaccard_join.bitmap(b))
            assert jaccard_join.linked(a, [b])[0]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(700, 16)) * rng.uniform(0.2, 3, (700, 1))
    rows = [(i, data[i].tolist(), "x") for i in range(700)] + [(1000, None, "x"), (1020, [0.0] * 16, "x"), (1040, [float("nan")] * 16, "x"), (1060, [None] * 16, "x"), (None, [1.0] * 16, "x"), (1080, [1.0] * 3, "x")]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append(r)
    assert sorted(by) == [*range(0, 700, 20), 1080]
    hits, ids = 0, np.r_[np.arange(700), 1080]
    data = np.vstack([data, [1.0] * 3 + [0.0] * 13])  # a shorter vector counts as zero beyond its end
    for q, found in by.items():
        score = dict(zip(ids.tolist(), data @ data[ids == q][0], strict=True))
        score[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(sorted(score, key=lambda i: (-score[i], i))[:20]))
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in found)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(found, found[1:], strict=False))
    assert hits / (20 * len(by)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(few).count() == 4
    assert neighbours.nearest(few.where("false")).count() == 0


def test_neighbours_of_a_large_table():
    """Recall on 40,000 vectors without structure, in shards of the usual size, of which a small part is verified."""
    rng = np.random.default_rng(4)
    data, asked = rng.normal(size=(40000, 64)), np.arange(0, 1200, 20)
    shards = -(-len(data) // neighbours.SHARD_ROWS)
    part, found, verified = rng.permutation(len(data)) % shards, [[] for _ in asked], 0
    for p in range(shards):
        ids = np.flatnonzero(part == p)
        shard = neighbours.Shard(ids, data[ids], float(np.linalg.norm(data, axis=1).max()))
        best, n, _ = shard.search(asked, data[asked], 20, shards)
        verified += n
        for f, (i, score) in zip(found, best, strict=True):
            f += zip(-score, i.tolist(), strict=True)
    score = data[asked] @ data.T
    score[np.arange(len(asked)), asked] = -np.inf
    hits = sum(len({i for _, i in sorted(f)[:20]} & set(np.argsort(-s)[:20].tolist())) for f, s in zip(found, score, strict=True))
    assert hits / (20 * len(asked)) >= 0.9 and verified < 0.4 * len(data) * len(asked)


@pytest.mark.parametrize(("rows", "dim", "unit"), [(500, 64, False), (4000, 64, False), (8192, 64, False), (8192, 64, True), (8192, 256, True), (4096, 1024, True)])
def test_neighbours_of_one_shard(rows, dim, unit):
    """Recall does not depend on how full a shard is, on the dimension or on the norms: the windows stop by scores."""
    data = np.random.default_rng(6).normal(size=(rows, dim))
    data = data / np.linalg.norm(data, axis=1, keepdims=True) if unit else data
    shard, asked = neighbours.Shard(np.arange(rows), data, float(np.linalg.norm(data, axis=1).max())), np.arange(0, 50)
    score = data[asked] @ data.T
    score[asked, asked] = -np.inf
    best = shard.search(asked, data[asked], 20)[0]
    assert sum(len(set(b[0].tolist()) & set(np.argsort(-s)[:20].tolist())) for b, s in zip(best, score, strict=True)) / (20 * len(asked)) >= 0.9


def test_neighbours_that_are_equal():
    """Copies tie: the smaller ids come first, and a hot vector is found whole."""
    rng = np.random.default_rng(5)
    data = np.vstack([np.repeat(rng.normal(size=(1, 8)), 900, axis=0), rng.normal(size=(600, 8)) * 0.1])
    shard = neighbours.Shard(np.arange(1500), data, float(np.linalg.norm(data, axis=1).max()))
    (ids, score), _ = shard.search(np.array([0, 40]), data[[0, 40]], 20)[0]
    assert ids.tolist() == list(range(1, 21)) and np.ptp(score) < 1e-12


def test_mixing_against_sql(spark, duck, sf_dir):
    got = queries.op3_source_mixing(spark, sf_dir).toPandas()
    want = duck.sql(queries.ORACLES["op3_source_mixing"]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_mixing_shortages_and_edges(spark):
    # dom0 is tiny: its shortage goes to the other domains, and inside a domain first to its siblings
    rows = [(i, "w " * 10, "en", "src0" if i < 2 else f"src{1 + i % 2}", 0) for i in range(60)] + [(100, None, None, None, 0), (101, " ", "en", "src1", 0), (102, "a b", None, "odd", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_sources(docs, budget_share=0.5, max_epochs=1).collect()
    tokens = collections.Counter()
    for r in out:
        tokens[r.domain] += r.n_tokens * r.copies
    assert tokens["dom0"] == 20 and sum(tokens.values()) <= 301 and tokens["dom1"] >= tokens["dom2"]
    assert all(r.doc_id not in (100, 101) for r in out)
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert mixing.mix_sources(docs.where("doc_id >= 100 and doc_id < 102")).count() == 0
    twice = mixing.mix_sources(docs, budget_share=2.0, max_epochs=3).collect()
    assert max(r.copies for r in twice) <= 3 and sum(r.n_tokens * r.copies for r in twice) <= 2 * 602


def test_secrets(spark):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'set token = "{token}" now', f"commit {token} fixed it", "card 4111111111111111 paid", None, "", f'a token = "{token}" and again token = "{token}"', "é" * 50 + f' token = "{token}"', "word " * 20000 + f'token = "{token}"']
    docs = documents(spark, texts).withColumn("findings", __import__("pyspark").sql.functions.lit("clash"))
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.find_secrets(docs, model).collect()
    real = [(r.doc_id, r.start, r.length) for r in found if r.is_secret]
    assert sorted(real) == sorted((i, m.start() + 1, 40) for i, t in enumerate(texts) for m in re.finditer(token, t or "") if i != 1)
    clean = {r.doc_id: r for r in secrets.redact(docs, model).collect()}
    assert clean[0].text == 'set token = "[SECRET]" now' and clean[0].n_chars == len(clean[0].text)
    assert clean[5].text.count("[SECRET]") == 2 and clean[1].text == texts[1] and clean[2].text == texts[2] and clean[3].text is None and clean[4].text == ""
    assert secrets.find_secrets(docs.where("false"), model).count() == 0


def test_secrets_after_equals_signs(spark):
    """KEY=VALUE, URL parameters and .env lines; the name of an assignment is no secret, nor is a checksum or a number."""
    values = ["Xy7kLm9PqRs2TuVw4Zab", "Ab1dEfGh2jKlMn3pQr4tUv5xWz6aBc7d", "9f86d081884c7d659a2feaa0c55ad015", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzAbCdEfGh", "qLr8TfZk2Vw0sXbN5mYcJ1hD4gPaUe7R"]
    shapes = [
        "password={}", "see client_secret={}&x=1", "export TOKEN={}\n", "AWS_SECRET_ACCESS_KEY={}\n", "https://a.example.org/cb?access_token={}&page=2",
        "HOST=local\nAPI_KEY={}\nDEBUG=1\n", "S3_SECRET_ACCESS_KEY={}\n", 'S3_SECRET_ACCESS_KEY="{}"', "api_key={}==\n",
    ]
    texts = [(s.format(v), v + "==" * ("==" in s)) for s in shapes for v in values]
    late = "aB" * 45 + "7" + "cD" * 4  # its first digit is its 91st character
    texts.append((f"client_secret={late}&", late))
    clean = ["md5=9f86d081884c7d659a2feaa0c55ad015\n", "integrity=sha512-n4bQgYhMfWWaL+qgxVrQFaO/TxsrC4Is0V1sFbDwCgg=", "order=41111111111111111111.", "MY_SECRET_NUMBER_NAME_2=yes", "a==b and c=d"]
    docs = documents(spark, [t for t, _ in texts] + clean)
    model = secrets.train(secrets.labelled_findings(spark))
    real = sorted((r.doc_id, r.start, r.length) for r in secrets.find_secrets(docs, model).collect() if r.is_secret)
    assert real == [(i, t.index(v) + 1, len(v)) for i, (t, v) in enumerate(texts)]
    got = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert [got[i] for i in range(len(got))] == [t.replace(v, "[SECRET]") for t, v in texts] + clean
