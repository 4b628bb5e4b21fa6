import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankwatch.llm import collocations, common, conversations, decontaminate, embeddings, language, lines, lm, ngram_join, packing, queries, spots, substrings, toxicity, url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, "   \n\n"), (4, "one"), (4, "one"), (None, "a b c d e f g h i j k l m n"), (6, "A b\x0bc d é <|endoftext|> ☃ " * 40), (7, "A b\x0bc d é <|endoftext|> ☃ " * 40), (8, "x " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.0, "s") for i, t in ODD], "doc_id long, text string, score double, source string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def roots(n, links):
    up = list(range(n))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = rng.integers(0, 300, size=(260, 2)).tolist() + [[400 + k, 401 + k] for k in range(40)] + [[1000, 1000 + k] for k in range(1, 50)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(1100, links)
    assert got == {k: want[k] for k in {x for p in links if p[0] != p[1] for x in p}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_labels_are_never_broadcast(spark, sf, monkeypatch):
    """There are as many labels as labelled documents, in a file that Spark takes for small."""
    import corpus_pipeline

    given = []

    def stop(labelled, *args):
        given.append(labelled)
        raise StopIteration

    monkeypatch.setattr(toxicity, "fit", stop)
    for query in (lambda: queries.op1_toxicity(spark, sf), lambda: corpus_pipeline.drop_toxic(spark, common.table(spark, sf, "documents"), sf)):
        with pytest.raises(StopIteration):
            query()
    for labelled in given:
        plan = labelled._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan and not labelled.isEmpty()
    assert len(given) == 2


def test_op1_toxicity(spark, odd, none):
    rng = np.random.default_rng(0)
    syllables = ["an", "or", "the", "in", "tion", "er", "ble", "sh"]
    rows = []
    for k in range(400):
        words = ["".join(rng.choice(syllables, size=rng.integers(1, 4))) for _ in range(60)]
        if k % 4 == 0:
            for bad in ("moron", "scumbag", "pathetic"):
                words.insert(int(rng.integers(0, 60)), bad)
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 300"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert all(got[k] == (k % 4 == 0) for k in range(300, 400))
    hidden = spark.createDataFrame([(1, "an or the m o r o n in"), (2, "an or mor-on the"), (3, "or pathettic in the"), (4, "an or the in")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(hidden, model).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    assert [r.predicted for r in toxicity.score(odd, model).collect()] == [0] * len(ODD)
    padded = [(k, f"an or {w[:i]}{x}{w[i:]} the in") for k, (w, i, x) in enumerate((w, i, x) for w in ("scumbag", "pathetic") for i in range(1, len(w)) for x in "x7")]
    assert {r.predicted for r in toxicity.score(spark.createDataFrame(padded, "doc_id long, text string"), model).collect()} == {1}  # one letter at any gap
    dealt = [toxicity.fit(df.where("doc_id < 300").repartition(n)) for n in (1, 5)]
    assert all(d.landmarks == model.landmarks and abs(d.middle - model.middle) < 1e-4 for d in dealt)  # the same model however rows are dealt
    assert toxicity.score(none, model).count() == 0
    assert toxicity.clean(df, model).columns == df.columns
    assert toxicity.score(odd, toxicity.fit(df.where("toxic = 0"))).where("predicted = 1").count() == 0


def test_op1_every_unit_meets_the_kernel():
    marks = ["loser", "trash", "pathetic", "disgusting", "worthless", "stupid", "clown", "\u6ce8\u610f\u529b"]
    own, weights = toxicity.self_kernel(marks), np.linspace(1.0, 2.0, len(marks))
    model = toxicity.Model(marks, own, weights, -0.1)
    gapped = [fill.join(w) for w in marks for fill in ("x", "7", "xq", "4z", "")] + ["", "a", "loserloserloserloser", "house", "\u6ce8x\u610fx\u529b"]
    want = toxicity.similarity(gapped, marks, own) @ weights - 0.1
    assert np.allclose(model.units(gapped), want, atol=1e-4)
    for fill in ("x", "7", "xq", "4z"):
        assert all(f > toxicity.FLOOR for f in model.units([fill.join(w) for w in marks]))
    sparse = toxicity.Subsequences(marks, own, weights)
    sparse.keys, sparse.values = np.flatnonzero(sparse.values), sparse.values[np.flatnonzero(sparse.values)]
    assert np.allclose(sparse(gapped) - 0.1, want, atol=1e-4)


def test_op1_learns_a_long_tail(spark):
    rng = np.random.default_rng(3)
    common_words = ["".join(rng.choice(list("aeilnorst"), size=7)) for _ in range(3000)]
    letters = list("bcdfgjkmpquvwxyz")
    tail = ["".join(rng.choice(letters, size=6)) for _ in range(80)]  # each in 7 of 560 toxic documents, 1.25 %
    rows = []
    for k in range(4000):
        words = rng.choice(common_words, size=40).tolist()
        if k < 560:
            words.insert(int(rng.integers(0, 40)), tail[k % 80])
        rows.append((k, " ".join(words), int(k < 560)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df)
    assert model.units(tail).min() > model.units(common_words[:200]).max()
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[k] for k in range(560)) >= 550 and sum(got[k] for k in range(560, 4000)) <= 34
    strings = [f"{a}{b}" for a in ("stupid", "clown", "loser") for b in ("", "s", "ish")] + ["unlike"]
    marks = toxicity._cover(strings, list(range(1, 11)))
    assert (toxicity.similarity(strings, marks).max(axis=1) >= toxicity.NEAR).all() and len(marks) < len(strings)


def test_op2_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(k, (base[k % 40] + rng.normal(scale=0.2, size=8)).astype(np.float32).tolist(), k % 3) for k in range(240)]
    rows += [(300 + k, rows[7][1], rows[7][2]) for k in range(5)] + [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1), (404, rows[0][1], None), (405, [], 1), (406, [1.0] * 4, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, dtype=np.float64), c) for i, v, c in rows if i is not None and v and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.93]
    n, root = Counter(x for p in links for x in p), roots(len(good), links)
    want = {i: (0, i) for i, _, _ in rows if i is not None} | {good[k][0]: (n[k], min(good[j][0] for j in range(len(good)) if root[j] == root[k])) for k in range(len(good))}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect() if r.vec_id is not None}
    assert got == want
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_op2_labels_of_any_type(spark):
    v = [1.0, 0.0, 0.2]
    for kind, labels in (("string", ["a", "a", "b", None]), ("double", [1.2, 1.2, 1.7, None]), ("boolean", [True, True, False, None])):
        df = spark.createDataFrame([(k, v, x) for k, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
        assert [(r.n_links, r.component_id) for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()] == [(1, 0), (1, 0), (0, 2), (0, 3)]


def test_op2_many_blocks(spark):
    """Several blocks and partitions of the order, so that intervals are joined level by level."""
    rng = np.random.default_rng(12)
    block, embeddings.BLOCK = embeddings.BLOCK, 8
    try:
        x = rng.normal(size=(400, 6))
        x[200:] = x[:200] + rng.normal(scale=0.15, size=(200, 6))
        df = spark.createDataFrame([(k, r.tolist(), k % 2) for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        linked = (u @ u.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400)[None, :] % 2)
        np.fill_diagonal(linked, False)
        root = roots(400, np.argwhere(linked).tolist())
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    finally:
        embeddings.BLOCK = block
    assert got == {k: (int(linked[k].sum()), root[k]) for k in range(400)} and linked.sum() > 100


def test_op3_language(spark, docs, odd, none, sf):
    full = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_language(spark, sf).join(full.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.8 * got.count()
    learned = language.fit_dictionaries(full)
    rows = language.identify(odd, learned).collect()
    assert [r.lang_pred for r in rows][:3] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows)
    assert language.identify(none, learned).count() == 0
    assert language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_op4_lm(spark, docs, odd, none):
    train = docs.where(common.remainder(F.col("doc_id")) != 1)
    for part in (docs, odd.select("doc_id", "text")):
        texts = [(r.doc_id, WORDS.findall((r.text or "").translate(LOWER)) + [None]) for r in part.collect()]
        counts = Counter(w for r in train.collect() for w in WORDS.findall((r.text or "").translate(LOWER)) + [None])
        n, v = sum(counts.values()), len(counts)
        whole, parts = (lm.score(part, train, limit=m).orderBy("doc_id").collect() for m in (1 << 26, 60_000))
        base = sorted(((i is not None, i or 0), len(t), sum(counts[w] > 0 for w in t), float(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))) for i, t in texts)
        for got in (whole, parts):
            rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.n_known, r.base_score) for r in got)
            assert [r[:3] for r in rows] == [b[:3] for b in base]
            assert np.allclose([r[3] for r in rows], [b[3] for b in base], rtol=1e-9)
        assert np.allclose([r.score for r in whole], [r.score for r in parts])
    assert lm.score(none, train).count() == 0
    assert all(r.n_known == 0 for r in lm.score(docs, none).collect())


def test_op4_counts_pairs_seen_once(spark):
    train = spark.createDataFrame([(1, "red fox"), (2, "old owl"), (3, "old hen"), (4, "red cat"), (5, "we met again"), (6, "we met again")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame([(1, "red fox"), (2, "red owl")], "doc_id long, text string"), train).collect()}
    assert got[1] > got[2] + 0.1  # fox and owl are equally frequent; only the pair "red fox" was seen, once


def test_op4_joined_rows_keep_their_own_text(spark):
    train = spark.createDataFrame([(k, f"w{k} w{k + 1} a b") for k in range(200)], "doc_id long, text string")
    rows = spark.createDataFrame([(None, "a b w1 w2 w3"), (None, "zz yy"), (None, None), (5, "a"), (5, "w7 b zz qq"), (5, "a"), (6, "")], "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 8))
    whole, joined = (sorted(map(key, lm.score(rows, train, limit=m).collect())) for m in (1 << 26, 600))
    assert joined == whole and len(whole) == 7


def test_op5_url_filter(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/6", "http://notexample.com/en/7", "http://x.net/de/8", "http://example.net/de/81?q#f", "http://a.org/es", "com/en/", None, "http://", "http://com/en/", "http://a.org?x=/es/", "http://a.b/en/#://"]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    for limit in (1 << 20, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules, max_filter_bytes=limit).collect()}
        for k, u in enumerate(urls):
            rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
            host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
            fit = sorted((len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
            assert got[k] == (host, path, fit[-1][1] if fit else None, fit[-1][2] if fit else "allow")
    assert url_filter.url_filter(pages, rules.where("false")).where("verdict <> 'allow'").count() == 0
    named = pages.withColumns({"_keys": F.lit(1), "_hit": F.lit("x"), "best": F.lit(2)})
    many = rules.union(spark.createDataFrame([(f"h{n}.com", "/" + "p" * n, "block") for n in range(90)], rules.schema))
    for limit in (1 << 20, 0):
        out = url_filter.url_filter(named, many, max_filter_bytes=limit)
        assert out.columns == [*named.columns, "host", "path", "verdict"] and out.where("_keys = 1 and _hit = 'x' and best = 2").count() == len(urls)
    assert url_filter.url_filter(pages.where("false"), rules).count() == 0


def shingles(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_op6_hub_of_unlike_variants(spark):
    rng = np.random.default_rng(6)
    rows = []
    for h in range(60):
        hub = [f"w{x}" for x in rng.integers(0, 400, size=64)]
        rows.append(" ".join(hub))
        for _ in range(12):
            v = list(hub)
            for at in rng.choice(64, size=int(rng.integers(1, 4)), replace=False):
                v[at] = f"w{rng.integers(0, 400)}"
            rows.append(" ".join(v))
    df = spark.createDataFrame([(int(k), rows[i]) for k, i in enumerate(rng.permutation(len(rows)))], "doc_id long, text string")
    texts = df.collect()
    sets = [shingles(r.text, 3) for r in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    root = roots(len(texts), links)
    want = {texts[k].doc_id: min(texts[j].doc_id for j in range(len(texts)) if root[j] == root[k]) for k in range(len(texts))}
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, 3, 90).collect()}
    assert got == want and len(links) > 100


def test_op6_rows_that_share_an_id(spark):
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(1, "quite another text than the rest of them"), (1, text), (2, text + " end"), (3, "unlike all")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(df).collect()} == {(1, 1), (2, 1), (3, 3)}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_op6_ngram_join(spark, docs, odd, n, percent):
    both = docs.union(odd.where("doc_id > 5").select(F.col("doc_id") + 10_000, "text"))
    rows = both.collect()
    sets = [shingles(r.text, n) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    want = {rows[k].doc_id: (len(sets[k]), min(rows[j].doc_id for j in range(len(rows)) if root[j] == root[k])) for k in range(len(rows))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(both, n, percent).collect()} == want


def test_op6_halves_never_share_less_than_hashes():
    """Half hashes may meet by chance, within a set as well; the multi-match test must then still let each pair through."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        pool = (rng.integers(0, 12, 40).astype(np.uint64) << np.uint64(32)) + np.arange(40, dtype=np.uint64)
        x, y = (rng.choice(pool, size=int(rng.integers(0, 30)), replace=False) for _ in range(2))
        assert ngram_join.most_shared(ngram_join.halves(x), ngram_join.halves(y)) >= len(np.intersect1d(x, y))
    x, y = (rng.integers(0, 1 << 63, 50).astype(np.uint64) for _ in range(2))
    assert ngram_join.most_shared(ngram_join.halves(x), ngram_join.halves(np.r_[x[:9], y])) == 9


def test_op6_moves_prefixes_of_pairs_alone(spark, monkeypatch):
    """Texts that share a passage, two of which are near: the prefixes of the others are not shuffled."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    passage, near = words(40), words(300)
    texts = [f"{passage} {words(300)}" for _ in range(60)] + [near, f"{near} end"]
    tables, asked = {}, []
    written, key_filter = ngram_join.written, ngram_join.key_filter
    monkeypatch.setattr(ngram_join, "written", lambda df, name: tables.setdefault(name, written(df, name)) if name == "several" else written(df, name))
    monkeypatch.setattr(ngram_join, "key_filter", lambda keys, key: (asked.append(keys.count()) if key == "node" else None, key_filter(keys, key))[1])
    rows = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).select("doc_id", "component_id").collect()}
    assert rows == {k: min(k, 60) for k in range(62)} and asked == [2]


def test_op6_odd_rows(spark, odd, none):
    got = ngram_join.ngram_join(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id is None} == {None}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 3, 6, 7)} == {(1, 1), (2, 2), (3, 3), (6, 6), (7, 6)}
    assert ngram_join.ngram_join(none).count() == 0


def test_op7_decontaminate(spark, docs, odd, none, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [(r.item_id, flat(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in flat(r.text or "")}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    own = spark.createDataFrame([(1, "If Alice buys 12 pens for 3 dollars each and Bob buys 12 books, how much did Alice pay in all for her pens?"), (2, None), (3, "")], "item_id long, text string")
    texts = spark.createDataFrame([
        (1, "Intro. If Carol buys 47 pens for 9 euros each and Dave buys 47 books, how much did Carol pay in all for her pens? Done."),
        (2, "Intro. If Carol buys 47 pens for 9 euros each and Dave buys 48 books, how much did Erin pay in all for her pens? Done."),
        (3, "Nothing of this kind is said here, and 12 pens are not enough for Alice to be found in it."), (4, None), (5, ""),
    ], "doc_id long, text string")
    assert {(r.doc_id, r.verbatim) for r in decontaminate.contaminated(texts, own).collect()} == {(1, False)}
    assert {r.doc_id for r in decontaminate.contaminated(texts, own, broadcast_windows=0).collect()} == {1}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_op7_parts_numbers_and_changed_values(spark):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "st", "nd", "sk", "mp", "lt", "rn", "ft", "pt", "ng", "nk", "rm", "lf", "lp", "rd")]
    long, twice = " ".join(words), " ".join(w if k % 9 else "12" for k, w in enumerate(words[:60]))
    items = spark.createDataFrame([(1, long), (2, "Compute 12 + 45 * 3 - 7"), (3, "4 kg 5 km 6 mm 7 cm 8 lb 9 oz 10 mph"), (4, twice)], "item_id long, text string")
    texts = spark.createDataFrame([
        (1, "before it " + " ".join(words[200:350]) + " after it"), (2, "So: compute 12 + 45 * 3 - 7 now"), (3, "so 4 kg 5 km 6 mm 7 cm 8 lb 9 oz 10 mph now"),
        (4, "it is " + twice[: twice.rindex("12")] + "13" + twice[twice.rindex("12") + 2 :]), (5, "So: compute 13 + 45 * 3 - 7 now"), (6, "so 5 kg 5 km 6 mm 7 cm 1 lb 9 oz 11 mph now"), (7, " ".join(words[200:210])),
    ], "doc_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(texts, items, broadcast_windows=limit).collect()}
        assert {(1, 1), (2, 2), (3, 3), (4, 4)} == got


def test_op8_substrings(spark, docs, odd):
    both = docs.union(odd.where("doc_id > 3").select(F.col("doc_id") + 10_000, "text"))
    seen, want = {}, {}
    for r in sorted(both.collect(), key=lambda r: r.doc_id):
        w = WORDS.findall(r.text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), r.doc_id) < r.doc_id:
                gone[k : k + 13] = [True] * 13
        want[r.doc_id] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    for batches in (1, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(both, batches=batches).collect()}
        assert got == want
    lone = {r.doc_id: r.n_removed for r in substrings.substring_dedup(odd).collect()}
    assert lone == {1: 0, 2: 0, 3: 0, 4: 0, None: 0, 6: 0, 7: len(WORDS.findall(ODD[6][1])), 8: 0}
    assert substrings.substring_dedup(odd.where("false")).count() == 0


def test_op8_compaction(spark):
    index = substrings.FingerprintIndex(spark, 4, max_runs=2)
    shared = [sorted(r.hash for r in spark.table(index.add(spark.createDataFrame([(h, d) for h in hs], "hash long, doc_id long"))).collect()) for d, hs in enumerate([[1, 2], [2, 3], [3, 4], [1, 5]])]
    assert shared == [[], [2], [3], [1]] and len(index.runs) == 2
    index.drop(index.tables)


def test_op9_packing(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    both = docs.union(odd.where("doc_id > 5 or doc_id < 4").select(F.col("doc_id") + 10_000, "text"))
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in both.collect()}
    got = packing.pack(both, path, 256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in by_doc.items():
        assert sum(n for _, n in parts) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 256
    assert set(by_doc) == set(ids) and sum(map(len, ids.values())) > 0.95 * 256 * len(by_sequence)
    assert packing.pack(none, path).count() == 0


def similar_lines(texts, percent=80):
    """All pairs of texts by an inverted index of their shingles."""
    sets = [{t[i : i + 7] for i in range(max(1, len(t) - 6))} for t in texts]
    holders, links = {}, []
    for k, own in enumerate(sets):
        both = Counter(j for g in own for j in holders.get(g, ()))
        links += [(k, j) for j, n in both.items() if 100 * n >= percent * (len(own) + len(sets[j]) - n)]
        for g in own:
            holders.setdefault(g, []).append(k)
    return links


def lines_removed(rows):
    spots = [(r.doc_id, k, lines.canonical(x)) for r in sorted(rows, key=lambda r: r.doc_id) for k, x in enumerate((r.text or "").split("\n")) if lines.canonical(x)]
    texts = list(dict.fromkeys(s[2] for s in spots))
    root = dict(zip(texts, roots(len(texts), similar_lines(texts))))
    first, want = {}, Counter()
    for d, k, t in spots:
        want[d] += first.setdefault(root[t], (d, k)) != (d, k)
    return {r.doc_id: want[r.doc_id] for r in rows}


def test_op10_lines(spark, docs, odd, none):
    want = lines_removed(docs.collect())
    got = {r.doc_id: r.n_removed for r in lines.line_dedup(docs).collect()}
    assert got == want and sum(want.values()) > 300
    out = lines.line_dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    kept = [(r.doc_id, r.text, r.n_lines) for r in out.collect()]
    assert (1, None, 0) in kept and (2, "", 1) in kept and (None, ODD[5][1], 1) in kept and (7, "", 1) in kept
    assert lines.line_dedup(none).count() == 0


def test_op10_finds_links_at_the_limit(spark):
    """Recall of lines with one to many changed words; a hub whose variants are unlike each other; both joins."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("aeilnorstkm"), size=6)) for _ in range(2000)]
    hubs = [rng.choice(vocabulary, size=30).tolist() for _ in range(150)]
    rows = []
    for h in hubs:
        rows.append(" ".join(h))
        for n in (1, 1, 2, 2, 3):
            v = list(h)
            for at in rng.choice(30, size=n, replace=False):
                v[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(v))
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(int(k), rows[i]) for k, i in enumerate(order)], "doc_id long, text string")
    want = lines_removed(df.collect())
    for limit in (lines.BROADCAST_BYTES, 0):
        lines.BROADCAST_BYTES, old = limit, lines.BROADCAST_BYTES
        got = {r.doc_id: r.n_removed for r in lines.line_dedup(df).collect()}
        lines.BROADCAST_BYTES = old
        lost = [k for k in want if got[k] != want[k]]
        assert len(lost) <= 0.01 * sum(want.values()) and sum(want.values()) > 300


def test_op10_shared_ids_and_names(spark):
    line = "a line that is long enough to be told apart from any other line"
    rows = [(1, f"{line}\nunique words in the first of two rows", "x", 1), (1, f"other beginning of the second\n{line}", "y", 2), (2, f"x\n{line}", None, 3), (2, f"x\n{line}", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, _gone long")
    got = {(r.doc_id, r.doc, r._gone): (r.text.count("\n") + 1, r.n_removed, "unique" in r.text, "other" in r.text) for r in lines.line_dedup(df).collect()}
    assert got[(1, "x", 1)][2] and got[(1, "y", 2)][3]  # no unique line goes
    assert got[(1, "x", 1)][1] + got[(1, "y", 2)][1] == 1 and got[(2, None, 3)][:2] == got[(2, None, 4)][:2] == (1, 1)


def test_shared_buckets(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(0, 300, size=8)) for k in range(100)] + [(k, [7, 1000 + k]) for k in range(100, 150)] + [(100, [7, 1100])]
    df = spark.createDataFrame([(int(k), np.array(keys, dtype=np.int64).tobytes()) for k, keys in rows], "node long, keys binary")
    want = {}
    for k, keys in rows:
        for key in keys:
            want.setdefault(int(key), set()).add(k)
    want = {frozenset(ks) for ks in want.values() if len(ks) > 1}
    got = [tuple(r) for r in common.shared_buckets(df).collect()]
    held = {}
    for bucket, node in got:
        held.setdefault(bucket, set()).add(node)
    assert len(got) == len(set(got)) and {frozenset(v) for v in held.values()} == want
    assert common.shared_buckets(df.where("false")).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf):
    """Each stage on what its predecessor kept: nulls, empty texts, repeated rows, a null id and a clashing column among it."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(90_001, None), (90_002, ""), (90_003, "  \n\n "), (90_004, "one"), (90_004, "one"), (None, "no id at all, and one line"), (90_005, "word " * 6000)]
    odd = spark.createDataFrame([(i, t, "en", "odd", None) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = rows.unionByName(odd).withColumns({"_gone": F.lit(1), "component": F.lit("x"), "places": F.lit(None).cast("string")})
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "packing"]
    out = {}
    for name in list(stages)[:-1]:
        before = docs
        docs = common.written(stages[name](spark, docs, sf), name)
        out[name] = (before.collect(), docs.collect())
        assert docs.columns == before.columns
        assert stages[name](spark, before.where("false"), sf).count() == 0
    ids = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    before, after = out["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = ids(before) - ids(after)
    assert not ids(after) - ids(before) and sum(labels.get(i) == 0 for i, _ in gone) == 0 and all(i in {r.doc_id for r in after} for i, _ in more)
    before, after = out["line_dedup"]
    want = lines_removed([r for r in {(r.doc_id, r.text): r for r in before if r.doc_id is not None}.values()])
    left = {r.doc_id: (r.text or "").count("\n") for r in after}
    assert len(after) == len(before) and sum(want.values()) > 0
    for r in before:
        if r.doc_id is None:
            assert any(x.doc_id is None and x.text == r.text for x in after)
        elif want[r.doc_id] < (r.text or "").count("\n") + 1:  # a text of which no line is left is empty
            assert left[r.doc_id] == (r.text or "").count("\n") - want[r.doc_id]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    before, after = out["ngram_join"]
    one = list({r.doc_id: r for r in before if r.doc_id is not None}.values())
    sets = [shingles(r.text, 5) for r in one]
    root = roots(len(one), [(x, y) for x in range(len(one)) for y in range(x) if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])])
    least = {}
    for k, r in enumerate(one):
        least[root[k]] = min(least.get(root[k], r.doc_id), r.doc_id)
    assert {r.doc_id for r in after} == {*least.values(), None} and len(after) == sum(r.doc_id is None or r.doc_id in set(least.values()) for r in before)
    before, after = out["decontaminate"]
    flat = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before if not any(i and i in flat(r.text) for i in items)}
    assert {r.doc_id for r in after} == clean
    packed = stages["packing"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in after) and stages["packing"](spark, docs.where("false"), sf).count() == 0


def _phrases(rows, words=4, least=30, top=2000, covered=80):
    """Phrases of each language by counting texts."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longest[lang, p[i : i + m]] = max(longest[lang, p[i : i + m]], a)
    out = []
    for lang in n:
        best = []
        for (x, p), a in cand.items():
            if x == lang and 100 * longest[x, p] < covered * a:
                score, k = min((2000000 * a // (f[x, p[:k]] + f[x, p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), k, f[x, p[:k]], f[x, p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, _, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def test_op11_collocations(spark, docs, none):
    rng = np.random.default_rng(3)
    pick = lambda k: " ".join(rng.choice(["New", "york", "the", "CITY", "of\tü", "a,b", "x.", "ß  q", "n\x0bm"], k).tolist())
    rows = [(k, ["en", "de", None][k % 3], pick(int(rng.integers(1, 60)))) for k in range(150)]
    rows += [(500, "en", None), (501, None, ""), (502, "en", " \t .,;"), (503, "fr", "only these few words"), (None, "en", "new york " * 40), (7, "en", "the city of " * 15_000), (7, "en", "the city of " * 15_000)]
    own = spark.createDataFrame([(*r, r[2], 0) for r in rows], "doc_id long, lang string, text string, phrase string, words int")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for bits in (64, 7):  # of 7 bits, most fingerprints are shared: texts tell them apart
        for least, top in ((30, 2000), (3, 40)):
            got = collocations.collocations(own, least=least, top=top, bits=bits).select(*columns).collect()
            assert sorted(map(tuple, got)) == _phrases([r[1:] for r in rows], least=least, top=top)
    assert collocations.collocations(none.selectExpr("doc_id", "text", "cast(null as string) lang")).count() == 0


def _repaired(rows):
    """Conversations damaged and repaired by trying all edits."""
    white = " \t\n\x0b\x0c\r"
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if what == 1 else "".join(c for c in text if c not in ".!?") if what == 2 else text
        held += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
    out = {}
    for conv, v in convs.items():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in v:
            shown = text.rstrip(white)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))

        best = {(len(v), at): [min([(0, "", ())] if at in ("", "a") else [(3, "I", (("assistant", ""),))] if at == "u" else [(6, "II", (("user", ""), ("assistant", "")))])] for at in ("", "s", "u", "a")}
        for i in range(len(v) - 1, -1, -1):
            _, role, text = v[i]
            extra = 3 * (faults[i] == "truncated")
            plain = {}
            for at in ("", "s", "u", "a"):
                after = lambda to: best[i + 1, to][0]  # noqa: E731, B023
                able = [(4 + after(at)[0], "D" + after(at)[1], after(at)[2])]
                if faults[i] not in ("blank", "duplicate"):
                    for new, edit, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                        if (at, new[:1]) in step:
                            x = after(step[at, new[:1]])
                            able.append((price + extra + x[0], edit + x[1], ((new, text), *x[2])))
                plain[at] = able
            for at in ("", "s", "u", "a"):
                able, now, put = list(plain[at]), at, ()
                for k in range(1, 4):
                    new = "assistant" if now == "u" else "user"
                    now, put = step[now, new[0]], (*put, (new, ""))
                    able += [(3 * k + c, "I" * k + e, (*put, *r)) for c, e, r in plain[now]]
                best[i, at] = [min(able)]
        cost, audit, repaired = best[0, ""][0]
        pairs, turns = [a[1][:1] + b[1][:1] for a, b in zip(v, v[1:])], [r[0] for r in v if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(n) for n in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def test_op12_conversations(spark, sf):
    rng = np.random.default_rng(5)
    one = lambda x: x[int(rng.integers(len(x)))]
    rows = [(one([None, 1, 2, 3, 4]), one([None, 0, 1, 2, 3, 4, 5, 9]), one(["user", "assistant", "system", "tool", "", None, "sage"]), one([None, "", " \x0b", "hi.", "what?", "cut", "x!! \n", "a b", "é."])) for _ in range(200)]
    rows += [(77, k, ("user", "assistant")[k % 2], f"t{k}" + ".," [k % 3 == 0]) for k in range(600)] + [(78, k, "user", "same.") for k in range(50)] + [(79, 1, "user", "long. " * 20_000)] * 3
    rows += [(100 + k, 0, "user", "gone.") for k in range(60)]  # of some, no row is left
    own = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(own.repartition(5)).collect()}
    assert got == _repaired(rows) and any(v[6] == "" for v in got.values())
    assert conversations.repair(own.where("false")).count() == 0
    as_is = {r.conv_id: r.audit for r in conversations.repair(own.where("conv_id = 77"), damage=False).collect()}
    assert as_is == {77: "K" * 600}
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = _repaired([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert {r[0]: tuple(r[1:]) for r in queries.op12_conversations(spark, sf).collect()} == want


def test_op12_long_conversations_stay_small_at_a_node():
    """Every rest is a node, and what a node holds does not grow with the rest."""
    automaton = conversations.Automaton()
    text = "".join(chr(conversations.BASE + int(c)) for c in np.random.default_rng(1).integers(0, 20, 50_000))
    cost, audit = automaton.solve(text)
    assert len(audit) - audit.count("I") == len(text) and cost > 0
    assert len(automaton.seen) < 2_000 and len({id(x) for x in automaton.path}) < 2_000
    assert automaton.solve(text[1:]) == conversations.Automaton().solve(text[1:]) and len(automaton.path) == len(text)


def test_op13_spots(spark, docs, sf, odd, none):
    got = {r.doc_id: r for r in queries.op13_spots(spark, sf).collect()}
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert len(got) == len(texts)
    prints = {}
    for k, (doc, text) in enumerate(texts):
        m, after = len(text) // 4, texts[(k + 1) % len(texts)][1]
        row = got[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest())
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        sets = [{x[i : i + 8] for i in range(0, len(x), 8)} for x in (row.fingerprint, row.edited_fingerprint, got[texts[(k + 1) % len(texts)][0]].fingerprint)]
        for other, near in zip(sets[1:], (row.near_edited, row.near_next), strict=True):
            assert abs(len(sets[0] & other) / len(sets[0] | other) - near) < 1e-12
    likely = [r.near_edited for r in got.values() if r.n_chars > 400]
    assert np.mean(np.array(likely) > 0.4) > 0.9 and np.mean([r.near_next < 0.2 for r in got.values()]) > 0.9
    rows = spots.compare_edits(odd).orderBy("doc_id", "n_chars").collect()
    # the null id comes first and, of an id's rows, equal ones are one document; each row has its result
    assert len(rows) == len(ODD) and rows[0].doc_id is None and len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1
    last = next(r for r in rows if r.doc_id == 8)
    assert last.n_chars == 60_000 and last.edited == ("x " * 30_000)[:45_000] + dict(ODD[5:6])[None]
    assert spots.compare_edits(none).count() == 0
    alone = spots.compare_edits(odd.where("doc_id = 4")).collect()
    assert [r.edited for r in alone] == ["one"] * 2  # three letters have no quarter


def test_op13_anchors_and_chains(spark):
    """Spots by hand: each common word with the content words after it."""
    texts = [(1, "The big dog is on the green hill of home"), (2, "the BIG dog -- is on the green hill, of home!"), (3, "menu | home | contact us | about page"), (4, "?!"), (5, None), (6, "")]
    df = spots.with_spots(spark.createDataFrame(texts, "doc_id long, text string"), F.col("text"))
    found = {r.doc_id: r.spots for r in df.collect()}
    # the:big-dog, is:green-hill, on:green-hill, the:green-hill; "of" has one word after it only
    assert len(found[1]) == 4 and found[1] == found[2] and len(found[3]) == 3 and found[5] == found[6] != found[4]


def test_op13_near_duplicates(spark, docs, odd, none):
    extra = [(90_000 + k, r.text + " the last words of it") for k, r in enumerate(docs.where("text is not null").limit(40).collect())]
    rows = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: (r.n_spots, r.component_id) for r in spots.near_duplicates(rows.withColumn("node", F.lit(1)).withColumn("spots", F.lit("x"))).collect()}
    sets = {r.doc_id: set(r.spots) for r in spots.with_spots(rows, F.col("text")).collect()}
    ids = sorted(sets)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if 100 * len(sets[ids[a]] & sets[ids[b]]) >= 80 * len(sets[ids[a]] | sets[ids[b]])]
    want = roots(len(ids), links)
    assert got == {d: (len(sets[d]), ids[want[k]]) for k, d in enumerate(ids)} and any(r != k for k, r in enumerate(want))
    assert spots.near_duplicates(none).count() == 0
    assert {r.doc_id for r in spots.near_duplicates(odd).collect()} == {i for i, _ in ODD if i is not None}


def test_op4_counts_beyond_32_bits(spark):
    """A count of any size keeps its level."""
    counts = [1, 254, 255, 256, 1 << 31, 1 << 32, (1 << 32) + 1, 1 << 40, 1 << 62]
    hashes = np.random.default_rng(8).integers(-(1 << 62), 1 << 62, len(counts))
    words = spark.createDataFrame([(int(h), n) for h, n in zip(hashes, counts)], "hash long, n long")
    stored = lm.pair_blocks(spark.createDataFrame([], "text string"), words, 2)
    (part,) = lm._parts(stored, 2, 1 << 30)
    got = part.levels(lm.mixed(hashes.view(np.uint64)), True)
    want = lm.level(np.array(counts))
    assert got.tolist() == want.tolist() and len(set(want.tolist())) >= 6
    assert all(lm.LEVELS[q] / lm.BASE <= n <= lm.LEVELS[q] * lm.BASE for q, n in zip(want.tolist(), counts))


def test_op3_dictionaries_hold_a_part_of_every_text(spark):
    letters = "αβγδεζηθικλμνξοπρστυφχψω"
    rows = [(k, "el", " ".join(letters[k % 24] * 3 + letters[(k + j) % 24] for j in range(400))) for k in range(240)] + [(500, "en", "a plain text of words " * 40), (501, None, "x"), (502, "en", None), (503, "en", "12 34")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, lang string, text string, margin int")
    learned = language.fit_dictionaries(df, sample_docs=240, dict_bytes=24 << 10)
    assert set(learned) == {"el", "en"} and len(learned["el"]) <= 24 << 10
    held = learned["el"].decode()
    assert all(c * 3 in held for c in letters)  # those of the first letters as well as those of the last
    # repeated rows are judged alike
    out = language.identify(df.union(df), learned).collect()
    found = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == 2 * len(found) == 2 * df.count() and len({(r.doc_id, r.lang_pred, r.score) for r in out}) == len(found)
    assert (found[500], found[502], found[503]) == ("en", "und", "und") and sum(found[k] == "el" for k in range(240)) > 200
    assert language.identify(df.where("false"), learned).count() == 0


def _questions(rng, n):
    """Questions with numbers, names and units in places of their own: a template of words for each, and a way to fill it."""
    syllables = ["ka", "lo", "mi", "tar", "ven", "su", "pel", "dro", "ni", "ber"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(2, 4))).tolist())
    out = []
    for _ in range(n):
        plain = [word() for _ in range(int(rng.integers(18, 30)))]
        kinds = rng.permutation(["number", "number", "name", "name", "unit", "number"]).tolist()[: int(rng.integers(3, 7))]
        at = sorted(rng.choice(np.arange(3, len(plain) - 2), len(kinds), replace=False).tolist())
        out.append((plain, list(zip(at, kinds, strict=True))))
    return out


def _filled(rng, question, moved=False):
    plain, slots = question
    name = lambda: str(rng.choice(["Alice", "Bruno", "Carla", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ingrid", "Jonas"]))
    fill = {"number": lambda: str(int(rng.integers(2, 9000))), "name": name, "unit": lambda: str(rng.choice(["kg", "km", "hours", "miles", "dollars", "litres"]))}
    used, text = set(), list(plain)
    for at, kind in slots:
        value = next(v for v in (fill[kind]() for _ in range(500)) if v not in used)  # other values, one for each place
        used.add(value)
        text[at] = f"{text[at]} {value}"
    return " ".join(text)


def test_op7_finds_reparameterised_items(spark):
    """Of 320 items whose numbers, names and units are all new, nine in ten are found; no other pair is."""
    rng = np.random.default_rng(12)
    asked = _questions(rng, 320)
    items = [(k, _filled(rng, q)) for k, q in enumerate(asked)]
    filler = [" ".join(q[0]) for q in _questions(rng, 400)]
    rows = [(k, f"{filler[k]}. {_filled(rng, q)}. {filler[(k + 7) % 400]}.") for k, q in enumerate(asked)]
    rows += [(1000 + k, f"{filler[k]}. {_filled(rng, q)}.") for k, q in enumerate(_questions(rng, 320))]  # questions of their own
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()
    right = sum(r.doc_id == r.item_id for r in found)
    assert right / 320 >= 0.9 and len(found) - right <= 3, (right, len(found))
