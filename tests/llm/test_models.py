"""Toxicity, language, fingerprints and URL verdicts: brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from pactlane.llm import fingerprint, language, toxicity, urls


def all_segments(scores):
    """Ruzzo-Tompa by its definition: the best segment, then both sides of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    left = [s for s in all_segments(scores[:a])]
    right = [(x + b, y + b, s) for x, y, s in all_segments(scores[b:])]
    return [*left, best, *right]


def test_segments_equal_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 25)
        hits = [(i, rng.choice([0.5, 1.0, 2.0, 3.25])) for i in range(n) if rng.random() < 0.3]
        scores = [-0.4375] * n
        for i, s in hits:
            scores[i] = s
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(hits, 0.4375)]
        assert got == [(a, b, round(s, 6)) for a, b, s in all_segments(scores)]


def test_rate_solves_its_equation():
    import numpy as np

    s, p = np.array([3.0, 4.0]), np.array([0.01, 0.002])
    x = toxicity._rate(s, p, 0.25)
    assert x > 0 and abs((p * np.exp(x * s)).sum() + (1 - p.sum()) * math.exp(-0.25 * x) - 1) < 1e-6


def fold(k):
    return zlib.crc32(str(k).encode()) % 5


def corpus(n=400):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        if k % 5 == 1:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 1)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {b"vile", b"nasty", b"rotten"} <= set(model["lexicon"])
    held = [k for k, _ in rows if fold(k) == 0]
    got = {r.doc_id: r["__score"] for r in toxicity.score(docs, model).collect()}
    assert sum((got[k] >= 0.5) == (k % 5 == 1) for k in held) >= 0.95 * len(held)
    # labels of held-out rows are never read
    turned = spark.createDataFrame([(k, 1 - t if fold(k) == 0 else t) for k, t in labels], "doc_id long, toxic int")
    assert toxicity.train(docs, turned) == model


def test_toxicity_edge_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none))
    assert got.columns == [*docs.columns, "__score", "__passages"]
    assert {round(r["__score"], 6) for r in got.collect()} == {0.25}
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    scores = [r["__score"] for r in toxicity.score(docs, toxicity.train(docs, odd)).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(scores) == docs.count()


def test_language_held_out(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "ti", "ro", "mu"], "bb": ["sch", "ein", "ung", "ä"], "cc": ["eau", "tion", "é", "oi"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang) for k, lang in enumerate(sorted(parts) * 60)]
    rows += [(900, None, "aa"), (901, "12 34 !?", "bb"), (902, "", None), (None, "kati", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: (r["__lang"], r["__score"]) for r in language.predict(docs, model).collect()}
    held = [r for r in rows[:180] if fold(r[0]) == 0]
    assert all(got[k][0] == lang and 0.5 < got[k][1] <= 1 for k, _, lang in held)
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    changed = spark.createDataFrame([(k, t, "zz" if k is not None and fold(k) == 0 else lang) for k, t, lang in rows], "doc_id long, text string, lang string")
    again = language.train(changed)
    assert again["langs"] == model["langs"] and (again["matrix"] == model["matrix"]).all()


def test_language_scores_equal_single_sums(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    matrix = np.log(rng.random((language.BUCKETS, 3))).astype(np.float32)
    texts = ["Kati 12 roMu".encode(), None, b"a", "é".encode() * 9, b"x " * 200]
    named, scores = language.classify(texts, ["a", "b", "c"], matrix)
    old, language.SLICE = language.SLICE, 7
    try:
        assert language.classify(texts, ["a", "b", "c"], matrix)[0] == named
    finally:
        language.SLICE = old
    for text, lang, score in zip(texts, named, scores, strict=True):
        g = language.grams(language.codes(text))
        if not len(g):
            assert (lang, score) == ("und", 0.0)
            continue
        sums = matrix[g].astype(np.float64).sum(0) / math.sqrt(len(g))
        p = np.exp(sums - sums.max())
        assert lang == "abc"[int(sums.argmax())] and abs(score - (p / p.sum()).max()) < 1e-6


def test_language_of_nothing(spark, empty, docs):
    assert language.predict(empty, language.train(empty)).count() == 0
    got = language.predict(docs, language.train(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["__lang"] for r in got.collect()} == {"und"}


def lz_phrases(text):
    seen, at = set(), 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in seen:
            size += 1
        if at + size > len(text):
            break
        seen.add(text[at : at + size])
        at += size
    return seen


def test_phrases_equal_the_definition(texts):
    for t in texts:
        if t is not None and len(t) < 3000:
            cut = len(t) // 3
            parsed = fingerprint.Phrases().feed(t[:cut]).copy().feed(t[cut:])
            assert set(parsed.phrases) == lz_phrases(t)


def test_likeness_follows_the_phrase_sets():
    rng = random.Random(3)
    for _ in range(20):
        a = "".join(rng.choice("abcdefgh ") for _ in range(4000))
        b = a[:2500] + "".join(rng.choice("abcdefgh ") for _ in range(1500))
        x, y = lz_phrases(a), lz_phrases(b)
        prints = [fingerprint.Phrases().feed(t).fingerprint() for t in (a, b)]
        assert abs(fingerprint.likeness(*prints) - len(x & y) / len(x | y)) < 0.25


def test_neighbours_in_many_ranges(spark, docs, texts, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 5000)
    got = {r.doc_id: r for r in fingerprint.with_neighbours(docs).collect()}
    rows = [(k * 3, t or "") for k, t in enumerate(texts)][::-1]
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) - len(t) // 3
        edited = t[:cut] + after[: len(t) // 3]
        a, b, c = (fingerprint.Phrases().feed(x).fingerprint() for x in (t, edited, after))
        want = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c))
        assert tuple(got[d]) == want
    assert fingerprint.with_neighbours(empty).count() == 0
    one = fingerprint.with_neighbours(docs.where("doc_id = 30")).collect()[0]
    assert one.near_next == 1.0
    twice = fingerprint.with_neighbours(docs.where("doc_id < 9").unionByName(docs.where("doc_id < 9")).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))))
    assert twice.count() == 6


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_rules(spark):
    rows = {
        "http://A.EXAMPLE.com/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://b.net/es/2#t": ("b.net", "/es/2", "net/es/", "block"),
        "http://c.com": ("c.com", "", None, "allow"),
        "c.com/en": ("", "", None, "allow"),
        "x://://y": (":", "//y", None, "allow"),
        "http://c.com?u=http://d.com/": ("c.com", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, None, "h") for k, u in enumerate(rows)] + [(99, None, None, "h")], "page_id long, url string, html string, host string")
    got = {r.url: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in urls.judge(pages, RULES).collect()}
    assert got == rows | {None: ("", "", None, "allow")}
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_propagation_equals_a_dense_walk(spark):
    import numpy as np

    pages = [("good.com", "allow"), ("good.com", "allow"), ("hub.org", None), ("bad.net", "block"), ("farm.org", None), ("sub.farm.org", None), ("lone.org", None)]
    html = {"good.com": '<a href="https://hub.org/x">', "hub.org": "<a HREF='//good.com/'><img src=http://Hub.org/i>", "farm.org": '<a href="http://bad.net/">' * 3 + '<a href="/own">'}
    frame = spark.createDataFrame([(h, a, html.get(h)) for h, a in pages], "host string, action string, html string")
    links = urls.host_links(frame)
    edges = {(r.a, r.b): r.n for r in links.collect()}
    assert edges == {("good.com", "hub.org"): 2, ("hub.org", "good.com"): 1, ("farm.org", "bad.net"): 3, ("farm.org", "sub.farm.org"): 1, ("sub.farm.org", "farm.org"): 1}
    got = {r.host: (r.trust, r.distrust) for r in urls.host_shares(frame, links).collect()}
    names = sorted({h for h, _ in pages})
    w = np.zeros((len(names), len(names)))
    for (a, b), n in edges.items():
        w[names.index(a), names.index(b)] = n

    def walk(m, seed):
        p = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        r = s = (1 - urls.DAMPING) * seed
        for _ in range(urls.STEPS):
            r = s + urls.DAMPING * p.T @ r
        return r

    share = lambda action: np.array([np.mean([x == action for h, x in pages if h == n]) for n in names], float)
    trust, distrust = walk(w, share("allow")) / walk(w, np.ones(len(names))), walk(w.T, share("block")) / walk(w.T, np.ones(len(names)))
    for k, n in enumerate(names):
        assert np.allclose(got[n], (trust[k], distrust[k]))
    assert got["hub.org"][0] > 0.3 and got["farm.org"][1] > 0 and got["lone.org"] == (0.0, 0.0)
