"""N-gram join, substring removal, decontamination and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pactlane.llm import decontaminate, ngram_join, substring

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    words = SPACE.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_components(rows, width, num, den):
    sets = [(d, shingles(t, width)) for d, t in rows]
    best = {k: k for k in range(len(rows))}

    def find(k):
        while best[k] != k:
            k = best[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and den * both >= num * len(sets[a][1] | sets[b][1]):
                best[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: (len(s), least[find(k)]) for k, (d, s) in enumerate(sets)}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 50)])
def test_join_equals_all_pairs(docs, texts, width, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs, width, num, 100).collect()}
    assert got == brute_components([(k * 3, t) for k, t in enumerate(texts)], width, num, 100)


def test_join_in_small_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "SKETCHED_CLASSES", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs, 5, 80, 100).collect()}
    assert got == brute_components([(k * 3, t) for k, t in enumerate(texts)], 5, 80, 100)


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        other = np.unique(np.concatenate((base[: rng.integers(150, 200)], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64))))
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        linked = 100 * both >= 80 * (len(base) + len(other) - both)
        shown = [(k, len(s), ngram_join.sketch(s, 80, 100)) for k, s in enumerate((base, other))]
        assert not linked or ngram_join.candidates(shown, 80, 100)
        assert bool(ngram_join.linked([0, 1], [base, other], 80, 100)) == linked


def test_keep_one_with_repeats_and_nulls(spark, docs, texts):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (2, "other words here and there now"), (None, None), (5, ""), (1, "a b c d e f g")]
    got = sorted(map(tuple, ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "a b c d e f g"), (2, "other words here and there now"), (None, None), (5, "")], key=str)
    kept = {r.doc_id for r in ngram_join.keep_one(docs).select("doc_id").collect()}
    want = brute_components([(k * 3, t) for k, t in enumerate(texts)], 5, 80, 100)
    assert kept == {d for d, (n, c) in want.items() if d == c}


def test_join_of_nothing(empty):
    assert ngram_join.similar(empty).count() == 0
    assert ngram_join.keep_one(empty).columns == empty.columns


def brute_removed(rows, width):
    words = [(d, SPACE.findall(t or "")) for d, t in sorted(rows, key=lambda r: r[0])]
    seen, out = set(), {}
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [20, 3, 1])
def test_substrings_equal_a_scan(docs, texts, width):
    got = {r.doc_id: (r["__n_words"], r["__n_removed"], r.text) for r in substring.deduplicate(docs, width, digest=True).collect()}
    assert got == brute_removed([(k * 3, t) for k, t in enumerate(texts)], width)


def test_cut_text_keeps_the_rest(docs, texts):
    got = {r.doc_id: (r.text, r["__n_removed"]) for r in substring.deduplicate(docs).collect()}
    for k, t in enumerate(texts):
        text, removed = got[k * 3]
        if not removed:
            assert text == t
        else:
            assert len(SPACE.findall(text)) == len(SPACE.findall(t)) - removed


def test_substrings_of_repeated_rows_and_nulls(spark, empty):
    long = " ".join(map(str, range(30)))
    rows = [(1, long), (1, long), (None, None), (None, "x y"), (4, long + " end")]
    got = sorted(((r.doc_id, r.text, r["__n_removed"]) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, long, 0), (1, long, 0), (None, None, 0), (None, "x y", 0), (4, "end", 30)], key=str)
    assert substring.deduplicate(empty).count() == 0


def test_substrings_of_rows_that_share_an_id(spark):
    """Null-id and same-id rows with different texts are documents of their own."""
    word = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    shared, early = word("s", 25), word("e", 30)
    rows = [
        (None, " ".join(word("a", 30) + shared + word("b", 30))), (None, " ".join(word("c", 90))), (None, " ".join(word("d", 30) + shared + word("f", 30))),
        (7, " ".join(word("g", 40) + early)), (7, " ".join(word("h", 90))), (7, " ".join(word("i", 40) + early)), ((1 << 60) + 1, " ".join(shared + word("j", 30))),
    ]
    rows += [rows[0], rows[3]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kinds = frame.select("doc_id", "text", F.xxhash64("text").alias("h")).distinct().collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.h), r.text) for r in kinds)
    brute = brute_removed(order, 20)
    want = {(d if known else None, dict(order)[known, d, h]): brute[known, d, h][1:] for known, d, h in brute}
    got = substring.deduplicate(frame.withColumn("source", F.col("text")), 20, digest=True).collect()
    assert len(got) == len(rows)
    assert all(want[r.doc_id, r.source] == (r["__n_removed"], r.text) for r in got)
    assert sorted(n for n, _ in want.values()) == [0, 0, 0, 0, 25, 25, 30]


NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, width):
    words = NORMAL.findall(lower(text))
    hit, met = set(), set()
    for name, item in items:
        w = NORMAL.findall(lower(item))
        for i in range(max(1, len(w) - width + 1)) if w else ():
            window = w[i : i + min(width, len(w))]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    met.add(name)
    return len(words), len(hit), sorted(str(m) for m in met if m is not None)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 20])
def test_hits_equal_brute_force(spark, docs, texts, block_words):
    picked = [t for t in texts if t and 30 < len(t) < 1200][:5]
    items = [(k, " ".join(t.split()[4:24])) for k, t in enumerate(picked)] + [(10, None), (11, ""), (12, "lazy"), (13, "over a"), (None, "fox jumps"), (14, "over a"), (0, "the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = docs.where(F.length("text") < 2000).unionByName(docs.where("text IS NULL"))
    out = decontaminate.matches(small, bench, 10, block_words).withColumn("n_hit", decontaminate.hit_words())
    got = {r.doc_id: (r["__n_words"], r.n_hit, r["__items"]) for r in out.collect()}
    want = {k * 3: brute_hits(t, items, 10) for k, t in enumerate(texts) if t is None or len(t) < 2000}
    assert got == want and any(w[1] for w in want.values())


def test_decontaminate_cuts_spans_and_drops_covered_rows(spark, docs, empty):
    window = " ".join(f"w{k}" for k in range(10))
    rows = [(1, f"Before, {window}. After it all the words that are left are kept, as they are.", "x"), (2, window, "y"), (3, "clean  text\n", "z"), (None, None, None)]
    bench = spark.createDataFrame([(1, window.upper())], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string, token string"), bench).collect()), key=str)
    assert got == sorted([(1, "Before, After it all the words that are left are kept, as they are.", "x"), (3, "clean  text\n", "z"), (None, None, None)], key=str)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = __import__("random").Random(5)
    plain = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    rows, labels = [], []
    for k in range(300):
        text = plain(80)
        if k % 10 == 3:
            text = f"vile {text} vile nasty {plain(5)} nasty"
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, int(k % 10 == 3)))
    copy, passage, item = rows[20][1], plain(60), plain(12)
    rows += [(1000, copy, "en", "s", 1), (1001, copy + " tail", None, None, None), (1002, f"{plain(30)} {passage}", "en", "s", 1), (1003, f"{passage} {plain(30)}", "en", "s", 1)]
    rows += [(1004, f"{plain(30)} {item} {plain(30)}", "en", "s", 1), (1005, None, None, None, None), (1006, "", "en", "s", 0), (None, plain(9), "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frames[-1], str(tmp_path)).write.parquet(f"{tmp_path}/out{n}")
        frames.append(spark.read.parquet(f"{tmp_path}/out{n}"))
        if n < len(cp.STAGES) - 1:
            assert frames[-1].columns == frames[0].columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    toxic = {k for k in range(300) if k % 10 == 3}
    assert ids[0] - ids[1] == toxic
    assert ids[1] - ids[2] == {1000, 1001}
    assert ids[3] == ids[2] and ids[4] == ids[3]
    text = {r.doc_id: r.text for r in frames[4].collect()}
    assert passage in text[1002] and passage not in text[1003] and len(text[1003].split()) == 30
    assert item not in text[1004] and len(text[1004].split()) == 60
    assert all(text[k] == rows[k][1] for k in range(300) if k not in toxic)
    assert text[1005] is None and text[1006] == ""
    ran = cp.run(spark, str(tmp_path))
    assert sorted(map(str, ran.collect())) == sorted(map(str, frames[5].collect()))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "bpe"]
