"""Near duplicates and passages found through indexes, against plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pactlane.functions.folding import Folder, starts
from pactlane.operators import curate as K
from pactlane.operators import decode as X
from pactlane.operators import neardup as N
from pactlane.operators import spans as S


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng: random.Random, text: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
    return "".join(out)


@pytest.mark.parametrize("ratio", [0.02, 0.05, 0.1, 0.2, 0.3, 0.45])
def test_edit_pairs_are_complete(spark, ratio):
    rng = random.Random(int(100 * ratio))
    words = ["ab", "cé", "d", "efg", "hi", "漢字", "j"]
    texts = ["", "a", "ab", "abc", "abxc", "abcd", "b" * 30, "b" * 31]
    for size in (3, 8, 20, 45, 60, 80):
        base = " ".join(rng.choice(words) for _ in range(size))
        texts += [base, *(edited(rng, base, rng.randint(1, max(1, int(len(base) * ratio)))) for _ in range(4))]
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "first long, text string").repartition(3)
    got = {(r.i, r.j): (r.distance, r.ratio) for r in N.edit_pairs(df, ratio).collect()}
    want = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            d, n = distance(a, texts[j]), max(len(a), len(texts[j]))
            if d < n * ratio:
                want[i, j] = (d, d / n)
    assert got == want and want


def test_greedy_keeps_what_the_loop_keeps(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(["one", "two", "three"]) for _ in range(30))
    texts = [base]
    for _ in range(25):  # a chain of ever farther copies, so that kept and removed alternate
        texts.append(edited(rng, texts[-1], 3))
    texts += [base, None, None, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    kept: list[int] = []
    for k, t in enumerate(texts):
        if all((texts[e] or "") != (t or "") and distance(texts[e] or "", t or "") >= 0.05 * max(len(texts[e] or ""), len(t or "")) for e in kept):
            kept.append(k)
    got = {r.key: r.kept for r in N.greedy_kept(df, "key", "text", 0.05).collect()}
    assert got == {k: k in kept for k in range(len(texts))}


def plain_occurrences(passages, sources):
    folder, out = Folder(), set()
    for pk, p in passages:
        for sk, s in sources:
            if not p or not s or not folder.fold(p)[0]:
                continue
            body, origin = folder.fold(s)
            wanted = folder.fold(p)[0]
            exact = set(starts(p, s))
            lead = folder.fold(p)[1][0]
            for at in starts(wanted, body):
                a, b = int(origin[at]), int(origin[at + len(wanted) - 1]) + 1
                own = a - int(lead)
                if folder.fold(s[a:b])[0] == wanted or own in exact:
                    whole = folder.fold(s[a:b])[0] == wanted
                    out.add((pk, sk, a if whole else None, b if whole else None, own if own in exact else None))
    return out


def test_occurrences_match_plain_search(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    sources = [(k, " ".join(word() for _ in range(rng.randint(0, 120)))) for k in range(30)] + [(90, None), (91, ""), (92, "aaaaaaaaaa"), (93, "ﬁne ﬁ fi FI")]
    passages = [(900, None), (901, ""), (902, "?! "), (903, "aaa"), (904, "fi"), (905, "f"), (906, "(fi")]
    for k in range(40):
        text = rng.choice(sources[:30])[1]
        a = rng.randrange(len(text) + 1)
        part = text[a : a + rng.choice([1, 2, 5, 9, 33, 60, 200])]
        passages.append((k, rng.choice([part, part.upper(), part.replace(" ", "-"), part + "z", "«" + part])))
        sources.append((100 + k, text[: len(text) // 2] + " " + part + ". " + part.upper()))
    passages.append((1000, passages[10][1]))
    s = spark.createDataFrame(sources, "key long, text string").repartition(3)
    p = spark.createDataFrame([(f"p{k}", t) for k, t in passages], "key string, text string")
    found = S.occurrences(p, s)
    got = [tuple(r) for r in found.collect()]
    want = plain_occurrences([(f"p{k}", t) for k, t in passages], sources)
    assert len(got) == len(set(got)) and set(got) == want
    checked = {(r.passage_key, r.source_key): r for r in S.verified(found).collect()}
    for key in {w[:2] for w in want}:
        exact = [w for w in want if w[:2] == key and w[4] is not None]
        folded = {w[2:4] for w in want if w[:2] == key and w[2] is not None}
        n = len(exact) or len(folded)
        assert checked[key].candidate_span_count == n
        assert checked[key].status == ("AMBIGUOUS_MULTIPLE_MATCHES" if n > 1 else "VERIFIED_EXACT_UNIQUE" if exact else "VERIFIED_NORMALIZED_UNIQUE")
    assert S.occurrences(p.where(F.col("key") == "p902"), s).collect() == []


def test_prints_travel_packed_to_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_PRINTS", 500)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(900)) for _ in range(30)]
    texts += [edited(rng, t, 20) for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "first long, text string")
    assert {(r.i, r.j) for r in N.edit_pairs(df, 0.05).collect()} == {(k, 30 + k) for k in range(10)}
    rows = df.select(F.col("first"), "text").mapInArrow(N._pack(0.05, 4, 1, N.np.empty(0, N.np.uint64)), N.PACKED).collect()
    held = sum(len(r[c]) for r in rows for c in ("ids", "sizes", "needs", "behind", "counts", "prints", "weights"))
    assert held < 3 * sum(map(len, texts))


def test_balanced_payload_walks_a_text_once(spark):
    texts = ['{"a":1}', 'x {"a":{"b":"}"}} {', "none", None, "{", '{"a":1} {"b":2}', "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.balanced_payload(F.col("t")).alias("out"))
    assert [r.out for r in df.collect()] == ['{"a":1}', '{"a":{"b":"}"}}', "none", None, "{", '{"a":1}', ""]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_a_filter_on_the_verdict_does_not_repeat_the_parse(spark):
    df = spark.createDataFrame([("a", "dev", "x", "{}", "p")], "id string, split string, input_text string, target string, provenance string")
    out = K.check_rows(df)
    reads = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
    assert reads(out.where("violation IS NOT NULL")) == reads(out) > 0
    assert [r.violation for r in out.where("violation IS NOT NULL").collect()] == ["invalid_contract"]
