"""Small fixtures with results worked out by hand or by brute force."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pactlane.functions.contract import with_contract
from pactlane.operators import cohorts as G
from pactlane.operators import compare as P
from pactlane.operators import neardup as N
from pactlane.operators import provenance as V
from pactlane.operators.split import stratified_split
from pactlane.sources import rows as R

GOOD = {
    "task_type": "search", "route": "search_web", "safety": {"allow": True, "reason": "public_readonly"}, "confirmation_required": False,
    "slots": {"query": "a"}, "normalized_command": "搜索a", "language": "zh-CN", "contract_version": "v1",
}


def text(**changes) -> str:
    body = {**GOOD, **changes}
    return json.dumps({k: v for k, v in body.items() if v is not ...}, ensure_ascii=False)


def test_contract_verdicts(spark):
    cases = [
        (text(), None),
        (text() + " tail", "prediction must parse as exactly one root JSON object"),
        (text() + "] ,[{}", "prediction must parse as exactly one root JSON object"),
        ("null", "prediction must parse as exactly one root JSON object"),
        (text(route=...), "missing required fields: route"),
        (text(note=1), "unexpected top-level fields: note"),
        (text(confirmation_required="true"), "confirmation_required must be a boolean"),
        (text(safety={"allow": 1, "reason": "x"}), "safety.allow must be a boolean"),
        (text(safety={"allow": True, "reason": "x", "z": 1}), "unexpected safety fields: safety.z"),
        (text(normalized_command=" "), "normalized_command must be a non-empty string"),
        (text(normalized_command=5), "normalized_command must be a non-empty string"),
        (text(slots=[]), "slots must be an object"),
        (text(language="en"), "language must be zh-CN"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = {r.i: r.validation_error for r in with_contract(df, "raw", "c", "t", "s").select("i", "s.validation_error").collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_semantic_issues(spark):
    df = spark.createDataFrame([(text(route="deny", slots={}),)], "raw string")
    issues = with_contract(df, "raw", "c", "t", "s").select("s.semantic_issues").first()[0]
    assert [i.issue_category for i in issues] == ["task_route_mismatch", "missing_required_slot"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


TEXTS = [
    "please search the weather in paris", "please search the weather in berlin", "please search the weather in paris", "open the page now",
    "open that page now", "open that page soon", "搜索北京天气", "搜索北京明天天气", "fill the form", "x", "y", "", "open that pages soon",
]


def test_edit_pairs_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string")
    got = {(r.i, r.j) for r in N.edit_pairs(N.distinct_texts(df, "key", "text")).collect()}
    first = {}
    for i, t in enumerate(TEXTS):
        first.setdefault(t, i)
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and _distance(a, b) < 0.3 * max(len(a), len(b))}
    assert got == want and want


def test_greedy_matches_loop(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string")
    got = {r.key for r in N.greedy_kept(df, "key", "text").where("kept").collect()}
    kept = []
    for i, t in enumerate(TEXTS):
        if not any((_distance(t, TEXTS[k]) / max(len(t), len(TEXTS[k]), 1)) < 0.3 for k in kept):
            kept.append(i)
    assert got == set(kept)


def test_split_sizes(spark):
    df = spark.range(0, 2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    rows = stratified_split(df, "s", "id", digits=2).groupBy("s", "split").count().collect()
    got = {(r.s, r.split): r["count"] for r in rows}
    for s, n in (("a", 667), ("b", 1333)):
        assert got[(s, "train")] == int(n * 0.7) and got[(s, "dev")] == int(n * 0.15)
        assert sum(v for k, v in got.items() if k[0] == s) == n


def test_challenge_grid_classes(spark):
    scopes = spark.createDataFrame([("search", "search_web", "query", "topic")], "task_type string, route string, slot_path string, prefix string")
    grid = G.challenge_grid(scopes, 2)
    slots = grid.select(F.lit("a").alias("arm"), F.col("condition").alias("id"), F.col("input_text").alias("source_text"), F.lit("STRING").alias("kind"),
                        F.col("value").alias("text"), F.lit("search:search_web:query").alias("scope_key"), "expected")
    rows = V.verify(slots, V.default_policy(spark)).select("id", "status", "expected").collect()
    assert len(rows) == 12 and all(r.status == r.expected for r in rows)


def test_spans_overlap_and_unicode(spark):
    df = spark.createDataFrame([("aa", "aaaa"), ("ＡＢ１", "see a-b 1!"), ("ß", "STRASSE")], "v string, s string")
    exact = df.select(F.size(V.exact_spans(F.col("v"), F.col("s")))).collect()
    loose = V.with_normalized_spans(df, "found", F.col("v"), F.col("s")).select("found").collect()
    assert [r[0] for r in exact] == [3, 0, 0]
    assert [tuple(x) for x in loose[1][0]] == [(4, 9)] and [tuple(x) for x in loose[2][0]] == [(4, 6)]


def test_bootstrap_is_seeded(spark):
    df = spark.range(0, 200).select(F.lit("dev").alias("split"), (F.col("id") % 4 == 0).cast("int").alias("c_m"), (F.col("id") % 3 == 0).cast("int").alias("t_m"))
    a, b = (P.bootstrap(df, ["m"], 400, 7).first() for _ in range(2))
    assert a == b and a.ci_low < 17 / 200 < a.ci_high and abs(a.mean_delta - 17 / 200) < 0.02


def test_row_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ['{"id":"a","prediction":{"x":1}}', "", '{"id":"a","prediction":{"x":2}}', '{"id":"b","contract":"t"}', '{"id":"c","y":1}', "oops"]
    (folder / "p.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = {r.id: r.raw for r in R.load_predictions(R.read_jsonl(spark, str(folder), fail=False)).collect()}
    assert got == {"a": '{"x":2}', "b": "t", "c": '{"y":1}'}
    assert R.bad_rows(spark, str(folder)).count() == 1


def test_merge_and_clash(spark):
    base = spark.createDataFrame([("s1", "train")], "id string, split string")
    new = spark.createDataFrame([("s2", "dev")], "id string, split string")
    assert G.merge(base, new).count() == 2 and G.clashes(base, base).count() == 1


def test_label_mask(spark):
    from pactlane.operators.curate import target_labels

    df = spark.createDataFrame([([1, 2, 3], [(0, 2), (2, 4), (4, 6)], 2, 6), ([1, 2], [(0, 3), (3, 5)], 2, 5)],
                               "input_ids array<long>, offsets array<struct<start:int,end:int>>, span_start int, span_end int")
    a, b = target_labels(df).collect()
    assert a.labels == [-100, 2, 3] and b.gap == "assistant_span_token_boundary_unavailable"


def test_stream_equals_batch(spark, tmp_path):
    from pactlane.streaming import sidecar as S

    src = tmp_path / "src"
    rows = [("a", "1", 1, "dev", "copy a now", text()), ("a", "2", 2, "dev", "copy", "oops"), ("a", "3", 3, "dev", "", text())]
    df = spark.createDataFrame(rows, S.PREDICTION_SCHEMA)
    df.write.parquet(str(src))
    policy = V.default_policy(spark)
    q = S.start_sidecar_stream(spark.readStream.schema(S.PREDICTION_SCHEMA).parquet(str(src)), policy, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.id, r.hook_status, r.error_code) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.id, r.hook_status, r.error_code) for r in S.outcomes(df, policy).collect()}
    assert got == want and {s for _i, s, _e in got} == {"COMPLETED", "SHADOW_INVALID_INPUT"}


def test_file_and_line_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","prediction":{"v":1}}\n' + '{"id":"y","prediction":{}}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id":"z","prediction":{}}\n' * 3000 + '{"id":"x","prediction":{"v":2}}\n', encoding="utf-8")
    rows = R.read_jsonl(spark, str(tmp_path))
    names = [r.file.rsplit("/", 1)[1] for r in rows.orderBy("ordinal").collect()]
    assert names == sorted(names)
    assert {r.id: r.raw for r in R.load_predictions(rows).collect()}["x"] == '{"v":2}'


def test_stream_keeps_repeated_ids_apart(spark):
    from pactlane.streaming import sidecar as S

    rows = [("a", "1", 1, "dev", "copy a now", text()), ("a", "1", 2, "dev", "copy a now", text()), ("a", "1", 3, "dev", "nothing", text())]
    got = S.outcomes(spark.createDataFrame(rows, S.PREDICTION_SCHEMA), V.default_policy(spark)).collect()
    assert sorted((r.ordinal, r.trusted_count) for r in got) == [(1, 1), (2, 1), (3, 0)]


def test_canonical_numbers(spark):
    from pactlane.functions.text import canonical_number

    cases = {"10000000000": "10000000000", "1" + "0" * 100: "1" + "0" * 100, "007.500": "7.5", "+3.0": "3", "-0.25": "-0.25", "x": None, "1e5": None, " 12 ": "12"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.n for r in df.select("v", canonical_number(F.col("v")).alias("n")).collect()} == cases


def test_cohort_families_by_any_family_key(spark):
    rows = [("1", "train", {"family_id": "a"}), ("2", "train", {"source_family_id": "b"}), ("3", "train", {"family_id": "a"}), ("4", "train", {})]
    got = G.cohort_summary(spark.createDataFrame(rows, "id string, split string, provenance map<string,string>")).first()
    assert (got.seeds, got.families) == (4, 3)


def test_ordered_digest_is_a_tree(spark):
    import hashlib

    from pactlane.operators import holdout as H

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    values = [f"v{k}" for k in range(2500)]
    level = [sha(v + "\n") for v in values]
    for _ in range(H.LEVELS):
        level = [sha(",".join(level[i : i + 1024])) for i in range(0, len(level), 1024)]
    df = spark.createDataFrame([(k * 777, v) for k, v in enumerate(values)], "ordinal long, v string").repartition(5)
    assert tuple(H.ordered_hash(df, "v", "lines").first()) == (2500, level[0])
    assert tuple(H.ordered_hash(df.limit(0), "v").first()) == (0, sha(""))


def test_manifest_rules(spark):
    from pactlane.operators import holdout as H

    rows = spark.createDataFrame([(5, '{"row_id":"a"}'), (9, '{"row_id":"b"}')], "ordinal long, raw string")
    facts = H.freeze_manifest(rows).first()
    hashes = [r.content_hash for r in H.freeze(rows).orderBy("ordinal").collect()]
    good = {"manifest_id": "m", "frozen": True, "row_count": 2, "family_count": facts.family_count, "schema_version": "1", "created_at": "t",
            "provenance_summary": {"a": 1}, "content_hashes": hashes, "lockbox_hash": facts.ordered_hash}

    def failures(**changes):
        raw = json.dumps({k: v for k, v in {**good, **changes}.items() if v is not ...})
        return {r.category for r in H.manifest_failures(rows, spark.createDataFrame([(raw,)], "raw string")).collect()}

    assert failures() == set()
    assert failures(frozen="yes") == {"manifest_not_frozen"}
    assert failures(row_count=3) == {"manifest_count_mismatch"}
    assert failures(family_count=7) == {"manifest_family_count_mismatch"}
    assert failures(schema_version=...) == {"manifest_schema_missing"}
    assert failures(created_at=...) == {"manifest_timestamp_missing"}
    assert failures(provenance_summary={}) == {"manifest_provenance_summary_missing"}
    assert failures(lockbox_hash="0") == failures(content_hashes=hashes[::-1]) == failures(content_hashes=hashes[:1]) == failures(lockbox_hash=...) == {"manifest_hash_mismatch"}
    none = spark.createDataFrame([], "raw string")
    assert [r.category for r in H.manifest_failures(rows, none).collect()] == ["manifest_missing"]


def test_ancestors_at_any_depth(spark):
    from pactlane.functions.canonical import ancestor_ids

    body = ["s", {"id": "i", "derived_from": ["t", {"id": "j", "derived_from": [{"provenance": {"source_id": "p"}}]}], "provenance": {"source_id": "q", "other": "no"}}, 5, ["no"], {"id": ""}]
    df = spark.createDataFrame([(json.dumps(body),), ("{}",)], "v string")
    got = df.select(ancestor_ids("v").alias("a")).collect()
    assert sorted(got[0].a) == ["i", "j", "p", "q", "s", "t"] and got[1].a == []


def test_fixed_policy_is_not_a_join(spark):
    slots = spark.createDataFrame([("a b", "STRING", "a", "search:search_web:query")], "source_text string, kind string, text string, scope_key string")
    plan = V.verify(slots, V.default_policy(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_latency_equals_sorting(spark):
    rng = __import__("random").Random(3)
    values = [rng.choice([1.0, 2.0, 2.5]) if rng.random() < 0.5 else rng.random() * 100 for _ in range(3000)]
    got = V.latency(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v", fences=15).first()
    ranked = sorted(values)
    want = [ranked[round((len(values) - 1) * q)] for q in (0.5, 0.95, 0.99)]
    assert [got.p50, got.p95, got.p99] == want and got.samples == 3000 and got.max == ranked[-1]


def test_leak_scan_reads_each_file_once(spark):
    from pactlane.operators import leakscan as L

    files = spark.createDataFrame(
        [("a/x.log", "ok\nHostName box\n  IdentityFile k"), ("checkpoint-1/m.bin", ""), ("r.jsonl", '{"provenance":{"public_safe":false}}\n\n{"a":1}\n{"b":2}'), ("c.txt", "see /tmp/x and 10.0.0.1\rplain\x0bapi_key: abcdefgh"), ("n.txt", None)],
        "path string, text string",
    )
    got = sorted((r.path, r.line, r.category) for r in L.scan(files, spark.createDataFrame([("a",), ("zz",)], "path string"), max_rows=2).collect())
    assert got == [
        ("a/x.log", 0, "raw_log"), ("a/x.log", 2, "ssh_detail"), ("a/x.log", 3, "ssh_detail"), ("c.txt", 1, "private_ip"), ("c.txt", 1, "private_path"), ("c.txt", 3, "secret"),
        ("checkpoint-1/m.bin", 0, "model_artifact"), ("checkpoint-1/m.bin", 0, "private_artifact_dir"), ("r.jsonl", 0, "oversized_public_corpus"), ("r.jsonl", 1, "raw_private_row"), ("zz", 0, "missing_path"),
    ]
    plan = L.scan(files)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Exchange" not in plan


def test_max_jaccard_is_exact_at_any_level(spark):
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} or {t}
    left = ["abcdefghijkl", "qrstuvwxyz", None, "qrstuvwxyz"]
    sides = {"far": ["abcdMNOPQRSTUVWX", "0123456789uvw", None], "none": ["0123456789"], "near": ["abcdefghijkm", "0123"], "empty": []}
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    for right in sides.values():
        want = max((len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in left if a for b in right if b), default=0.0)
        for pair_hits in (N.PAIR_HITS, 1):
            assert [r.max_jaccard for r in N.max_jaccard(frame(left), frame(right), pair_hits=pair_hits).collect()] == [want]


def test_sequence_pairs_are_cut_in_spark_before_python(spark):
    import difflib
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcd é漢") for _ in range(40)) for _ in range(4)]
    other = [t[:k] + "x" * n + t[k + n :] for t in base for k, n in ((5, 1), (9, 5), (12, 7), (30, 10))] + [t[20:] + t[:20] for t in base]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    out = N.sequence_pairs(frame(base), frame(other))
    ratio = lambda a, b: difflib.SequenceMatcher(a=a, b=b).ratio()
    want = {(str(i), str(j), ratio(a, b)) for i, a in enumerate(base) for j, b in enumerate(other) if ratio(a, b) >= 0.85}
    assert set(map(tuple, out.collect())) == want and want
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert 0 <= plan.find("ArrowEvalPython") < plan.find("levenshtein(")
