"""Digest trees, analogues, bootstrap, places, reconciliation and damaged outputs on small fixtures."""

from __future__ import annotations

import json
import random
import statistics

from pyspark.sql import functions as F

from pactlane.operators import analogues as A
from pactlane.operators import compare as P
from pactlane.operators import decode as X
from pactlane.operators import pairing as PI
from pactlane.operators import review as R
from pactlane.sources import rows as S

BUNDLE = "arm string, split string, ordinal long, id string, input_hash string, gold_hash string, output_hash string, parse_status string"


def bundle(spark, rows):
    return spark.createDataFrame(rows, BUNDLE).repartition(3)


def test_first_differences_by_descent(spark):
    rows = [("a", s, k * 700, f"{s}{k}", f"i{k}", f"g{k}", None if k % 5 == 0 else f"o{k}", "valid") for s in ("dev", "test") for k in range(900)]
    other = [list(r) for r in rows]
    other[333][4] = "changed"  # input of dev 333
    other[880][4] = "changed"
    other[500][6] = "was null"  # output
    del other[905]  # test 5 is absent
    other.append(list(rows[1000]))  # test 100 twice
    got = {(r.split, r.kind): (r.ordinal, r.left_ids, r.right_ids) for r in PI.first_differences(PI.tree(bundle(spark, rows), "l"), PI.tree(bundle(spark, [tuple(r) for r in other]), "r")).collect()}
    gone = (5 * 700, "test5", None)
    assert got == {
        ("dev", "input"): (333 * 700, "dev333", "dev333"), ("dev", "output"): (500 * 700, "dev500", "dev500"),
        **{("test", k): gone for k in PI.KINDS},
    }
    same = PI.tree(bundle(spark, rows), "s")
    assert PI.first_differences(same, same).collect() == []
    none = PI.tree(bundle(spark, []), "n")
    assert PI.first_differences(none, none).collect() == []
    assert {r.ordinal for r in PI.first_differences(none, same).collect()} == {0}


def test_descent_reads_a_range_of_leaves(spark):
    t = PI.tree(bundle(spark, [("a", "dev", k, str(k), "i", "g", "o", "valid") for k in range(3000)]), "range")
    plan = PI._below(t.levels[0], {("a", "dev", "id"): 2})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "2048" in plan and "3072" in plan
    assert len(t.levels) == 3


def test_analogues_take_the_finest_rung(spark):
    def row(role, source, *parts, split="dev", tuned=False):
        return (source, split, role, tuned, False, *parts)

    exact = ("search", "web", "r", "confirm:false", "slots:q")
    rows = [row("train", "t1", *exact, tuned=True), row("train", "t2", "search", "web", "r", "confirm:true", "slots:q"), row("train", "t3", "nav", "open", "x", "confirm:false", "slots:u")]
    rows += [row("held_out", "h1", *exact), row("held_out", "h1", *exact), row("held_out", "h2", "search", "web", "r", "confirm:true", "slots:z"), row("held_out", "h3", "nav", "other", "x", "confirm:false", "slots:u"), row("held_out", "h4", "new", "n", "n", "n", "n"), row("other", "o", *exact)]
    df = spark.createDataFrame(rows, "source_id string, split string, role string, tuned boolean, invalid boolean, task_type string, route string, reason string, confirm string, slots string")
    got = {r.source_id: (r.row_count, r.analogue_level, r.train_rows, r.tuning_rows, r.coverage) for r in A.analogues(df).collect()}
    assert got == {
        "h1": (2, "contract_family", 1, 1, "covered"), "h2": (1, "without_slots", 1, 0, "covered_by_coarser_family"),
        "h3": (1, "task_only", 1, 0, "covered_by_coarser_family"), "h4": (1, "none", 0, 0, "absent"),
    }
    plan = A.analogues(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # counts (twice in an adaptive plan at most) and one deal


def test_bootstrap_follows_the_resampling_distribution(spark):
    rng = random.Random(2)
    deltas = [rng.choice([-1.0, 0.0, 0.0, 0.0, 0.5, 1.0]) for _ in range(400)]
    df = spark.createDataFrame([("dev", 0.0, d) for d in deltas], "split string, c_m double, t_m double")
    got = P.bootstrap(df, ["m"], resamples=1500).first()
    means = sorted(statistics.fmean(rng.choices(deltas, k=400)) for _ in range(3000))
    assert abs(got.mean_delta - statistics.fmean(deltas)) < 0.005
    assert abs(got.ci_low - means[75]) < 0.015 and abs(got.ci_high - means[2924]) < 0.015
    one = P.bootstrap(spark.createDataFrame([("dev", 0.0, 0.25)], df.schema), ["m"], resamples=50).first()
    assert (one.mean_delta, one.ci_low, one.ci_high) == (0.25, 0.25, 0.25)


def test_poisson_numbers(spark):
    u, v = P.uniforms(F.col("id").cast("string"))
    draws = spark.range(4000).select(*[P.poisson(F.lit(k), u, v).alias(f"p{k}") for k in (0, 3, 4, 6, 10)])
    out = draws.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in draws.columns for f in (F.avg, F.variance)]).first()
    for k in (0, 3, 4, 6, 10):
        mean = 2.0**k
        assert abs(out[f"avg_p{k}"] - mean) < 4 * (mean / 4000) ** 0.5 and 0.85 < out[f"variance_p{k}"] / mean < 1.15


def test_places_and_reconcile(spark):
    words = [f"w{k:05d}" for k in random.Random(1).sample(range(50_000), 3000)]
    got = [r.w for r in R.places(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), ["w"]).orderBy("place").collect()]
    assert got == sorted(words)
    dims = ["a", "b"]
    rows = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", None)], "a string, b string")
    counts = R.grain_counts(rows, dims)
    assert R.reconcile(counts, dims).collect() == []
    wrong = counts.withColumn("n", F.when(F.expr("level = 1 AND a = 'x'"), 5).otherwise(F.col("n"))).where("NOT (level = 2 AND a = 'y' AND b = 'p')")
    assert {(r.level, r.a, r.own, r.parts) for r in R.reconcile(wrong, dims).collect()} == {(0, None, 4, 7), (1, "x", 5, 2), (1, "y", 2, 1)}


def test_balanced_objects(spark):
    def plain(text):
        at = text.find("{")
        depth, inside, escaped = 0, False, False
        for k in range(at, len(text)) if at >= 0 else ():
            c = text[k]
            if inside:
                inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                inside = True
            else:
                depth += (c == "{") - (c == "}")
                if c == "}" and depth == 0:
                    return text[at : k + 1]
        return None

    rng = random.Random(4)
    texts = ["", "{", "}{", '{"a":"}"} {', '{"a":"\\"}"}x', "漢{é{}}}", '{"\\\\":1}'] + ["".join(rng.choice('{}"\\ aé') for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.o for r in df.select(X.balanced_object(F.col("t")).alias("o")).collect()] == [plain(t) for t in texts]


def test_tree_of_files(spark, tmp_path):
    files = spark.createDataFrame([("a/b.txt", "é".encode()), ("a/c.bin", b"\xff"), (".git/x.txt", b"no"), ("d.jsonl", json.dumps({"k": 1}).encode())], "path string, content binary").repartition(2)
    root = f"file://{tmp_path}/tree"
    S.write_tree(files, root)
    S.write_tree(files, root)  # a task that runs again
    got = {r.path.split("/tree/")[1]: r.text for r in S.read_tree(spark, root).collect()}
    assert got == {"a/b.txt": "é", "d.jsonl": '{"k": 1}'}
