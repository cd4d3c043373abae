"""Paired comparison and projection queries over the two arms derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.functions.contract import contract_valid, parse_contract
from pactlane.operators import compare as P
from pactlane.operators import evaluate as E
from pactlane.operators import pairing as PI
from pactlane.operators import projection as V
from pactlane.plans.evaluation_queries import ARMS, contents, counted_layers, gold, layered, paired, parsed_texts, preds, scored
from pactlane.plans.oracle_parts import LAYER, n, with_rows
from pactlane.plans.registry import ORACLE, query
from pactlane.plans.shared import written

RAW = """
ro AS (SELECT arm, id, split, source_id AS family,
 CAST(json_ok AND len(missing) = 0 AND len(extra) = 0 AND list_sort(sf_keys) = ['allow','reason'] AND p_tt = g_tt AND p_rt = g_rt AND t_al = 'BOOLEAN' AND p_al = g_al AND p_re = g_re
  AND t_cf = 'BOOLEAN' AND p_cf = g_cf AND p_sl = g_sl AND p_cm = g_cm AND p_la = g_la AND p_ve = g_ve AS INT) AS exact,
 CAST(json_ok AND p_tt = g_tt AS INT) AS task_type, CAST(json_ok AND p_rt = g_rt AS INT) AS route,
 CAST(json_ok AND (coalesce(p_al, 'true') = 'false') = (g_al = 'false') AS INT) AS safety,
 CAST(json_ok AND t_cf = 'BOOLEAN' AND p_cf = g_cf AS INT) AS confirmation, CAST(json_ok AND p_sl = g_sl AS INT) AS slot FROM scored),
mv AS (SELECT c.split, c.family, o.n AS outcome, CASE WHEN o.c = 1 AND o.t = 1 THEN 'unchanged_success' WHEN o.t = 1 THEN 'recovered' WHEN o.c = 1 THEN 'regressed' ELSE 'persistent_failure' END AS class
 FROM (SELECT a.split, a.family, unnest([{'n': 'exact', 'c': a.exact, 't': b.exact}, {'n': 'task_type', 'c': a.task_type, 't': b.task_type}, {'n': 'route', 'c': a.route, 't': b.route},
  {'n': 'safety', 'c': a.safety, 't': b.safety}, {'n': 'confirmation', 'c': a.confirmation, 't': b.confirmation}, {'n': 'slot', 'c': a.slot, 't': b.slot}]) AS o
  FROM ro a JOIN ro b ON a.id = b.id AND a.arm = 'control' AND b.arm = 'treatment') c)"""


@query(
    "paired_tradeoff",
    with_rows(
        """SELECT s.split, o.outcome, k.class, CAST(count(mv.class) AS BIGINT) AS row_count FROM (SELECT DISTINCT split FROM mv) s CROSS JOIN (SELECT DISTINCT outcome FROM mv) o
CROSS JOIN (SELECT unnest(['unchanged_success','recovered','regressed','persistent_failure']) AS class) k LEFT JOIN mv ON mv.split = s.split AND mv.outcome = o.outcome AND mv.class = k.class GROUP BY ALL""",
        RAW,
    ),
)
def paired_tradeoff(spark, sf_dir):
    """Outcome classes of control against treatment."""
    return P.tradeoff(scored(spark, sf_dir))


@query(
    "tradeoff_families",
    with_rows("SELECT split, outcome, class, family, count(*) AS row_count FROM mv WHERE class IN ('recovered','regressed') GROUP BY ALL", RAW),
)
def tradeoff_families(spark, sf_dir):
    """Families of regressed and recovered rows."""
    return P.tradeoff_families(scored(spark, sf_dir))


def status(spark, sf_dir):
    return written(spark, sf_dir, "status", lambda: P.paired_status(E.row_status(layered(spark, sf_dir))))


STATUS = (
    LAYER
    + """,
nset AS (SELECT side, arm, id, list_distinct(list(k || chr(1) || coalesce(v, ''))) AS s FROM norm GROUP BY ALL),
st AS (SELECT l.arm, l.id, l.ordinal, l.split, g_tt || '|' || g_rt || '|' || g_re || '|confirm:' || g_cf || '|slots:' || list_aggregate(list_sort(json_keys(g_sl)), 'string_agg', ',') AS family,
 CAST(same AS INT) AS exact, CAST(exec_ok AS INT) AS executable, CAST(slots_ok AS INT) AS slot_exact, CAST(risk_ok AS INT) AS safety_correct, CAST(confirm_ok AS INT) AS confirmation_correct,
 CAST(route_ok AS INT) AS route_correct, CAST(task_ok AS INT) AS task_type_correct, f1 AS slot_value_exact_f1 FROM lay2 l),
pr AS (SELECT c.id, c.ordinal, c.split, c.family, c AS c, t AS t FROM st c JOIN st t ON c.id = t.id AND c.arm = 'control' AND t.arm = 'treatment')"""
)


@query(
    "recoveries",
    with_rows(
        """SELECT split, metric, direction, count(*) AS row_count, list_aggregate((list(id ORDER BY ordinal))[1:50], 'string_agg', ',') AS examples FROM (
SELECT split, id, ordinal, m.n AS metric, CASE WHEN m.t = 1 THEN 'recovery' ELSE 'regression' END AS direction FROM (SELECT pr.split, pr.id, pr.ordinal, unnest([
 {'n': 'exact', 'c': c.exact, 't': t.exact}, {'n': 'executable', 'c': c.executable, 't': t.executable}, {'n': 'slot_exact', 'c': c.slot_exact, 't': t.slot_exact},
 {'n': 'safety_correct', 'c': c.safety_correct, 't': t.safety_correct}, {'n': 'confirmation_correct', 'c': c.confirmation_correct, 't': t.confirmation_correct}]) AS m FROM pr) WHERE m.c <> m.t) GROUP BY ALL""",
        STATUS,
    ),
)
def recoveries(spark, sf_dir):
    """Recoveries and regressions per metric with 50 examples."""
    return P.recoveries(status(spark, sf_dir))


@query(
    "family_deltas",
    with_rows(
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY movement DESC, row_count DESC, family) AS rank FROM (
SELECT *, round(abs(slot_value_exact_f1_delta) + abs(executable_delta), 9) AS movement FROM (SELECT split, family, count(*) AS row_count,
 round(avg(t.exact) - avg(c.exact), 9) AS exact_delta, round(avg(t.executable) - avg(c.executable), 9) AS executable_delta, round(avg(t.slot_exact) - avg(c.slot_exact), 9) AS slot_exact_delta,
 round(avg(t.slot_value_exact_f1) - avg(c.slot_value_exact_f1), 9) AS slot_value_exact_f1_delta, round(avg(t.route_correct) - avg(c.route_correct), 9) AS route_correct_delta,
 round(avg(t.task_type_correct) - avg(c.task_type_correct), 9) AS task_type_correct_delta FROM pr GROUP BY split, family))) WHERE rank <= 12""",
        STATUS,
    ),
)
def family_deltas(spark, sf_dir):
    """Family-level deltas by absolute movement."""
    return P.family_deltas(status(spark, sf_dir), ["split"])


def all_metrics(spark, sf_dir):
    """Every strict and layered metric; names that both evaluators use carry ``layered_`` for the second."""
    keys = ["arm", "split"]
    strict = E.tidy(E.strict_metrics(scored(spark, sf_dir), keys), keys, E.METRIC_COLUMNS)
    lay = E.layered_metrics(counted_layers(spark, sf_dir, keys), keys)
    again = {c: f"layered_{c}" for c in E.LAYERED_COLUMNS if c in E.METRIC_COLUMNS}
    lay = lay.withColumnsRenamed(again)
    return strict.unionByName(E.tidy(lay, keys, [again.get(c, c) for c in E.LAYERED_COLUMNS]))


def deltas(spark, sf_dir):
    return P.metric_deltas(all_metrics(spark, sf_dir))


def _tall(sql: str, columns, taken=()) -> str:
    """(arm, split, metric, value) of a wide metrics query."""
    pairs = ", ".join(f"{{'n': '{'layered_' if c in taken else ''}{c}', 'v': CAST({c} AS DOUBLE)}}" for c in columns)
    return f"SELECT arm, split, m.n AS metric, m.v AS value FROM (SELECT arm, split, unnest([{pairs}]) AS m FROM ({sql}))"


DELTA_SQL = f"""
tall AS ({_tall(ORACLE["strict_metrics"], E.METRIC_COLUMNS)} UNION ALL {_tall(ORACLE["layered_metrics"], E.LAYERED_COLUMNS, E.METRIC_COLUMNS)}),
dl AS (SELECT split, metric, max(value) FILTER (WHERE arm = 'control') AS control, max(value) FILTER (WHERE arm = 'treatment') AS treatment,
 max(value) FILTER (WHERE arm = 'treatment') - max(value) FILTER (WHERE arm = 'control') AS delta FROM tall GROUP BY ALL)"""


@query("metric_deltas", f"WITH {DELTA_SQL} SELECT * FROM dl")
def metric_deltas(spark, sf_dir):
    """Deltas of every metric between arms."""
    return deltas(spark, sf_dir)


_GATE = " ".join(f"WHEN metric = '{m}' THEN d {op} {limit}::DOUBLE" for m, op, limit in P.GATE)
_GUARDS = ", ".join(f"'{m}'" for m, _o, _l in P.GATE[2:])
_FIRST = ", ".join(f"'{m}'" for m in P.PRIMARY)


@query(
    "decision_gate",
    f"""WITH {DELTA_SQL}, g AS (SELECT metric, coalesce(delta, 0) AS d FROM dl WHERE split IN ('dev', 'test')), t AS (SELECT metric, d, CASE {_GATE} ELSE true END AS holds FROM g),
a AS (SELECT bool_and(metric NOT IN ({_GUARDS}) OR holds) AS gp, bool_and(metric NOT IN ({_FIRST}) OR d >= 0) AS pn, bool_and(holds) AS every,
 bool_or(metric IN ('slot_value_exact_f1', 'executable_contract_pass_rate') AND d > 0) AS gain FROM t)
SELECT CASE WHEN NOT gp OR NOT pn THEN 'REGRESSION_OR_GUARDRAIL_FAILURE' WHEN every THEN 'PASS_STEP_MATCHED_PILOT' WHEN gain THEN 'POSITIVE_BUT_INCONCLUSIVE'
 ELSE 'NO_CANONICAL_DATA_SIGNAL' END AS decision_label, gp AND pn AND every AS passed, gp AS guardrails_pass, pn AS primary_non_regressed FROM a""",
)
def decision_gate(spark, sf_dir):
    """Gate label from the deltas."""
    return P.gate(deltas(spark, sf_dir))


_TABLES = ", ".join(f"'{[float(p) for p in P.poisson_table(2.0**k)]}'::DOUBLE[]" for k in range(P.EXACT_BITS))
_HALF = "(('0x' || substr(md5(concat_ws('|', 7170, split, metric, draw, k, bit)), {at}, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"
BOOT_SQL = (
    STATUS
    + f""",
nf AS (SELECT l.arm, l.id, l.split, CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN g.s IS NULL AND p.s IS NULL THEN 1.0::DOUBLE WHEN g.s IS NULL OR p.s IS NULL THEN 0.0::DOUBLE
 ELSE 2.0::DOUBLE * len(list_intersect(g.s, p.s)) / (len(g.s) + len(p.s)) END AS f FROM lay2 l
 LEFT JOIN nset g ON g.side = 'g' AND g.arm = l.arm AND g.id = l.id LEFT JOIN nset p ON p.side = 'p' AND p.arm = l.arm AND p.id = l.id),
df AS (SELECT split, m.n AS metric, round(m.d, 12) AS delta FROM (SELECT pr.split, unnest([{{'n': 'exact', 'd': (t.exact - c.exact)::DOUBLE}}, {{'n': 'executable', 'd': (t.executable - c.executable)::DOUBLE}},
 {{'n': 'slot_value_exact_f1', 'd': t.slot_value_exact_f1 - c.slot_value_exact_f1}}]) AS m FROM pr)
 UNION ALL SELECT a.split, 'slot_value_normalized_f1', round(b.f - a.f, 12) FROM nf a JOIN nf b ON a.id = b.id AND a.arm = 'control' AND b.arm = 'treatment'),
hs AS (SELECT *, row_number() OVER (PARTITION BY split, metric ORDER BY delta) AS k FROM (SELECT split, metric, delta, count(*) AS n FROM df GROUP BY ALL)),
dr AS (SELECT * FROM (SELECT split, metric, delta, n, k, unnest(range(2000)) AS draw FROM hs)),
db AS (SELECT split, metric, delta, draw, k, bit FROM (SELECT *, unnest(range(41)) AS bit FROM dr) WHERE (n >> bit) & 1 = 1),
un AS (SELECT *, {_HALF.format(at=1)} AS u, {_HALF.format(at=13)} AS v FROM db),
wt AS (SELECT split, metric, draw, delta, CASE WHEN bit < {P.EXACT_BITS} THEN len(list_filter(([{_TABLES}])[bit + 1], lambda x: x <= u))
 ELSE greatest(floor(pow(2.0::DOUBLE, bit) + sqrt(pow(2.0::DOUBLE, bit)) * z + (z * z - 1) / 6 + 0.5), 0) END::BIGINT AS w FROM (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM un)),
mean AS (SELECT split, metric, draw, round(CASE WHEN sum(w) > 0 THEN sum(w * delta) / sum(w) ELSE any_value(plain) END, 9) AS m FROM wt
 JOIN (SELECT split, metric, sum(delta * n) / sum(n) AS plain FROM hs GROUP BY ALL) USING (split, metric) GROUP BY split, metric, draw)"""
)


@query(
    "bootstrap_ci",
    with_rows("SELECT split, metric, round(avg(m), 9) AS mean_delta, list_sort(list(m))[51] AS ci_low, list_sort(list(m))[1950] AS ci_high FROM mean GROUP BY split, metric", BOOT_SQL),
)
def bootstrap_ci(spark, sf_dir):
    """Seeded paired bootstrap intervals."""
    return P.bootstrap(status(spark, sf_dir), ["exact", "executable", "slot_value_exact_f1", "slot_value_normalized_f1"])


@query("metric_reproduction")
def metric_reproduction(spark, sf_dir):
    """Metrics recomputed after a round trip through the core; no row means every metric agrees."""
    before = E.tidy(E.strict_metrics(scored(spark, sf_dir), ["arm", "split"]), ["arm", "split"], E.METRIC_COLUMNS)
    given, df = preds(spark, sf_dir), parsed_texts(spark, sf_dir)
    again = df.select(F.col("text").alias("raw"), F.when(F.col("schema_valid"), V.render_contract(F.col("c"), V.slot_json(F.col("c")))).otherwise(F.col("text")).alias("again"))
    again = given.join(again, "raw").select("arm", "id", "ordinal", F.col("again").alias("raw"))
    after = E.tidy(E.strict_metrics(E.scored_once(gold(spark, sf_dir), again, ARMS), ["arm", "split"]), ["arm", "split"], E.METRIC_COLUMNS)
    return P.reproduction(after, before)


@query(
    "safety_regression",
    with_rows(
        """SELECT classification, d.n AS dimension, d.v AS value, count(*) AS row_count FROM (SELECT classification, unnest([{'n': 'split', 'v': split}, {'n': 'family', 'v': source_id},
 {'n': 'task_type', 'v': g_tt}, {'n': 'route', 'v': g_rt}]) AS d FROM (SELECT a.split, a.source_id, a.g_tt, a.g_rt, CASE WHEN a.g_al = 'true' THEN 'unchanged_non_stop'
 WHEN a.s_tp AND b.s_tp THEN 'stable_correct' WHEN b.s_tp THEN 'recovered' WHEN a.s_tp THEN 'regressed' ELSE 'persistent_miss' END AS classification
 FROM scored a JOIN scored b ON a.id = b.id AND a.arm = 'control' AND b.arm = 'treatment')) GROUP BY ALL"""
    ),
)
def safety_regression(spark, sf_dir):
    """Paired safety classification by split, family, task and route."""
    return P.safety_regression(scored(spark, sf_dir))


@query(
    "confirmation_regressions",
    with_rows(
        """SELECT a.split, a.g_tt || '|' || a.g_rt || '|confirm:' || a.g_cf AS family, count(*) AS row_count FROM scored a JOIN scored b ON a.id = b.id AND a.arm = 'control' AND b.arm = 'treatment'
WHERE a.json_ok AND b.json_ok AND coalesce(a.t_cf = 'BOOLEAN' AND a.p_cf = a.g_cf, false) AND NOT coalesce(b.t_cf = 'BOOLEAN' AND b.p_cf = b.g_cf, false) GROUP BY ALL"""
    ),
)
def confirmation_regressions(spark, sf_dir):
    """Confirmation regressions by family."""
    return P.confirmation_regressions(scored(spark, sf_dir))


@query(
    "paired_boundary",
    with_rows(
        """SELECT split, gold_rows, control_rows, treatment_rows, CAST(0 AS BIGINT) AS duplicate_gold_ids, CAST(0 AS BIGINT) AS control_duplicate_ids, CAST(0 AS BIGINT) AS treatment_duplicate_ids,
 gold_rows - control_rows AS control_missing_ids, gold_rows - treatment_rows AS treatment_missing_ids, CAST(0 AS BIGINT) AS control_extra_ids, CAST(0 AS BIGINT) AS treatment_extra_ids,
 'control_gold_id_mismatch,control_row_count_mismatch,treatment_gold_id_mismatch,treatment_row_count_mismatch' AS blocking_reasons
FROM (SELECT split, CAST(count(*) / 2 AS BIGINT) AS gold_rows, count(raw) FILTER (WHERE arm = 'control') AS control_rows, count(raw) FILTER (WHERE arm = 'treatment') AS treatment_rows FROM scored GROUP BY split)"""
    ),
)
def paired_boundary(spark, sf_dir):
    """Id agreement of gold and both arms with blocking reasons."""
    return P.boundary(gold(spark, sf_dir), preds(spark, sf_dir), ARMS)


@query("missing_predictions", with_rows("SELECT arm, id FROM scored WHERE raw IS NULL"))
def missing_predictions(spark, sf_dir):
    """Gold ids without a prediction."""
    g, p = gold(spark, sf_dir), preds(spark, sf_dir)
    one = lambda a: P.missing_predictions(g, p.where(F.col("arm") == a)).select(F.lit(a).alias("arm"), "id")
    return one("control").unionByName(one("treatment"))


# ---- projection ------------------------------------------------------------------------


def recs(spark, sf_dir):
    return written(spark, sf_dir, "projection", lambda: V.records(layered(spark, sf_dir)))


PROJ = (
    LAYER
    + """,
pj AS (SELECT arm, id, split, ok, g_tt, CAST(same AS INT) AS l0, coalesce(CAST(ok AND p_tt = g_tt AND p_rt = g_rt AND p_al = g_al AND p_re = g_re AND p_cf = g_cf AND p_sl = g_sl AS INT), 0) AS l1,
 core_same AND cov AS ex1, coalesce(core_same AND cov AND p_re = g_re, false) AS ex2,
 coalesce(ok AND p_sl <> g_sl, false) AS ds, coalesce(ok AND (p_tt <> g_tt OR p_rt <> g_rt), false) AS dr, coalesce(ok AND p_tt <> g_tt AND p_rt <> g_rt, false) AS db,
 coalesce(ok AND (p_al <> g_al OR p_re <> g_re OR p_cf <> g_cf), false) AS df, coalesce(ok AND p_cm <> g_cm, false) AS dc,
 CASE WHEN NOT ok THEN 'invalid_or_unparseable' WHEN p_rt <> r_rt THEN 'unsupported_task_route'
  WHEN p_tt IN ('search','navigate','extract','form_fill') AND NOT list_contains(json_keys(p_sl), r_slot) THEN 'missing_' || r_slot || '_slot' ELSE 'supported' END AS reason FROM lay2),
pc AS (SELECT *, CASE WHEN NOT ok THEN 'INVALID_OR_UNPARSEABLE' WHEN NOT ds AND NOT dr AND NOT df AND dc THEN 'NORMALIZED_COMMAND_ONLY' WHEN db AND NOT df THEN 'CORE_ROUTE_TASK_FAILURE'
  WHEN ds AND NOT dr AND NOT df THEN 'CORE_SLOT_FAILURE' WHEN dr AND NOT ds AND NOT df THEN 'CORE_ROUTE_TASK_FAILURE' WHEN df AND NOT ds AND NOT dr THEN 'CORE_SAFETY_CONFIRMATION_FAILURE' ELSE 'MIXED_CORE_FAILURE' END AS category FROM pj)"""
)


@query(
    "projection_metrics",
    with_rows(
        """SELECT *, round(l1_exact_rate - l0_exact_rate, 9) AS l1_minus_l0, round(l2_exact_rate - l0_exact_rate, 9) AS l2_minus_l0, round(l2_exact_rate - l1_exact_rate, 9) AS l2_minus_l1,
 round(v2_executable_rate - v1_executable_rate, 9) AS v2_minus_v1_executable FROM (SELECT arm, split, count(*) AS row_count, sum(l0) / count(*)::DOUBLE AS l0_exact_rate, sum(l1) / count(*)::DOUBLE AS l1_exact_rate,
 sum(l1) / count(*)::DOUBLE AS l2_exact_rate, count(*) FILTER (WHERE ok) / count(*)::DOUBLE AS v2_schema_validity, count(*) FILTER (WHERE ex1) / count(*)::DOUBLE AS v1_executable_rate,
 count(*) FILTER (WHERE ex2) / count(*)::DOUBLE AS v2_executable_rate, count(*) FILTER (WHERE reason = 'supported') / count(*)::DOUBLE AS renderer_supported_rate FROM pc GROUP BY arm, split)""",
        PROJ,
    ),
)
def projection_metrics(spark, sf_dir):
    """Exact and executable rates at the three levels."""
    return V.metrics(recs(spark, sf_dir), ["arm", "split"])


@query(
    "failure_contribution",
    with_rows(
        """, c AS (SELECT arm, split, category, count(*) AS failures, CAST(sum(l1) AS BIGINT) AS eliminated FROM pc WHERE l0 = 0 GROUP BY ALL
 UNION ALL SELECT 'all', 'all', category, count(*), CAST(sum(l1) AS BIGINT) FROM pc WHERE l0 = 0 GROUP BY category)
SELECT *, failures / (sum(failures) OVER (PARTITION BY arm, split))::DOUBLE AS share FROM c""",
        PROJ,
    ).replace("\n, c AS", ", c AS"),
)
def failure_contribution(spark, sf_dir):
    """Failure classes with shares."""
    return V.failure_contribution(recs(spark, sf_dir))


@query(
    "renderer_coverage",
    with_rows(
        "SELECT arm, reason AS renderer_reason, count(*) AS row_count, CAST(count(*) FILTER (WHERE reason = 'supported') AS BIGINT) AS supported FROM pc GROUP BY ALL",
        PROJ,
    ),
)
def renderer_coverage(spark, sf_dir):
    """Renderer support and reasons."""
    return V.renderer_coverage(recs(spark, sf_dir))


@query(
    "compatibility",
    with_rows(
        """SELECT arm AS source_kind, count(*) AS contracts, r AS v1_valid_rate, r AS roundtrip_exact_rate, r AS safety_preserved_rate, r AS confirmation_preserved_rate, r AS slots_preserved_rate,
 r AS command_preserved_rate, r AS language_preserved_rate, r AS version_preserved_rate, any_value(s) AS display_supported_rate FROM (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY arm) / (count(*) OVER (PARTITION BY arm))::DOUBLE AS r,
 count(*) FILTER (WHERE reason = 'supported') OVER (PARTITION BY arm) / (count(*) OVER (PARTITION BY arm))::DOUBLE AS s FROM pc WHERE (arm, id) IN (SELECT (arm, id) FROM predictions)) GROUP BY arm, r""",
        PROJ,
    ),
)
def compatibility(spark, sf_dir):
    """Round trip through the core per source kind."""
    df = contract_valid(parse_contract(preds(spark, sf_dir), "raw", "c"), "c").withColumn("source_kind", F.col("arm"))
    return V.compatibility(V.round_trip(df))


# ---- paired inputs -----------------------------------------------------------------------


def bundle(spark, sf_dir):
    """The assembled rows with their hashes; no query reads the texts beside them."""
    build = lambda: PI.assemble_once(paired(spark, sf_dir), contents(spark, sf_dir)).drop("input_text", "gold", "raw")
    return written(spark, sf_dir, "paired_inputs", build)


CANONICAL_GOLD = """'{"confirmation_required":' || g_cf || ',"contract_version":"' || g_ve || '","language":"' || g_la || '","normalized_command":"' || g_cm || '","route":"' || g_rt
 || '","safety":{"allow":' || g_al || ',"reason":"' || g_re || '"},"slots":' || g_sl || ',"task_type":"' || g_tt || '"}'"""
PAIRED = f"""pi AS (SELECT arm, id, ordinal, split, sha256(input_text) AS input_hash, sha256({CANONICAL_GOLD}) AS gold_hash, sha256(raw) AS output_hash,
 CASE WHEN raw IS NULL THEN 'absent' WHEN ok THEN 'valid' ELSE 'invalid' END AS parse_status FROM scored)"""


@query("paired_inputs", with_rows("SELECT arm, id, ordinal, split, input_hash, gold_hash, output_hash, parse_status FROM pi", PAIRED))
def paired_inputs(spark, sf_dir):
    """Gold and arms assembled with hashes of input, gold and output and the parse status."""
    return bundle(spark, sf_dir).select("arm", "id", "ordinal", "split", "input_hash", "gold_hash", "output_hash", "parse_status")


# A second copy of the bundle with faults, in words that Spark and the checking SQL share.
FAULTS = {
    "input_hash": "CASE WHEN arm = 'treatment' AND ordinal % 1013 = 17 THEN sha2(id, 256) ELSE input_hash END",
    "gold_hash": "CASE WHEN split <> 'test' AND ordinal % 1511 = 805 THEN sha2(id, 256) ELSE gold_hash END",
    "output_hash": "CASE WHEN arm = 'control' AND ordinal % 997 = 996 THEN NULL ELSE output_hash END",
    "id": "CASE WHEN arm = 'control' AND split = 'dev' AND ordinal % 2003 = 1 + 5 THEN id || '-other' ELSE id END",
}
ABSENT, TWICE = "arm = 'treatment' AND split = 'dev' AND ordinal % 3001 = 1206", "arm = 'treatment' AND split = 'train' AND ordinal % 1709 = 1204"
FAULTY = f"""fb AS (SELECT arm, split, ordinal, {", ".join(f"{sql.replace('sha2(id, 256)', 'sha256(id)')} AS {name}" for name, sql in FAULTS.items())}, parse_status, unnest(range(CASE WHEN {TWICE} THEN 2 ELSE 1 END)) AS time
 FROM pi WHERE NOT ({ABSENT}))"""


def faulty_bundle(spark, sf_dir):
    df = bundle(spark, sf_dir).where(f"NOT ({ABSENT})").selectExpr("arm", "split", "ordinal", "parse_status", *[f"{sql} AS {name}" for name, sql in FAULTS.items()], f"explode(sequence(1, CASE WHEN {TWICE} THEN 2 ELSE 1 END)) AS time")
    return df.drop("time")


@query(
    "first_differences",
    with_rows(
        """, bt AS (SELECT coalesce(a.arm, b.arm) AS arm, coalesce(a.split, b.split) AS split, coalesce(a.ordinal, b.ordinal) AS ordinal, a.ids AS left_ids, b.ids AS right_ids, a.n IS DISTINCT FROM b.n AS rows_differ,
 a.ids IS DISTINCT FROM b.ids AS id, a.i IS DISTINCT FROM b.i AS input, a.g IS DISTINCT FROM b.g AS gold, a.o IS DISTINCT FROM b.o AS output FROM
 (SELECT arm, split, ordinal, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, min(input_hash) AS i, min(gold_hash) AS g, min(output_hash) AS o FROM pi GROUP BY ALL) a FULL JOIN
 (SELECT arm, split, ordinal, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, min(input_hash) AS i, min(gold_hash) AS g, min(output_hash) AS o FROM fb GROUP BY ALL) b USING (arm, split, ordinal)),
k AS (SELECT arm, split, ordinal, left_ids, right_ids, unnest([{'k': 'id', 'd': id OR rows_differ}, {'k': 'input', 'd': input OR rows_differ}, {'k': 'gold', 'd': gold OR rows_differ}, {'k': 'output', 'd': output OR rows_differ}]) AS f FROM bt)
SELECT arm, split, f.k AS kind, min(ordinal) AS ordinal, arg_min_null(left_ids, ordinal) AS left_ids, arg_min_null(right_ids, ordinal) AS right_ids FROM k WHERE f.d GROUP BY ALL""",
        f"{PAIRED}, {FAULTY}",
    ).replace("\n, bt", ", bt"),
)
def first_differences(spark, sf_dir):
    """First difference of ids, inputs, gold and outputs between two bundles, by descent through digest trees."""
    return PI.first_differences(PI.tree(bundle(spark, sf_dir), "bundle"), PI.tree(faulty_bundle(spark, sf_dir), "faulty"))


@query(
    "paired_input_boundary",
    with_rows(
        """, gr AS (SELECT split, count(*) AS n FROM pi WHERE arm = 'control' GROUP BY split),
j AS (SELECT coalesce(b.arm, g.arm) AS arm, coalesce(b.split, g.split) AS split, b.id AS bid, g.id AS gid, b.input_hash IS NOT DISTINCT FROM g.input_hash AS i, b.gold_hash IS NOT DISTINCT FROM g.gold_hash AS q, b.parse_status AS st,
 count(b.id) OVER (PARTITION BY b.arm, b.split, b.id) AS times FROM fb b FULL JOIN pi g ON g.arm = b.arm AND g.split = b.split AND g.id = b.id),
a AS (SELECT arm, split, count(bid) AS row_count, count(DISTINCT bid) FILTER (WHERE times > 1) AS repeated_ids, count(*) FILTER (WHERE st = 'valid') AS valid_outputs, count(*) FILTER (WHERE st = 'invalid') AS invalid_outputs,
 count(*) FILTER (WHERE st = 'absent') AS absent_outputs, bool_and(bid IS NOT NULL AND gid IS NOT NULL AND times = 1) AS ids_match, bool_and(i AND bid IS NOT NULL AND gid IS NOT NULL AND times = 1) AS inputs_match,
 bool_and(q AND bid IS NOT NULL AND gid IS NOT NULL AND times = 1) AS gold_match FROM j GROUP BY ALL)
SELECT a.*, concat_ws(',', CASE WHEN row_count <> n THEN 'row_count_mismatch' END, CASE WHEN repeated_ids > 0 THEN 'repeated_ids' END, CASE WHEN NOT ids_match THEN 'id_mismatch' END, CASE WHEN NOT inputs_match THEN 'input_mismatch' END,
 CASE WHEN NOT gold_match THEN 'gold_mismatch' END, CASE WHEN NOT gold_match THEN 'ordered_hash_mismatch' END) AS blocking_reasons FROM a JOIN gr USING (split)""",
        f"{PAIRED}, {FAULTY}",
    ).replace("\n, gr", ", gr"),
)
def paired_input_boundary(spark, sf_dir):
    """Whether each arm's inputs belong to the gold rows, with blocking reasons."""
    return PI.boundary(gold(spark, sf_dir), faulty_bundle(spark, sf_dir))
