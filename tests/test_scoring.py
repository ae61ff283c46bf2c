"""Validation, imputation, scoring, labels and health on small literal tables."""

import pytest
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import labels as L
from deployrisk.functions import scalars as S
from deployrisk.operators import health, impute, joins, labelling, scoring, validation

TYPES = ", ".join(f"{f} int" if f in K.INT_FEATURES else f"{f} double" for f in K.FEATURES)


def build(**given):
    return tuple(given.get(f) for f in K.FEATURES)


def table(spark, rows):
    return spark.createDataFrame(
        [(t, b, ts, *values) for t, b, ts, values in rows], f"tenant_id string, build_id string, timestamp long, {TYPES}")


def test_contract_is_fixed():
    assert K.FEATURES[0] == "diff_size" and K.FEATURES[-1] == "build_time_delta" and len(K.FEATURES) == 10
    assert set(K.TRAINING_MEDIANS) == set(K.FEATURES) == set(K.CONTRACT_LABELS) == set(K.DISPLAY_LABELS)


def test_missing_column_is_refused(spark):
    with pytest.raises(validation.ContractError):
        validation.contract_columns(spark.range(1))


@pytest.mark.parametrize("raw,want", [
    ("12", 12), (" 7.9 ", 7), ("-3", 0), ("NaN", None), ("inf", None), ("", None), ("12abc", None), (None, None)])
def test_clean_counts(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(S.clean_count(F.col("x")).alias("n")).first().n == want


def test_all_null_takes_clock_and_fixed_medians(spark):
    df = table(spark, [("t", "b", 1, build())])
    row = impute.impute_serving(df, impute.tenant_medians(df), F.lit(9), F.lit(3)).first()
    assert (row.hour_of_day, row.day_of_week) == (9, 3)
    assert row.sources["hour_of_day"] == "clock" and row.sources["diff_size"] == "training_median"
    assert row.diff_size == 105 and row.recent_failure_rate == 0.261 and row.imputed == K.FEATURES


def test_minimal_request_names_its_guesses(spark):
    df = table(spark, [("t", "b", 1, build(hour_of_day=14, day_of_week=2, diff_size=120, files_changed=4, is_hotfix=0))])
    row = impute.impute_serving(df, impute.tenant_medians(df), F.lit(0), F.lit(0)).first()
    assert {"recent_failure_rate", "test_pass_rate"} <= set(row.imputed)
    assert row.sources["diff_size"] == "provided"


def test_tenant_median_needs_eight_values(spark):
    rows = [("t", f"b{i}", i, build(diff_size=i, files_changed=i if i < 5 else None)) for i in range(60)]
    row = impute.tenant_medians(table(spark, rows)).first()
    assert row.diff_size_median == 34.5          # the newest fifty are 10..59
    assert row.files_changed_median is None


def test_training_fill_is_never_zero(spark):
    rows = [("t", f"b{i}", i, build(diff_size=v)) for i, v in enumerate([10, 20, None, 41])]
    got = {r.build_id: r for r in impute.impute_training(table(spark, rows)).collect()}
    assert got["b2"].diff_size == 20.0 and got["b0"].diff_size == 10.0
    assert got["b0"].test_pass_rate == 0.819


def test_experience_cannot_be_claimed(spark):
    rows = [("seen", 4, 999), ("modest", 0, 3), ("boaster", 0, 999), ("silent", 0, None)]
    df = spark.createDataFrame(rows, "who string, server_exp long, hint long")
    got = {r.who: (r.deployer_exp, r.exp_source, r.exp_imputed)
           for r in scoring.resolve_experience(df, F.lit(None).cast("double")).collect()}
    assert got["seen"] == (4, "server_history", False)
    assert got["modest"] == (3, "client_hint", False)
    assert got["boaster"] == (27, "training_median", True)
    assert got["silent"] == (27, "training_median", True)


def test_half_even_scores_and_edges(spark):
    df = spark.createDataFrame([(0.005,), (0.015,), (0.40,), (0.41,), (0.70,), (0.71,)], "p double")
    got = [r.v for r in df.select(S.verdict(S.score(F.col("p"))).alias("v")).collect()]
    assert got == ["SAFE", "SAFE", "SAFE", "WARNING", "WARNING", "BLOCKED"]
    assert spark.range(1).select(S.score(F.lit(0.125)).alias("s")).first().s == 12


def test_reasons_rank_rounded_and_say_estimated(spark):
    df = table(spark, [("t", "b", 1, (847, 12, 17, 4, 0.4, 0.85, 0, 10, 3.0, 0.1))])
    weights = F.array(*[F.lit(w) for w in (0.3001, 0.0, 0.0, 0.0, 0.3004, 0.2, 0.0, 0.0, 0.0, 0.0)])
    row = df.select(S.top_reasons(S.rank_features(weights), F.array(F.lit("diff_size"))).alias("r")).first().r
    assert [r.feature for r in row] == ["diff_size", "recent_failure_rate", "test_pass_rate"]
    assert row[0].value_str == "847 lines (very large) — estimated" and row[0].imputed
    assert row[1].value_str == "40% of last 10 builds failed"


@pytest.mark.parametrize("hour,text", [(0, "12:00 AM"), (9, "9:00 AM"), (12, "12:00 PM"), (17, "5:00 PM (end of day)"), (23, "11:00 PM")])
def test_clock_text(spark, hour, text):
    df = table(spark, [("t", "b", 1, build(hour_of_day=hour, day_of_week=4))])
    row = df.select(S.value_texts()["hour_of_day"].alias("h"), S.value_texts()["day_of_week"].alias("d")).first()
    assert row.h == text and row.d == "Friday (risky!)"


@pytest.mark.parametrize("source,name,weight,seen", [
    ("success", "ci_success", 0.6, False), (" FAILURE ", "ci_failure", 0.7, False), ("", "manual", 0.9, False),
    (None, "manual", 0.9, False), ("rollback", "rollback", 1.0, True), ("seed", "synthetic", 1.0, False),
    ("pager", "pager", 0.5, False), ("assumed_ok", "assumed_ok", 0.4, False)])
def test_label_sources(spark, source, name, weight, seen):
    df = spark.createDataFrame([(source,)], "s string").select(
        L.normalise(F.col("s")).alias("n"), L.weight(F.col("s")).alias("w"), L.observed(F.col("s")).alias("o"))
    assert tuple(df.first()) == (name, weight, seen)


SEQUENCES = [
    ([("sentinel_degraded", 1), ("ci_success", 0)], "sentinel_degraded", 1, ["updated", "kept"]),
    ([("sentinel_healthy", 0), ("rollback", 1)], "rollback", 1, ["updated", "updated"]),
    ([("ci_failure", 1)], "ci_failure", 1, ["updated"]),
    ([("ci_success", 0), ("manual", 1)], "manual", 1, ["updated", "updated"]),
]


@pytest.mark.parametrize("events,source,label,statuses", SEQUENCES)
def test_label_precedence(spark, events, source, label, statuses):
    rows = [("b", i, 100 + i, s, v) for i, (s, v) in enumerate(events)]
    schema = "build_id string, seq long, event_ts long, raw_source string, label int"
    for given in (rows, rows[::-1]):             # arrival order of rows must not matter
        described = labelling.described(spark.createDataFrame(given, schema))
        row = labelling.resolve(described).first()
        assert (row.label_source, row.label) == (source, label)
        assert [r.status for r in labelling.status(described).orderBy("seq").collect()] == statuses


def reports(spark, samples, base=None):
    rows = [("d", i, *s) for i, s in enumerate(samples)]
    df = health.with_ok(spark.createDataFrame(rows, "deploy_id string, probe_id long, status int, latency_ms double"))
    known = spark.createDataFrame([("d", base)] if base else [], "deploy_id string, baseline_p50 double")
    return health.evaluate(spark.createDataFrame([("d",)], "deploy_id string"), df, known).first()


@pytest.mark.parametrize("samples,base,verdict,word", [
    ([(200, 40.0), (200, 45.0), (200, 50.0)], 45.0, "HEALTHY", "stayed within"),
    ([(200, 40.0)] * 2 + [(500, 40.0)] * 3, None, "DEGRADED", "error rate 60% exceeds 20%"),
    ([(200, 300.0), (200, 310.0), (301, 290.0)], 100.0, "DEGRADED", "latency p50 300ms is over 2x"),
    ([], None, "DEGRADED", "no samples"),
    ([(200, 40.0)] * 4 + [(None, 40.0)], None, "HEALTHY", "stayed within")])
def test_health(spark, samples, base, verdict, word):
    row = reports(spark, samples, base)
    assert row.verdict == verdict and word in row.reasons[0]


def test_percentile_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 30.0), ("a", 40.0), ("b", None)], "k string, v double")
    got = {r.k: r.p for r in health.percentiles(df, ["k"], "v", {"p": 0.5}).collect()}
    assert got == {"a": 25.0, "b": 0.0}


def test_followup_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [("t" + str(rng.integers(0, 2)), f"b{i}", int(rng.integers(0, 400000)), int(rng.random() < 0.2)) for i in range(300)]
    df = spark.createDataFrame(rows, "tenant_id string, build_id string, timestamp long, fix int")
    got = {r.build_id for r in joins.followed_up(df, df.filter("fix = 1"), 4).collect()}
    want = {a[1] for a in rows if any(b[0] == a[0] and b[3] and a[2] < b[2] <= a[2] + 14400 for b in rows)}
    assert got == want


@pytest.mark.parametrize("verdict,fail_open,code", [("BLOCKED", False, 1), ("BLOCKED", True, 0), ("SAFE", False, 0), (None, False, 0)])
def test_gate_exit_codes(spark, verdict, fail_open, code):
    df = spark.createDataFrame([(verdict, fail_open)], "v string, f boolean")
    assert df.select(S.gate_exit_code(F.col("v"), F.col("f")).alias("c")).first().c == code


def test_outcome_signals(spark):
    rows = [("FAILURE", "main", ""), ("SUCCESS", "fix/x", ""), ("SUCCESS", "main", "Revert it"), ("SUCCESS", "main", "add"), ("FAILURE", "hotfix", "undo")]
    df = spark.createDataFrame(rows, "r string, b string, m string")
    got = [tuple(r.s) for r in df.select(S.detect_label(F.col("r"), F.col("b"), F.col("m")).alias("s")).collect()]
    assert got == [(1, "failure", 1.0), (1, "hotfix_branch", 0.8), (1, "revert_commit", 0.7), (0, "success", 1.0), (1, "failure", 1.0)]


def test_redaction(spark):
    m = F.create_map(F.lit("X-Api_Key"), F.lit("a"), F.lit("name"), F.lit("b"), F.lit("passwd2"), F.lit("c"))
    got = spark.range(1).select(S.redact_map(m).alias("m")).first().m
    assert got == {"X-Api_Key": "[REDACTED]", "name": "b", "passwd2": "[REDACTED]"}
