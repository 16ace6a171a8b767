import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.model import HIGH, NOT_APPLICABLE, WEAK
from plumbline.operators import audits, classify, dispose, evaluate
from plumbline.sources.store import temporary

SCHEMA = "table_index int, source_path string, source_kind string, source_confidence string, table_name string, row_i bigint, row_no bigint, col_i int, column string, column_context string, cell string, raw string"


def cells(spark, tables, confidence="raw_table"):
    rows = []
    for ti, (name, columns) in enumerate(tables.items()):
        for c, (column, values) in enumerate(columns.items()):
            rows += [(ti, f"{name}.csv", "table", confidence, name, i, i + 2, c, column, "", f"{chr(65 + c)}{i + 2}", None if v is None else str(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def fixture(spark):
    table = evaluate.fixture_cells(spark)
    findings = dispose.with_order(audits.audit(table)).persist()
    classes = classify.classify_columns(table).persist()
    return findings, classes, dispose.normalize(findings, classes).persist()


GOLDEN = {
    ("foci_last_digit_heap", "last_digit_distribution"): (100, HIGH), ("foci_last_digit_heap", "decimal_tail_regularity"): (3, WEAK), ("foci_last_digit_heap", "duplicate_values"): (33, WEAK),
    ("fluorescence_decimal_tail_heap", "last_digit_distribution"): (100, HIGH), ("fluorescence_decimal_tail_heap", "decimal_tail_regularity"): (100, HIGH), ("fluorescence_decimal_tail_heap", "duplicate_values"): (100, WEAK),
    ("fluorescence_decimal_tail_heap", "arithmetic_or_over_smooth_sequence"): (63.59, WEAK), ("smooth_measurement", "last_digit_distribution"): (100, WEAK), ("smooth_measurement", "decimal_tail_regularity"): (100, HIGH),
    ("smooth_measurement", "arithmetic_or_over_smooth_sequence"): (100, HIGH), ("normal_measurement", "last_digit_distribution"): (11.608, WEAK), ("length_mm", "last_digit_distribution"): (35.928, WEAK),
    ("width_mm", "last_digit_distribution"): (33.096, WEAK), ("volume_mm3", "last_digit_distribution"): (21.457, WEAK), ("volume_mm3", "formula_mismatch"): (65, HIGH), ("sem", "summary_math_inconsistency"): (75, HIGH),
    ("signal_clone_group_a <> signal_clone_group_b", "clone_vector"): (95, HIGH), ("sample_id <> day", "clone_vector"): (95, NOT_APPLICABLE), ("n", "duplicate_values"): (92, NOT_APPLICABLE), ("sem", "duplicate_values"): (91, NOT_APPLICABLE),
    ("start", "arithmetic_or_over_smooth_sequence"): (100, NOT_APPLICABLE),
}


def test_golden_findings(fixture):
    got = {(r.column, r.method): (r.score, r.disposition) for r in fixture[2].collect()}
    for key, (score, tier) in GOLDEN.items():
        assert got[key] == (pytest.approx(score, abs=2e-3), tier), key
    tiers = [t for _, t in got.values()]
    assert (len(got), tiers.count(HIGH), tiers.count(WEAK), tiers.count(NOT_APPLICABLE)) == (33, 8, 9, 16)
    assert not any(c == "normal_measurement" and m != "last_digit_distribution" for c, m in got) and ("sd", "last_digit_distribution") not in got


def test_all_planted_items_are_recovered(spark, fixture):
    results = evaluate.score_oracle(fixture[2], evaluate.fixture_oracle(spark))
    assert {r.status for r in results.collect()} == {"exact"}
    row = evaluate.recovery(results, fixture[2]).first()
    assert row.passed and row.exact_recovery_rate == 1.0 and row.decoy_high_priority_failures == 0


def test_summary_and_ranks(fixture):
    findings, classes, normalized = fixture
    row = dispose.assessment_summary(findings, normalized, classes).first()
    assert row.highest_observed_tier == HIGH and row.source_data_status == "auditable_numeric_data_present" and row.raw_statistical_hit_count == 33
    ranks = [r.normalized_rank for r in normalized.orderBy("normalized_rank").collect()]
    assert ranks == list(range(1, 34))
    ranked = dispose.rank_findings(findings, classes).orderBy("rank").collect()
    assert [r.rank_score for r in ranked] == sorted((r.rank_score for r in ranked), reverse=True)


def test_statuses_of_nothing(spark):
    none = cells(spark, {}) if False else spark.createDataFrame([], SCHEMA)
    findings, classes = dispose.with_order(audits.audit(none)), classify.classify_columns(none)
    row = dispose.assessment_summary(findings, dispose.normalize(findings, classes), classes).first()
    assert row.source_data_status == "missing_auditable_original_data" and row.highest_observed_tier == "none"
    words = cells(spark, {"t": {"a": ["x", "y", None]}})
    classes = classify.classify_columns(words)
    row = dispose.assessment_summary(findings, dispose.normalize(findings, classes), classes).first()
    assert row.source_data_status == "no_statistical_hits" and classes.first().column_type == "too_few_numeric_values"


def test_ties_go_to_the_digit_seen_first_and_to_the_smallest_in_dispositions(spark):
    found = audits.last_digit_distribution(audits.numeric_cells(cells(spark, {"t": {"level": [f"{i}.{'7' if i % 2 else '3'}" for i in range(1, 21)]}}))).first()
    assert '"top_digit":"7"' in found.details


def test_terminal_zeros_of_integers_are_suppressed(spark):
    table = {"t": {"a": [f"{i}.0" for i in range(20)], "b": [f"{i}.10" for i in range(900, 920)]}}
    assert [r.column for r in audits.last_digit_distribution(audits.numeric_cells(cells(spark, table))).collect()] == ["b"]


def test_blanks_are_skipped_in_sequences_and_vectors(spark):
    values = [1.5, 2.25, 3.0, 9.0, 7.5, 1.0, 2.0, 8.5, 9.25]
    table = {"t": {"a": [x for v in values for x in (v, None)], "b": [None, "x", *values], "steps": [x for i in range(9) for x in (i * 2, "")]}}
    numeric = audits.numeric_cells(cells(spark, table))
    assert [r.column for r in audits.clone_vector(numeric).collect()] == ["a <> b"]
    assert "steps" in [r.column for r in audits.arithmetic_sequence(numeric).collect()]


def test_a_long_column_is_ordered_in_parts(spark):
    rng = random.Random(2)
    values = [rng.choice([None, round(rng.random() * 100, 2)]) for _ in range(500)]
    numeric = audits.numeric_cells(cells(spark, {"t": {"a": values}}).repartition(5))
    kept = [v for v in values if v is not None]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r.val, r.before and r.before.val) for r in audits.lagged(numeric).orderBy("row_i").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == list(zip(kept, [None, *kept[:-1]]))


def test_formula_and_summary_quirks(spark):
    bad = {"tumor_length": [1] * 6, "width": [2] * 6, "volume": [50] * 6}
    assert audits.formula_mismatch(cells(spark, {"t": bad})).collect() == []
    good = {"length": [1, 2, 3, "inf", 1], "width": [2, 2, 2, 2, None], "volume": [2, 90, 90, "nan", 7]}
    assert [(r.score, r.n) for r in audits.formula_mismatch(cells(spark, {"t": good})).collect()] == [(60.0, 5)]
    found = audits.summary_math(cells(spark, {"t": {"n": [9, 1, 9], "sd": [3, 3, 3], "sem": [1, 9, 2]}})).first()
    assert found.score == 75.0 and found.severity == "High"
    assert audits.summary_math(cells(spark, {"t": {"n": [9] * 3, "sd": [3] * 3, "mouse": [1, 1, 1], "sem": [5, 5, 5]}})).collect() == []  # the first column that fits is meant


def test_identical_rows(spark):
    found = audits.duplicate_rows(cells(spark, {"t": {"a": [1, 1, 2, 3, 1, None], "b": ["x", "x ", "y", "z", "w", ""]}})).first()
    assert (found.n, found.score, found.column) == (5, 40.0, "__rows__")


def test_severity_of_estimated_data_is_never_high(spark):
    table = {"t": {"a": [f"{i}.7" for i in range(40)]}}
    assert {r.severity for r in audits.last_digit_distribution(audits.numeric_cells(cells(spark, table, "estimated"))).collect()} == {"Medium"}


def test_column_types(spark):
    n = [1.25, 3.5, 2.75, 9.125, 4.5]
    names = {"gene id": "genomic_or_identifier", "p_value": "derived_stat_or_annotation", "day": "design_or_sample_axis", "sd": "summary_statistic", "tumour_volume": "experimental_measurement", "zzz": "numeric_unknown"}
    got = {r.column: r for r in classify.classify_columns(cells(spark, {"t": dict.fromkeys(names, n) | {"few": n[:4] + ["x"], "counted": [3, 4, 5, 6, 7]}})).collect()}
    assert {k: got[k].column_type for k in names} == names
    assert got["few"].column_type == "too_few_numeric_values" and got["counted"].column_type == "design_or_sample_axis"
    assert {r.column_type for r in classify.classify_columns(cells(spark, {"sample data": {"volume": n}})).collect()} == {"design_or_sample_axis"}


def test_three_of_a_kind_are_kept(spark, fixture):
    findings, classes, _ = fixture
    many = findings.where("method = 'formula_mismatch'").crossJoin(spark.range(5)).withColumn("ord", F.col("id").cast("int") + 1).drop("id")
    assert sorted(r.finding_id for r in dispose.normalize(many, classes).collect()) == ["stat-00001", "stat-00002", "stat-00003"]


def test_order_of_rows_and_partitions_does_not_matter(spark, fixture):
    table = evaluate.fixture_cells(spark).orderBy(F.rand(3)).repartition(7)
    got = {(r.column, r.method, r.score, r.details) for r in audits.audit(table).collect()}
    assert got == {(r.column, r.method, r.score, r.details) for r in fixture[0].collect()}


def test_reasons_and_examples(spark):
    """Each finding of the fixture says which rule judged it, why, and shows its examples beside its details."""
    with temporary(spark):
        cells = evaluate.fixture_cells(spark)
        rows = {(r.column, r.method): r for r in dispose.normalize(audits.audit(cells), classify.classify_columns(cells)).collect()}
    assert all(r.disposition_reason and r.disposition_rule for r in rows.values())
    rule = {k: r.disposition_rule for k, r in rows.items()}
    assert rule["foci_last_digit_heap", "last_digit_distribution"] == "heaped_digit" and rule["sem", "summary_math_inconsistency"] == "summary_mismatch"
    assert rule["volume_mm3", "formula_mismatch"] == "exact_mismatch" and rule["smooth_measurement", "arithmetic_or_over_smooth_sequence"] == "regular_steps"
    assert rule["foci_last_digit_heap", "duplicate_values"] == "duplicates_alone" and rule["n", "decimal_tail_regularity"] == "summary_field" and rule["start", "decimal_tail_regularity"] == "excluded_type"
    assert rows["start", "decimal_tail_regularity"].disposition_reason == rows["start", "decimal_tail_regularity"].eligibility_reason
    wrong = rows["volume_mm3", "formula_mismatch"].evidence_examples
    assert [e.row_index for e in wrong] == [11, 21, 31] and all(e.expected_from_formula is not None for e in wrong)
    for r in rows.values():
        said = json.loads(r.details).get("evidence_examples", [])
        assert [e["value"] for e in said if "value" in e] == [e.value for e in r.evidence_examples if e.value is not None] and len(said) == len(r.evidence_examples)
