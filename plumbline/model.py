"""Names, constants and schemas that the stages share."""

from __future__ import annotations

#: Long form of all tables: one row per cell. ``row_i`` orders the rows of a table; ``row_no`` and ``cell`` are what people see.
CELLS = (
    "table_index int, source_path string, source_kind string, source_confidence string, table_name string, "
    "row_i bigint, row_no bigint, col_i int, column string, column_context string, cell string, raw string"
)
#: One row per finding; ``details`` is JSON.
FINDINGS = (
    "table_index int, col_i int, source_path string, source_kind string, source_confidence string, table_name string, column string, method string, "
    "anomaly_family string, severity string, score double, n bigint, summary string, details string"
)
TABLE_KEY = ["table_index", "source_path", "source_kind", "source_confidence", "table_name"]
#: A finding's examples; fields that its method doesn't give are null.
EXAMPLES = (
    "array<struct<row_index bigint, cell string, column string, value string, values array<string>, expected_from_formula double, formula string, expected_sem double, sd double, n double, "
    "nearby_labels map<string,string>>>"
)
COLUMN_KEY = [*TABLE_KEY, "col_i", "column"]

# Names that findings and reports use.
HIGH, WEAK, NOT_APPLICABLE = "high_confidence_fabrication_compatible_anomaly", "weak_anomaly", "not_applicable"
ERROR_TYPES = {
    "last_digit_distribution": "terminal_digit_heaping",
    "decimal_tail_regularity": "decimal_tail_heaping",
    "duplicate_values": "duplicate_value_cluster",
    "duplicate_rows": "duplicate_row_clone",
    "clone_vector": "clone_vector",
    "arithmetic_or_over_smooth_sequence": "arithmetic_smoothness",
    "summary_math_inconsistency": "summary_math_inconsistency",
    "formula_mismatch": "formula_mismatch",
    "benford_first_digit": "benford_misfit",
}
#: Order in which the methods look at a table.
METHOD_ORDER = {
    "duplicate_rows": 0,
    "last_digit_distribution": 1,
    "decimal_tail_regularity": 2,
    "duplicate_values": 3,
    "arithmetic_or_over_smooth_sequence": 4,
    "benford_first_digit": 5,
    "clone_vector": 6,
    "formula_mismatch": 7,
    "summary_math_inconsistency": 8,
}
#: What a reviewer should rule out, by error type.
BENIGN = {
    "terminal_digit_heaping": ["instrument resolution", "rounding policy", "export formatting"],
    "decimal_tail_heaping": ["rounding policy", "fixed precision export", "unit conversion"],
    "duplicate_value_cluster": ["limited resolution", "detection limit", "design replicates"],
    "duplicate_row_clone": ["merged panels", "repeated control rows", "export duplication"],
    "clone_vector": ["shared control group", "column copied for plotting", "alias of one measurement"],
    "arithmetic_smoothness": ["time or dose axis", "interpolated series", "model output"],
    "summary_math_inconsistency": ["rounded summary values", "other n than stated", "confidence interval in place of SEM"],
    "formula_mismatch": ["other volume formula", "rounded inputs", "unit conversion"],
    "benford_misfit": ["bounded range", "assigned numbers", "mixed populations"],
}
BENIGN_FALLBACK = ["rounding", "design axis", "export formatting"]
