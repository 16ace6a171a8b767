"""DuckDB SQL for the results of the screening queries, written from the screens' definitions."""

from __future__ import annotations

from plumbline.operators import classify as C
from plumbline.operators.headers import HINTS
from plumbline.plans.star import LINEITEM_ORDER, MELTS


def _printed(name: str, mode: str) -> str:
    if mode == "text":
        return f"CAST({name} AS VARCHAR)"
    if mode == "whole":
        return f"CAST(CAST({name} AS BIGINT) AS VARCHAR)"
    fixed = f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)"
    return fixed if mode == "fixed" else f"regexp_replace(regexp_replace({fixed}, '0+$', ''), '\\.$', '')"


def _cells(melts: list[tuple[str, int, str, str, dict[str, str], str]]) -> str:
    """CTE cells: melts are (relation, index, name, order, columns, context)."""
    parts = [
        f"SELECT {index} AS ti, '{name}' AS table_name, {i} AS col_i, '{c}' AS column_name, '{context}' AS context, CAST({order} AS BIGINT) AS row_i, {_printed(c, mode)} AS raw FROM {relation}"
        for relation, index, name, order, columns, context in melts
        for i, (c, mode) in enumerate(columns.items())
    ]
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


_NUMBERS = """,
num0 AS (SELECT *, CAST(raw AS DOUBLE) AS val, right(raw, 1) AS last_digit, rpad(substr(split_part(raw, '.', 2), 1, 2), 2, '0') AS tail,
  length(split_part(raw, '.', 2)) AS places, regexp_extract(raw, '[1-9]') AS fd, regexp_full_match(raw, '[-+]?\\d+(\\.0+)?') AS intlike FROM cells WHERE raw IS NOT NULL),
num AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ti, col_i) AS nn FROM num0) WHERE nn >= 5)"""
_STAR = "WITH " + _cells([(m.table, m.index, m.table, m.order, m.columns, m.context) for m in MELTS]) + _NUMBERS
_KEY = "ti, col_i, table_name, column_name"


def _erfc(x: str) -> str:
    t = f"(1e0/(1e0+0.5e0*abs({x})))"
    fit = "0.17087277e0"
    for c in ("-0.82215223e0", "1.48851587e0", "-1.13520398e0", "0.27886807e0", "-0.18628806e0", "0.09678418e0", "0.37409196e0", "1.00002368e0", "-1.26551223e0"):
        fit = f"({c}+{t}*{fit})"
    y = f"{t}*exp(-({x})*({x})+{fit})"
    return f"CASE WHEN {x} >= 0 THEN {y} ELSE 2e0-{y} END"


def _p(chi2: str, df: int) -> str:
    k = f"(2e0/(9e0*{df}))"
    z = f"((pow({chi2}/{df}e0, 1e0/3e0) - (1e0-{k}))/sqrt({k})/sqrt(2e0))"
    return f"(0.5e0*({_erfc(z)}))"


def _severity(score: str = "score0", n: str = "n") -> str:
    return f"CASE WHEN {n} < 10 THEN 'Low' WHEN {score} >= 80 THEN 'High' WHEN {score} >= 45 THEN 'Medium' ELSE 'Low' END"


_LAST = f""",
ld AS (SELECT {_KEY}, last_digit, count(*) c, min(row_i) f, sum(CASE WHEN intlike THEN 1 ELSE 0 END) ints FROM num GROUP BY ALL),
ls AS (SELECT {_KEY}, CAST(sum(c) AS DOUBLE) n, CAST(sum(c*c) AS DOUBLE) sq, max(c) top, list(last_digit ORDER BY c DESC, f)[1] top_digit, list(last_digit ORDER BY c DESC, last_digit)[1] low_digit, count(*) kinds, sum(ints) ints FROM ld GROUP BY ALL HAVING sum(c) >= 10),
lc AS (SELECT *, greatest(10e0*sq/n-n, 0e0) chi2, top/n share FROM ls),
lp AS (SELECT *, {_p("chi2", 9)} p FROM lc),
a1 AS (SELECT *, least(100e0, -10e0*log10(greatest(p, 1e-12)) + greatest(0e0, share-0.25e0)*120 + 4*(10-kinds)) score0 FROM lp
  WHERE (p < 0.01 OR share >= 0.35 OR (n >= 30 AND kinds < 10)) AND NOT (top_digit = '0' AND share >= 0.95 AND ints >= 0.9*n))"""
_TAIL = f""",
td AS (SELECT {_KEY}, tail, count(*) c, min(row_i) f FROM num GROUP BY ALL),
ts AS (SELECT {_KEY}, CAST(sum(c) AS DOUBLE) n, max(c) top, list(tail ORDER BY c DESC, f)[1] top_tail, sum(CASE WHEN tail IN ('00','50','05') THEN c ELSE 0 END) tidy, count(*) tails FROM td GROUP BY ALL HAVING sum(c) >= 10),
tp AS (SELECT ti, col_i, max(c) same FROM (SELECT ti, col_i, places, count(*) c FROM num GROUP BY ALL) GROUP BY ALL),
a2 AS (SELECT *, least(100e0, greatest(0e0, top/n-0.2e0)*140 + greatest(0e0, tidy/n-0.35e0)*100 + greatest(0e0, same/n-0.9e0)*30) score0 FROM ts JOIN tp USING (ti, col_i)
  WHERE top/n >= 0.35 OR tidy/n >= 0.55 OR (n >= 30 AND same/n >= 0.98))"""
_DUPLICATE = f""",
dg AS (SELECT {_KEY}, round(val, 10) v, count(*) c FROM num GROUP BY ALL),
ds AS (SELECT {_KEY}, CAST(sum(c) AS DOUBLE) n, count(*) unique_n, sum(CASE WHEN c >= 3 THEN 1 ELSE 0 END) thrice, sum(CASE WHEN c >= 2 THEN c ELSE 0 END) repeated FROM dg GROUP BY ALL HAVING sum(c) >= 10),
a3 AS (SELECT *, least(100e0, 12e0*thrice + 80e0*repeated/n) score0 FROM ds WHERE thrice > 0 OR repeated >= 0.35*n)"""
_STEPS = f""",
sl AS (SELECT {_KEY}, row_i, round(val - lag(val) OVER (PARTITION BY ti, col_i ORDER BY row_i), 10) d FROM num WHERE nn >= 8),
sg AS (SELECT {_KEY}, d, count(*) c FROM sl WHERE d <> 0 GROUP BY ALL),
sm AS (SELECT ti, col_i, max(c) common, sum(c) nonzero FROM sg GROUP BY ALL HAVING sum(c) >= 5),
ss AS (SELECT {_KEY}, avg(d) FILTER (WHERE d <> 0) mean, stddev_pop(d) FILTER (WHERE d <> 0) sd, count(*) + 1 n FROM sl WHERE d IS NOT NULL GROUP BY ALL),
sa AS (SELECT *, CAST(common AS DOUBLE)/nonzero share, sd/(CASE WHEN mean = 0 THEN 1e-12 ELSE abs(mean) END) cv FROM ss JOIN sm USING (ti, col_i)),
a4 AS (SELECT *, least(100e0, share*80 + greatest(0e0, 0.15e0-cv)*180) score0 FROM sa WHERE share >= 0.55 OR cv < 0.08)"""
_BENFORD = f""",
bd AS (SELECT {_KEY}, fd, count(*) c, max(abs(val)) hi, min(abs(val)) lo FROM num WHERE val <> 0 GROUP BY ALL),
bs AS (SELECT {_KEY}, CAST(sum(c) AS DOUBLE) n, max(hi) hi, min(lo) lo, sum(c*c/log10(1e0+1e0/CAST(fd AS DOUBLE))) s FROM bd GROUP BY ALL),
bc AS (SELECT *, greatest(s/n-n, 0e0) chi2 FROM bs WHERE n >= 50 AND hi/lo >= 100),
bp AS (SELECT *, {_p("chi2", 8)} p FROM bc),
a5 AS (SELECT *, least(100e0, -10e0*log10(greatest(p, 1e-12))) score0 FROM bp WHERE p < 0.01)"""


def _shown(cte: str, more: str = "") -> str:
    return f" SELECT table_name, column_name, CAST(n AS BIGINT) n, round(score0, 3) score, {_severity()} severity{more} FROM {cte}"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CLASSES = f""",
cn AS (SELECT *, row_number() OVER (PARTITION BY ti, col_i ORDER BY row_i) k, round(val - lag(val) OVER (PARTITION BY ti, col_i ORDER BY row_i), 8) step FROM num0),
cs AS (SELECT ti, col_i, table_name, column_name, context, count(*) numeric_n, count(DISTINCT round(val, 10)) unique_n, max(abs(val)) hi, min(CASE WHEN val <> 0 THEN abs(val) END) lo, bool_or(val > 0) pos,
  bool_and(abs(step-1) < 1e-8) FILTER (WHERE k <= 51 AND step IS NOT NULL) by_one FROM cn GROUP BY ALL),
ct AS (SELECT *, regexp_replace(lower(column_name || ' ' || context || ' ' || table_name), '[_\\-]+', ' ', 'g') txt, numeric_n >= 5 AND unique_n >= 5 AND coalesce(by_one, false) idx FROM cs),
ck AS (SELECT *, CASE WHEN regexp_matches(txt, {_q(C.IDENTIFIER)}) OR (regexp_matches(txt, {_q(C.WIDTH)}) AND regexp_matches(txt, {_q(C.WIDTH_WITH)})) THEN 'genomic_or_identifier'
  WHEN regexp_matches(txt, {_q(C.DERIVED)}) THEN 'derived_stat_or_annotation' WHEN regexp_matches(txt, {_q(C.DESIGN)}) OR idx THEN 'design_or_sample_axis' WHEN numeric_n < 5 THEN 'too_few_numeric_values'
  WHEN numeric_n > 1000 AND regexp_matches(txt, {_q(C.OMICS)}) THEN 'large_structured_table' WHEN regexp_matches(lower(column_name), {_q(C.SUMMARY)}) THEN 'summary_statistic'
  WHEN regexp_matches(txt, {_q(C.MEASUREMENT)}) THEN 'experimental_measurement' WHEN numeric_n >= 200 THEN 'large_structured_table' ELSE 'numeric_unknown' END column_type FROM ct),
classes AS (SELECT *, CASE column_type WHEN 'experimental_measurement' THEN 'applicable' WHEN 'summary_statistic' THEN 'limited' WHEN 'numeric_unknown' THEN 'limited' ELSE 'not_applicable' END applicability,
  CASE column_type WHEN 'experimental_measurement' THEN 5 + (numeric_n >= 10)::INT + (numeric_n >= 50 AND pos AND hi/greatest(lo, 1e-12) >= 100)::INT WHEN 'summary_statistic' THEN 1 WHEN 'numeric_unknown' THEN 2 ELSE 0 END n_methods FROM ck)"""

_HIGH, _WEAK, _NA = "'high_confidence_fabrication_compatible_anomaly'", "'weak_anomaly'", "'not_applicable'"
_FOUND = (
    _STAR + _LAST + _TAIL + _DUPLICATE + _STEPS + _BENFORD + _CLASSES
    + """,
found AS (
  SELECT ti, col_i, table_name, column_name, 'last_digit_distribution' AS "method", n, score0, top/n x, p y, 10-kinds z, low_digit w, false plainzero FROM a1
  UNION ALL SELECT ti, col_i, table_name, column_name, 'decimal_tail_regularity', n, score0, top/n, tidy/n, 0, top_tail, tails = 1 AND top_tail = '00' AND (SELECT bool_and(regexp_full_match(raw, '[-+]?\\d+')) FROM num q WHERE q.ti = a2.ti AND q.col_i = a2.col_i) FROM a2
  UNION ALL SELECT ti, col_i, table_name, column_name, 'duplicate_values', n, score0, 0, 0, 0, '', false FROM a3
  UNION ALL SELECT ti, col_i, table_name, column_name, 'arithmetic_or_over_smooth_sequence', n, score0, cv, common/greatest(n-1, 1), 0, '', false FROM a4
  UNION ALL SELECT ti, col_i, table_name, column_name, 'benford_first_digit', n, score0, 0, 0, 0, '', false FROM a5),
fam AS (SELECT *, count(*) OVER (PARTITION BY ti, col_i) families FROM found),
judged AS (SELECT r.*, CASE WHEN disposition_rule IN ('excluded_type', 'summary_field', 'whole_number_tails') THEN """
    + f"{_NA} WHEN disposition_rule IN ('duplicates_alone', 'single_method') THEN {_WEAK} ELSE {_HIGH} END disposition FROM (SELECT fam.*, round(score0, 3) score, column_type, applicability, n_methods, "
    + """CASE WHEN applicability = 'not_applicable' THEN 'excluded_type' WHEN column_type = 'summary_statistic' THEN 'summary_field' WHEN plainzero THEN 'whole_number_tails'
  WHEN "method" = 'duplicate_values' AND applicability = 'applicable' THEN 'duplicates_alone'
  WHEN applicability = 'applicable' AND "method" = 'last_digit_distribution' AND n >= 50 AND w <> '0' AND (x >= 0.45 OR (y < 1e-8 AND x >= 0.35 AND z >= 3)) THEN 'heaped_digit'
  WHEN applicability = 'applicable' AND "method" = 'decimal_tail_regularity' AND n >= 50 AND w <> '00' AND (x >= 0.45 OR y >= 0.65) THEN 'heaped_tail'
  WHEN applicability = 'applicable' AND "method" = 'arithmetic_or_over_smooth_sequence' AND n >= 20 AND (x < 0.02 OR y >= 0.75) THEN 'regular_steps'
  WHEN families >= 2 AND n >= 20 AND score0 >= 80 AND applicability = 'applicable' AND "method" IN ('arithmetic_or_over_smooth_sequence', 'benford_first_digit') THEN 'several_methods'
  ELSE 'single_method' END disposition_rule FROM fam JOIN classes USING (ti, col_i)) r)"""
)
_ERRORS = "CASE \"method\" WHEN 'last_digit_distribution' THEN 'terminal_digit_heaping' WHEN 'decimal_tail_regularity' THEN 'decimal_tail_heaping' WHEN 'duplicate_values' THEN 'duplicate_value_cluster' WHEN 'arithmetic_or_over_smooth_sequence' THEN 'arithmetic_smoothness' ELSE 'benford_misfit' END"
_ELIGIBLE = "(column_type = 'experimental_measurement' OR (column_type = 'numeric_unknown' AND \"method\" IN ('duplicate_values', 'decimal_tail_regularity')))"

_PATTERN = "WITH " + _cells([("orders", 0, "orders", "o_orderkey", {"o_orderstatus": "text", "o_orderpriority": "text"}, "")])
_BOXES = f"""WITH boxes0 AS (SELECT {LINEITEM_ORDER} AS row_i, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) l, CAST(l_linenumber AS DOUBLE) w,
  CAST(CAST(l_quantity*l_linenumber*l_linenumber/2 + CASE WHEN l_orderkey % 97 = 0 THEN 15 ELSE 0 END AS DECIMAL(18,2)) AS DOUBLE) v FROM lineitem),
boxes AS (SELECT row_i, max(l) l, max(w) w, max(v) v FROM boxes0 GROUP BY row_i)"""
_SUPPLIERS = """WITH s AS (SELECT l_suppkey, CAST(count(*) AS DOUBLE) k, stddev_samp(l_quantity) sd FROM lineitem GROUP BY 1),
r AS (SELECT k, CAST(CAST(sd AS DECIMAL(18,2)) AS DOUBLE) sd, CAST(CAST(sd/sqrt(k) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS DOUBLE) sem FROM s)"""

# Documents as tables of lines and comma-separated cells.
_FLOAT = r"^\s*[-+]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[-+]?\d+(_\d+)*)?\s*$|^\s*[-+]?(inf|infinity|nan)\s*$"
_CLEAN = "CASE WHEN lower(trim(x, ' \t\n\r\v\f')) IN ('nan', 'none', 'null') THEN '' ELSE regexp_replace(trim(x, ' \t\n\r\v\f'), '\\s+', ' ', 'g') END"
_LINES = f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS row_i FROM documents),
rows0 AS (SELECT doc_id, row_i, [{_CLEAN} FOR x IN string_split(line, ',')] AS allcells FROM lines),
rows1 AS (SELECT *, [x FOR x IN allcells IF x <> ''] AS c FROM rows0)"""
_NUMERIC = f"len([x FOR x IN {{c}} IF regexp_matches(replace(x, ',', ''), {_q(_FLOAT)}, 'i')])"
_HINTED = " + ".join(f"regexp_matches(lower(array_to_string(c, ' ')), '(^|[^\\p{{L}}\\p{{N}}_]){h}([^\\p{{L}}\\p{{N}}_]|$)')::INT" for h in HINTS)
_HEADERS = _LINES + f""",
scored AS (SELECT doc_id, row_i, CASE WHEN len(c) = 0 THEN -10 ELSE (len(c) - {_NUMERIC.format(c='c')})*2.0 + ({_HINTED})*5.0 - {_NUMERIC.format(c='c')}*1.5 + (len(c) >= 3)::INT*3 - (len(c) = 1 AND length(c[1]) > 40)::INT*6 END
  + coalesce((len(nx) > 0 AND {_NUMERIC.format(c='nx')} >= greatest(1, len(nx)//3))::INT*3, 0) AS score FROM (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY row_i) nx FROM rows1 WHERE row_i <= 20) WHERE row_i < 20)"""

_FIGURES = """WITH t AS (SELECT p_partkey, 'parts.xlsx Source Data ' || CASE WHEN p_partkey % 3 = 0 THEN 'ED ' ELSE '' END || 'Fig. ' || p_size || chr(CAST(97 + p_partkey % 5 AS INTEGER)) || CASE WHEN p_partkey % 2 = 0 THEN ' and b' ELSE '' END nm FROM part)"""
_FIGURE = "CASE WHEN p_partkey % 3 = 0 THEN 'ED Fig.' ELSE 'Fig.' END || regexp_extract(nm, 'Fig\\.\\s*(\\d+)', 1)"

#: Vectors with their sign bits s, and the same with up to seven bits in a row turned, u.
_SIGNED = """b AS (SELECT vec_id, embedding, [(x > 0)::INT FOR x IN embedding[1:64]] s,
  [((y[1] > 0) <> (64 - y[2] >= vec_id % 50 AND 64 - y[2] < vec_id % 50 + vec_id % 8))::INT FOR y IN list_zip(embedding[1:64], range(1, 65))] u FROM embeddings)"""

ORACLE_SQL: dict[str, str] = {
    "last_digit": _STAR + _LAST + _shown("a1", ", top_digit"),
    "decimal_tail": _STAR + _TAIL + _shown("a2", ", top_tail, CAST(tidy AS BIGINT) tidy"),
    "duplicate_values": _STAR + _DUPLICATE + _shown("a3", ", CAST(unique_n AS BIGINT) unique_n, CAST(repeated AS BIGINT) repeated"),
    "arithmetic_sequence": _STAR + _STEPS + _shown("a4", ", CAST(common AS BIGINT) steps"),
    "benford": _STAR + _BENFORD + _shown("a5"),
    "duplicate_rows": """WITH p AS (SELECT o_orderstatus, o_orderpriority, count(*) c FROM orders GROUP BY 1, 2),
s AS (SELECT sum(c) n, sum((c > 1)::INT) k, sum(CASE WHEN c > 1 THEN c ELSE 0 END) r FROM p), q AS (SELECT *, least(100e0, 90e0*r/n + 4*k) score0 FROM s WHERE n >= 5 AND k > 0)
SELECT 'orders' table_name, '__rows__' column_name, CAST(n AS BIGINT) n, round(score0, 3) score, """ + _severity() + " severity, CAST(k AS BIGINT) patterns, CAST(r AS BIGINT) repeated FROM q",
    "clone_vector": "WITH v AS (SELECT " + ", ".join(f"list(round({c}, 8) ORDER BY n_nationkey) {n}" for n, c in (("a", "n_nationkey"), ("b", "n_regionkey"), ("c", "n_nationkey"))) + ", count(*) n FROM nation) "
    + "UNION ALL ".join(f"SELECT 'nation' table_name, '{x} <> {y}' column_name, CAST(n AS BIGINT) n, 95e0 score, 'High' severity FROM v WHERE n BETWEEN 5 AND 200 AND {p} = {q} AND len(list_distinct({p})) > 1 " for x, y, p, q in (("n_nationkey", "n_regionkey", "a", "b"), ("n_nationkey", "key_copy", "a", "c"), ("n_regionkey", "key_copy", "b", "c"))),
    "formula_check": _BOXES + ", m AS (SELECT count(*) n, sum((abs(v - l*w*w/2) > greatest(0.02e0, abs(l*w*w/2)*0.02e0))::INT) k FROM boxes), q AS (SELECT *, least(100e0, 50e0 + 5e0*k) score0 FROM m WHERE k >= 2) SELECT 'lineitem' table_name, 'volume_mm3' column_name, CAST(n AS BIGINT) n, round(score0, 3) score, " + _severity() + " severity, CAST(k AS BIGINT) mismatches FROM q",
    "summary_math": _SUPPLIERS + ", m AS (SELECT count(*) n, sum((k > 1 AND abs(sem - sd/sqrt(k)) > greatest(0.001e0, abs(sd/sqrt(k))*0.03e0))::INT) j FROM r) SELECT 'suppliers' table_name, 'sem' column_name, CAST(n AS BIGINT) n, least(100e0, 70e0 + 5e0*j) score, 'High' severity, CAST(j AS BIGINT) mismatches FROM m WHERE j >= 1",
    "classify_columns": _STAR + _CLASSES + " SELECT table_name, column_name, CAST(numeric_n AS BIGINT) numeric_n, CAST(unique_n AS BIGINT) unique_n, column_type, applicability, applicability = 'applicable' homepage_eligible, CAST(n_methods AS BIGINT) n_methods FROM classes",
    "normalize": _FOUND + f' SELECT table_name, column_name, "method", {_ERRORS} error_type, column_type, applicability, disposition, disposition_rule, true has_reason, score, CAST(n AS BIGINT) n FROM judged',
    "rank": _FOUND + f""" SELECT table_name, column_name, "method", {_severity()} severity, round(score + CASE {_severity()} WHEN 'High' THEN 30 WHEN 'Medium' THEN 10 ELSE 0 END + 12
  + CASE column_type WHEN 'experimental_measurement' THEN 25 WHEN 'numeric_unknown' THEN -5 WHEN 'genomic_or_identifier' THEN -80 WHEN 'derived_stat_or_annotation' THEN -60 WHEN 'design_or_sample_axis' THEN -70 WHEN 'large_structured_table' THEN -55 WHEN 'too_few_numeric_values' THEN -40 ELSE 0 END
  - CASE WHEN {_ELIGIBLE} THEN 0 ELSE 30 END, 3) rank_score FROM judged""",
    "assessment_summary": _FOUND + f""", c AS (SELECT count(*) FILTER (WHERE disposition = {_HIGH}) h, count(*) FILTER (WHERE disposition = {_WEAK}) w, count(*) FILTER (WHERE disposition = {_NA}) na, count(*) hits FROM judged)
SELECT h high_confidence_count, w weak_anomaly_count, na not_applicable_count, hits raw_statistical_hit_count, (SELECT count(*) FROM classes) auditable_column_count,
  CASE WHEN h > 0 THEN {_HIGH} WHEN w > 0 THEN {_WEAK} ELSE 'none' END highest_observed_tier, 'auditable_numeric_data_present' source_data_status FROM c""",
    "header_detect": _HEADERS + " SELECT doc_id, CAST(list(row_i ORDER BY score DESC, row_i)[1] AS BIGINT) header_i FROM scored GROUP BY doc_id",
    "column_names": _LINES + """, f AS (SELECT doc_id, unnest(allcells) x, generate_subscripts(allcells, 1) - 1 AS col_i FROM rows0 WHERE row_i = 0),
b AS (SELECT doc_id, col_i, CASE WHEN x = '' THEN 'col_' || (col_i + 1) ELSE x END base FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY col_i) k FROM b)
SELECT doc_id, CAST(col_i AS BIGINT) col_i, CASE WHEN k = 1 THEN base ELSE base || '.' || k END column_name FROM k""",
    "article_title": """WITH l AS (SELECT doc_id, [x FOR x IN [trim(regexp_replace(y, '\\s+', ' ', 'g')) FOR y IN string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\x0B\\f\\r]')] IF length(x) > 20 AND NOT regexp_matches(lower(x), '^(advertisement|skip to)')] c FROM documents)
SELECT doc_id, coalesce(c[1], '') title FROM l""",
    "source_links": "SELECT page_id, 'http://x.example.org/s.pdf https://data.example.org/t' || page_id || '.xlsx' links FROM pages",
    "figure_map": _FIGURES + f""", g AS (SELECT p_partkey, {_FIGURE} figure_id, [chr(CAST(97 + p_partkey % 5 AS INTEGER))] || CASE WHEN p_partkey % 2 = 0 THEN ['a', 'n', 'd', 'b'] ELSE [] END ps FROM t)
SELECT p_partkey, figure_id, CASE WHEN p_partkey % 3 = 0 THEN 'extended_data' ELSE 'main' END figure_type, array_to_string(list_sort(list_distinct(ps)), ',') panels, true mapped FROM g""",
    "captions": """WITH d AS (SELECT doc_id % 7 + 1 n FROM documents) SELECT 'Fig.' || n figure_id, 'main' figure_type, count(*) captions, 'a,b' panels FROM d GROUP BY n UNION ALL SELECT 'ED Fig.' || n, 'extended_data', count(*), 'c' FROM d GROUP BY n""",
    "notices": "SELECT 'author_correction_link' kind, 'An Author Correction to this article was published on 3 May 2021' AS text, count(*) articles FROM documents",
    "sections": "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\t-\\r \\x{85}\\p{Z}]+', ' ', 'g')) abstract, 'All data are in the source tables.' data_availability FROM documents",
    "coverage_leads": _FIGURES + f""", g AS (SELECT DISTINCT {_FIGURE} f FROM t), h AS (SELECT regexp_replace(f, '(\\d+)$', '1\\1') f FROM g)
SELECT 'source_data_coverage' kind, 'Low' priority, 40e0 context_score, f figure_id FROM h WHERE f NOT IN (SELECT f FROM g)""",
    "column_leads": _STAR + _CLASSES + """, k AS (SELECT ti, count(*) k FROM classes WHERE applicability = 'applicable' AND numeric_n >= 5 GROUP BY ti)
SELECT 'mapped_experimental_source_data' kind, CASE WHEN 55 + least(20, 2*k) >= 80 THEN 'High' ELSE 'Medium' END priority, CAST(55 + least(20, 2*k) AS DOUBLE) context_score, 'Fig.' || ti figure_id FROM k""",
    "label_leads": "SELECT 'repeated_label_or_header_rows' kind, 'Low' priority, 35e0 context_score WHERE EXISTS (SELECT 1 FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 1)",
    "oracle_matches": """WITH f AS (SELECT doc_id, source, concat_ws(' ', lang, text) blob, 'kind' || (doc_id % 3) kind, 'table' || (doc_id % 2) tab FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) id, 'kind' || (item_id % 3) kind, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'src' || (item_id % 10) END part, CASE WHEN item_id % 5 = 0 THEN 'table0' ELSE '' END tab, item_id % 7 = 0 every, split_part(text, ' ', 1) one, substr(text, 1, 30) two FROM benchmark)
SELECT id oracle_id, doc_id normalized_rank FROM i JOIN f ON i.kind = f.kind AND (part = '' OR contains(source, part)) AND (i.tab = '' OR i.tab = f.tab) AND (every OR contains(blob, one) OR contains(blob, two))""",
    "csv_extract": "SELECT doc_id, md5(coalesce(text, '')) text_md5, coalesce(lang, '') lang, CAST(n_chars AS BIGINT) n_chars, CAST(4 AS BIGINT) n_cells FROM documents",
    "phash_pairs": f"""WITH {_SIGNED}, a AS (SELECT s, min(vec_id) vec_a, count(*) copies_a FROM b GROUP BY s), c AS (SELECT u, min(vec_id) vec_b, count(*) copies_b FROM b GROUP BY u),
p AS (SELECT vec_a, vec_b, copies_a, copies_b, CAST(list_sum([(x[1] <> x[2])::INT FOR x IN list_zip(s, u)]) AS BIGINT) distance FROM a CROSS JOIN c) SELECT * FROM p WHERE distance <= 7""",
    "panel_candidates": f"""WITH {_SIGNED}, q AS (SELECT 'v' || lpad(vec_id::VARCHAR, 12, '0') id, s ph, [(abs(x) > 0.1)::INT FOR x IN embedding[1:64]] dh, [abs(x)::DOUBLE FOR x IN embedding] e, 100 + vec_id % 7 w FROM b
  UNION ALL SELECT 'w' || lpad(vec_id::VARCHAR, 12, '0'), u, [(abs(x) > 0.1)::INT FOR x IN embedding[1:64]], [abs(x)::DOUBLE FOR x IN embedding], 100 + vec_id % 7 FROM b),
p AS (SELECT l.id panel_id_a, r.id panel_id_b, CAST(list_sum([(x[1] <> x[2])::INT FOR x IN list_zip(l.ph, r.ph)]) AS BIGINT) phash_distance, CAST(list_sum([(x[1] <> x[2])::INT FOR x IN list_zip(l.dh, r.dh)]) AS BIGINT) dhash_distance,
  list_cosine_similarity(l.e, r.e) edge, least(l.w, r.w)*80e0/(greatest(l.w, r.w)*80e0) area FROM q l JOIN q r ON l.id < r.id),
f AS (SELECT *, (64 - phash_distance) + 0.75e0*(64 - dhash_distance) + 40*edge + 12*area score FROM p WHERE phash_distance <= 18 OR dhash_distance <= 18 OR edge >= 0.55 OR area < 0.65)
SELECT panel_id_a, panel_id_b, phash_distance, dhash_distance, round(edge, 5) edge_hist_corr, round(area, 5) area_ratio, round(score, 4) recall_score FROM f ORDER BY round(score, 9) DESC, panel_id_a, panel_id_b LIMIT 300""",
    "cosine_to_label": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE e, generate_subscripts(embedding, 1) i FROM embeddings), m AS (SELECT label, i, avg(e) m FROM x GROUP BY 1, 2), j AS (SELECT * FROM x JOIN m USING (label, i)),
c AS (SELECT *, e - avg(e) OVER (PARTITION BY vec_id) ce, m - avg(m) OVER (PARTITION BY vec_id) cm FROM j)
SELECT vec_id, round(sum(e*m)/greatest(sqrt(sum(e*e))*sqrt(sum(m*m)), 1e-9), 5) cosine, round(sum(ce*cm)/greatest(sqrt(sum(ce*ce))*sqrt(sum(cm*cm)), 1e-9), 5) ncc FROM c GROUP BY vec_id""",
    "risk_tiers": """WITH m AS (SELECT 0.8e0+l_discount*2 ncc, 0.8e0+l_tax ssim, 0.7e0+l_tax*3 t, CAST(l_linenumber AS DOUBLE)/7 o, CAST(l_quantity AS INTEGER) i, l_discount*6 r FROM lineitem),
f AS (SELECT *, ncc >= 0.93 AND ssim >= 0.82 whole, t >= 0.86 AND o < 0.9 crop, i >= 18 AND r >= 0.35 turned FROM m),
s AS (SELECT *, CASE WHEN crop THEN 'cropped_reuse' WHEN turned THEN 'transformed_reuse' WHEN whole THEN 'whole_panel_reuse' ELSE 'weak_visual_similarity' END match_type,
  round(least(100e0, greatest(CASE WHEN whole THEN 92 + 6*least(ncc, 1e0) ELSE 0 END, CASE WHEN crop THEN 78 + 18*t ELSE 0 END, CASE WHEN turned THEN 74 + least(i, 80)*0.25e0 + r*12 ELSE 0 END)), 2) score FROM f),
g AS (SELECT *, CASE WHEN (match_type = 'whole_panel_reuse' AND ncc >= 0.95 AND ssim >= 0.85) OR (match_type = 'cropped_reuse' AND t >= 0.9) OR (match_type = 'transformed_reuse' AND i >= 30 AND r >= 0.45) THEN 'High'
  WHEN score >= 72 OR i >= 16 OR t >= 0.82 THEN 'Medium' ELSE 'Low' END risk_tier FROM s)
SELECT match_type, risk_tier, count(*) pairs, max(score) top_score FROM g GROUP BY 1, 2""",
    "score_labels": """WITH t AS (SELECT * FROM (VALUES ('k1', 'Fig. 2c', false, 2, 'c'), ('k2', 'Extended Data Fig. 7k', true, 7, 'k'), ('k3', 'Fig. 99a', false, 99, 'a')) v(oracle_id, label, ed, num, panel)),
l AS (SELECT p_partkey % 3 = 0 ed, p_size num, chr(CAST(97 + p_partkey % 5 AS INTEGER)) panel FROM part)
SELECT oracle_id, label, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.ed = t.ed AND l.num = t.num AND l.panel = t.panel) THEN 'true_positive' WHEN EXISTS (SELECT 1 FROM l WHERE l.ed = t.ed AND l.num = t.num) THEN 'near_miss' ELSE 'missed_oracle' END status FROM t""",
    "score_oracle": "SELECT 1e0 exact_recovery_rate, 1e0 exact_or_near_recovery_rate, 0::BIGINT decoy_high_priority_failures, true passed",
}
