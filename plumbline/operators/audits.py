"""Nine numeric screens. Each audits all columns of all tables in one job: cells in, findings out.

The five screens of single columns share their work. Cells are counted by their texts (see ``values``: partial sums before the shuffle, so a column
that a third of all cells belong to costs no task of its own); how often each last digit, decimal tail, precision, value and first digit occurs follows
from the counts of texts, how often each step occurs from the rows in their order. A row of statistics for each column is made of that, and the hits follow from it. Only then are
the first rows behind each hit looked up, for all screens at once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import tokens as T
from plumbline.model import COLUMN_KEY, TABLE_KEY
from plumbline.operators.values import COLUMN, PLAIN, counted, first_cells, lagged, parsed, steps, value_key
from plumbline.sources.melt import named
from plumbline.sources.store import release, stored

#: Examples that a finding carries, and the columns beside them whose texts are shown as labels.
EXAMPLES = 8
LABELLED = 8
#: Cells of checked tables in one part, about.
CHECKED = 4_000_000
#: Mismatches of a formula that a finding shows.
MISMATCHES = 10

#: What tells a hit: its table, method and columns; -1 stands for no column.
HIT = ["table_index", "method", "col_i", "col_b"]
#: Fields of a finding's details; those that a method doesn't have are left out of its JSON.
DETAILS = {
    "counts": "map<string,bigint>", "chi_square": "double", "p_approx": "double", "missing_digits": "array<string>", "top_digit": "string",
    "top_tails": "map<string,bigint>", "tidy_tail_count": "bigint", "fixed_precision_fraction": "double", "top_tail": "string",
    "total_unique_values": "bigint", "distinct_repeated_values": "bigint", "distinct_repeated_values_ge3": "bigint", "repeat_count": "bigint", "repeated_observation_fraction": "double",
    "top_repeated_values": "array<struct<value:string,count:bigint,fraction:double>>", "common_step": "double", "common_step_count": "bigint", "diff_cv": "double",
    "duplicate_row_patterns": "bigint", "repeat_rows": "bigint", "columns": "array<string>", "clone_type": "string", "formula": "string", "mismatch_count": "bigint",
}
EXAMPLE = {
    "row_index": "bigint", "cell": "string", "column": "string", "value": "string", "values": "array<string>",
    "expected_from_formula": "double", "formula": "string", "expected_sem": "double", "sd": "double", "n": "double",
}


def numeric_cells(cells: DataFrame) -> DataFrame:
    """Cells that are finite numbers, with the properties of their tokens. Each screen has its own least number of them (five or more).

    Parsed cells are returned as they are: screens take either.
    """
    if "val" in cells.columns:
        return cells
    return parsed(cells.select(*COLUMN_KEY, "row_i", "row_no", "cell", "raw"))


def severity(score: Column, n: Column, confidence: Column) -> Column:
    return (
        F.when((n < 10) | confidence.isin("metadata_only", "not_extracted"), "Low")
        .when((score >= 80) & confidence.isin("raw_table", "pdf_extracted"), "High")
        .when(score >= 45, "Medium")
        .otherwise("Low")
    )


def _struct(fields: dict[str, str], **given: Column) -> Column:
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()])


def _hit(method: str, family: str, score: Column, n: Column, summary: Column, column: Column, fixed: str | None = None, col_i: Column | None = None, col_b: Column | None = None, **details: Column) -> Column:
    none = F.lit(-1)
    return F.struct(
        F.lit(method).alias("method"), (none if col_i is None else col_i).cast("int").alias("col_i"), (none if col_b is None else col_b).cast("int").alias("col_b"), F.lit(family).alias("family"),
        F.least(F.lit(100.0), score).alias("score"), n.cast("long").alias("n"), summary.alias("summary"), column.alias("column"), F.lit(fixed).cast("string").alias("fixed"), _struct(DETAILS, **details).alias("details"),
    )


#: What is counted for each method.
KINDS = {
    "last_digit_distribution": ("digit",), "decimal_tail_regularity": ("tail", "places"), "duplicate_values": ("value",), "arithmetic_or_over_smooth_sequence": ("step",), "benford_first_digit": ("first",),
}


STEP = "arithmetic_or_over_smooth_sequence"


def _keys(kinds: tuple[str, ...]) -> Column:
    """The properties of a text that are counted: (kind, key); null where it has none."""
    of = {"digit": F.col("last_digit"), "tail": F.col("tail"), "places": F.col("places").cast("string"), "value": value_key().cast("string"), "first": F.when(F.col("val") != 0, F.col("first_digit"))}
    none = F.array().cast("array<struct<kind:string,key:string>>")
    found = [F.when(of[k].isNotNull(), F.struct(F.lit(k).alias("kind"), of[k].alias("key"))) for k in kinds if k != "step"]
    return F.array_compact(F.array(*found)) if found else none


def _profile(names: DataFrame, texts: DataFrame, stepped: DataFrame | None, kinds: tuple[str, ...]) -> DataFrame:
    """A row of statistics for each column of numbers. stepped: what ``steps`` returned, if steps are asked for."""
    groups = texts.select(*COLUMN, "c", "first", F.explode(_keys(kinds)).alias("k")).groupBy(*COLUMN, "k.kind", "k.key").agg(F.sum("c").alias("c"), F.min("first").alias("first"))
    if stepped is not None:
        groups = groups.unionByName(stepped.select(*COLUMN, F.lit("step").alias("kind"), F.col("d").cast("string").alias("key"), "c", "first"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    c, key = F.col("c"), F.col("key")
    seen_first = F.struct(c, -F.col("first"))
    each = [s for k in kinds for s in (F.sum(of(k, c)).alias(f"{k}_n"), F.max(of(k, c)).alias(f"{k}_top"), F.max_by("key", of(k, seen_first)).alias(f"{k}_key"), F.count_if(F.col("kind") == k).alias(f"{k}_kinds"))]
    counts = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(of(kind, F.struct("key", "c")))))
    expected = F.log10(1.0 + 1.0 / of("first", key).try_cast("double"))
    more = {
        "digit": [F.sum(of("digit", c * c)).alias("digit_squares"), counts("digit").alias("digit_counts")],
        "tail": [
            F.sum(of("tail", F.when(key.isin("00", "50", "05"), c).otherwise(0))).alias("tidy"),
            F.slice(F.sort_array(F.collect_list(of("tail", F.struct("c", (-F.col("first")).alias("f"), "key"))), asc=False), 1, 10).alias("tails"),  # of 100 at most
        ],
        "places": [],
        "value": [F.count_if((F.col("kind") == "value") & (c >= 2)).alias("repeated_values"), F.count_if((F.col("kind") == "value") & (c >= 3)).alias("thrice"), F.sum(of("value", F.when(c >= 2, c).otherwise(0))).alias("repeated")],
        "step": [],
        "first": [F.sum(of("first", c * c / expected)).alias("first_squares"), counts("first").alias("first_counts")],
    }
    stats = groups.groupBy(*COLUMN).agg(*each, *[m for k in kinds for m in more[k]])
    about = texts.groupBy(*COLUMN).agg(F.sum(F.when(F.col("integer_like"), c).otherwise(0)).alias("integers"), F.max(F.abs("val")).alias("high"), F.min(F.when(F.col("val") != 0, F.abs("val"))).alias("low"), F.sum("c").alias("n"))
    if stepped is not None:
        mean = stepped.groupBy(*COLUMN).agg((F.sum(F.col("d") * c) / F.sum("c")).alias("step_mean"))
        spread = stepped.join(mean, COLUMN).groupBy(*COLUMN, "step_mean").agg(F.sqrt(F.sum(c * (F.col("d") - F.col("step_mean")) * (F.col("d") - F.col("step_mean"))) / F.sum("c")).alias("step_sd"))
        about = about.join(spread, COLUMN, "left")
    return names.join(about, COLUMN).join(stats, COLUMN)


def _column_hits(methods: tuple[str, ...]) -> Column:
    """The hits of a column's row of statistics."""
    n, name, at = F.col("n"), F.col("column"), F.col("col_i")
    minus = lambda share, limit: F.greatest(F.lit(0.0), share - limit)

    def last_digit() -> Column:
        share, missing, m = F.col("digit_top") / F.col("digit_n"), 10 - F.col("digit_kinds"), F.col("digit_n")
        chi2 = F.greatest(10.0 * F.col("digit_squares") / m - m, F.lit(0.0))
        export_zero = (F.col("digit_key") == "0") & (share >= 0.95) & (F.col("integers") >= 0.9 * m)
        return T.let(T.chi_square_p(chi2, 9), lambda p: F.when(
            (m >= 10) & ((p < 0.01) | (share >= 0.35) | ((m >= 30) & (missing > 0))) & ~export_zero,
            _hit("last_digit_distribution", "digit_preference", T.minus_ten_log(p) + minus(share, 0.25) * 120 + 4 * missing, m, F.format_string("Last digit %s in %d of %d values", "digit_key", "digit_top", "digit_n"), name, col_i=at,
                 counts=F.col("digit_counts"), chi_square=F.round(chi2, 4), p_approx=p, missing_digits=F.array_except(F.array(*[F.lit(str(d)) for d in range(10)]), F.map_keys("digit_counts")), top_digit=F.col("digit_key"))))

    def tail() -> Column:
        m = F.col("tail_n")
        share, tidy, same = F.col("tail_top") / m, F.col("tidy") / m, F.coalesce(F.col("places_top") / F.col("places_n"), F.lit(0.0))
        top = F.map_from_entries(F.transform("tails", lambda x: F.struct(x["key"], x["c"])))
        return F.when(
            (m >= 10) & ((share >= 0.35) | (tidy >= 0.55) | ((m >= 30) & (same >= 0.98))),
            _hit("decimal_tail_regularity", "decimal_regularity", minus(share, 0.2) * 140 + minus(tidy, 0.35) * 100 + minus(same, 0.9) * 30, m, F.format_string("Decimal tail %s in %d of %d values; tidy tails in %d", "tail_key", "tail_top", "tail_n", "tidy"), name, col_i=at,
                 top_tails=top, tidy_tail_count=F.col("tidy"), fixed_precision_fraction=same, top_tail=F.col("tail_key")))

    def duplicate() -> Column:
        m = F.col("value_n")
        return F.when(
            (m >= 10) & ((F.col("thrice") > 0) | (F.col("repeated") / m >= 0.35)),
            _hit("duplicate_values", "duplication", 12.0 * F.col("thrice") + 80.0 * F.col("repeated") / m, m, F.format_string("%d values, %d different; %d of them in repeated groups", "value_n", "value_kinds", "repeated"), name, col_i=at,
                 total_unique_values=F.col("value_kinds"), distinct_repeated_values=F.col("repeated_values"), distinct_repeated_values_ge3=F.col("thrice"), repeat_count=F.col("repeated"), repeated_observation_fraction=F.round(F.col("repeated") / m, 4)))

    def step() -> Column:
        share, mean = F.col("step_top") / F.col("step_n"), F.abs("step_mean")
        return T.let(F.col("step_sd") / F.when(mean == 0, 1e-12).otherwise(mean), lambda cv: F.when(
            (n >= 8) & (F.col("step_n") >= 5) & ((share >= 0.55) | (cv < 0.08)),
            _hit("arithmetic_or_over_smooth_sequence", "row_order_regularity", share * 80 + F.greatest(F.lit(0.0), 0.15 - cv) * 180, n, F.format_string("Step %s in %d of %d changes from row to row", "step_key", "step_top", "step_n"), name, col_i=at,
                 common_step=F.col("step_key"), common_step_count=F.col("step_top"), diff_cv=cv)))

    def benford() -> Column:
        m = F.col("first_n")
        chi2 = F.greatest(F.col("first_squares") / m - m, F.lit(0.0))
        return T.let(T.chi_square_p(chi2, 8), lambda p: F.when(
            (m >= 50) & (F.col("high") / F.col("low") >= 100) & (p < 0.01),
            _hit("benford_first_digit", "first_digit", T.minus_ten_log(p), m, F.format_string("First digits of %d values differ from Benford's law", "first_n"), name, col_i=at,
                 counts=F.col("first_counts"), chi_square=F.round(chi2, 4), p_approx=p)))

    made = {"last_digit_distribution": last_digit, "decimal_tail_regularity": tail, "duplicate_values": duplicate, "arithmetic_or_over_smooth_sequence": step, "benford_first_digit": benford}
    return F.array_compact(F.array(*[made[m]() for m in methods]))


Parts = tuple[DataFrame, DataFrame]  # hits, and the rows behind them: (*HIT, pos, row_i, focus, example)


def _columns(cells: DataFrame, methods: tuple[str, ...] = tuple(KINDS), texts: DataFrame | None = None) -> Parts:
    """The screens of single columns. texts: what ``counted`` made of the cells, if it is there."""
    kinds = tuple(k for m in methods for k in KINDS[m])
    texts = parsed(counted(cells) if texts is None else texts)
    names = named(cells, COLUMN_KEY)
    stepped = None
    if "step" in kinds:
        longest, plain = texts.groupBy(*COLUMN).agg(F.sum("c").alias("n"), F.bool_and(F.col("raw").rlike(PLAIN)).alias("plain")).agg(F.max("n"), F.bool_and("plain")).first()
        stepped = steps(cells, longest or 0, plain)
        release(cells.sparkSession)
    of_hit = {m: KINDS[m][0] for m in methods}
    shown = F.struct(*[F.lit(of_hit[m]).alias(m) for m in methods])
    profile = _profile(names, texts, stepped, kinds).withColumn("hit", F.explode(_column_hits(methods)))
    key = reduce(lambda out, m: out.when(F.col("hit.method") == m, F.col(f"{of_hit[m]}_key")), methods, F.when(F.lit(False), ""))
    kind = reduce(lambda out, m: out.when(F.col("hit.method") == m, shown[m]), methods, F.when(F.lit(False), ""))
    found = stored(profile.select(*TABLE_KEY, "column", "hit", kind.alias("kind"), key.alias("key")), "hits")
    hits = found.select(*TABLE_KEY, "hit.*")
    if "duplicate_values" in methods:
        hits = _with_repeated_values(hits, texts, found)
    about = found.select("table_index", F.col("hit.col_i").alias("col_i"), "column", "kind", "key", F.col("hit.method").alias("method"))
    order = Window.partitionBy("table_index", "method", "col_i").orderBy("row_i")
    shown_as = lambda x: _struct(EXAMPLE, row_index=x["row_no"], cell=x["cell"], column=F.col("column"), value=x["raw"])
    parts = []
    if set(methods) - {STEP}:
        wanted = about.where(F.col("method") != STEP).groupBy(*COLUMN).agg(F.collect_list(F.struct("kind", "key", "method", "column")).alias("wanted"))  # five at most
        fits = F.filter("wanted", lambda w: F.exists("keys", lambda k: (k["kind"] == w["kind"]) & (k["key"] == w["key"])))
        behind = texts.join(wanted, COLUMN).select(*COLUMN, "raw", "c", "first", "last", "wanted", _keys(tuple(k for k in kinds if k != "places")).alias("keys"))
        behind = behind.select(*COLUMN, "raw", "c", "first", "last", F.explode(fits).alias("w")).select(*COLUMN, "w.method", "w.column", "raw", "c", "first", "last")
        some = first_cells(behind, cells, [*COLUMN, "method", "column"], EXAMPLES)
        parts.append(some.select("table_index", "method", "col_i", "k", F.lit(0).alias("j"), "row_i", shown_as({x: F.col(x) for x in ("row_no", "cell", "raw")}).alias("example")))
    if stepped is not None:
        of_step = stored(about.where(F.col("method") == STEP).select(*COLUMN, "method", "column", "key"), "wanted")
        # A step has two ends. Only columns of hits are ordered again.
        own = cells.join(of_step.select(*COLUMN), COLUMN, "left_semi")
        first = lagged(own, longest or 0, plain).where("d <> 0").join(of_step, COLUMN).where(F.col("d").cast("string") == F.col("key"))
        first = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= EXAMPLES // 2)
        ends = stored(first.select(*COLUMN, "method", "column", "k", F.posexplode(F.array("before.row_i", "row_i")).alias("j", "row_i")), "ends")
        at = own.drop("column").join(ends, [*COLUMN, "row_i"]).where(T.value(T.numeric_token(F.col("raw"))).isNotNull())
        parts.append(at.select("table_index", "method", "col_i", "k", "j", "row_i", shown_as({x: F.col(x) for x in ("row_no", "cell", "raw")}).alias("example")))
    rows = reduce(DataFrame.unionByName, parts)
    return hits, rows.select("table_index", "method", "col_i", F.lit(-1).alias("col_b"), (F.col("k") * 2 + F.col("j")).cast("long").alias("pos"), "row_i", F.col("col_i").alias("focus"), "example")


def _with_repeated_values(hits: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the ten most frequent values to hits of equal values."""
    is_dup = F.col("method") == "duplicate_values"
    columns = found.where("hit.method = 'duplicate_values'").select("table_index", F.col("hit.col_i").alias("col_i"), F.col("hit.n").alias("of"))
    groups = texts.select(*COLUMN, "c", "first", value_key().alias("v")).join(columns, COLUMN).groupBy(*COLUMN, "of", "v").agg(F.sum("c").alias("c"), F.min("first").alias("first")).where("c >= 2")
    most = groups.withColumn("k", F.row_number().over(Window.partitionBy(*COLUMN).orderBy(F.desc("c"), "first"))).where("k <= 10")
    shown = F.struct(F.col("v").cast("string").alias("value"), F.col("c").alias("count"), F.round(F.col("c") / F.col("of"), 4).alias("fraction"))
    most = most.groupBy(*COLUMN).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", shown.alias("s")))), lambda x: x["s"]).alias("most"))
    return hits.join(most, COLUMN, "left").withColumn("details", F.when(is_dup, F.col("details").withField("top_repeated_values", F.col("most"))).otherwise(F.col("details"))).drop("most")


def table_rows(cells: DataFrame) -> DataFrame:
    """Rows of tables as arrays of stripped cells, in the order of their columns."""
    cell = F.struct("col_i", T.stripped(F.coalesce("raw", F.lit(""))).alias("x"))
    return cells.groupBy(*TABLE_KEY, "row_i", "row_no").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["x"]).alias("values"))


def _rows(cells: DataFrame) -> Parts:
    """A6: identical rows of a table. Blank rows count for its size alone."""
    rows = table_rows(cells)
    patterns = rows.groupBy(*TABLE_KEY, "values").agg(F.count("*").alias("c"), F.min("row_i").alias("first")).withColumn("blank", ~F.exists("values", lambda x: x != ""))
    c, again = F.col("c"), (F.col("c") > 1) & ~F.col("blank")
    stats = patterns.groupBy(*TABLE_KEY).agg(F.sum("c").alias("rows"), F.sum(F.when(~F.col("blank"), c)).alias("m"), F.count_if(again).alias("patterns"), F.sum(F.when(again, c).otherwise(0)).alias("repeated")).where("rows >= 5 and patterns > 0")
    score = 90.0 * F.col("repeated") / F.col("m") + 4 * F.col("patterns")
    hit = _hit("duplicate_rows", "duplication", score, F.col("m"), F.format_string("%d patterns of identical rows cover %d of %d rows", "patterns", "repeated", "m"), F.lit("__rows__"), duplicate_row_patterns=F.col("patterns"), repeat_rows=F.col("repeated"))
    hits = stored(stats.select(*TABLE_KEY, hit.alias("hit")).select(*TABLE_KEY, "hit.*"), "hits")
    first = patterns.where(again).withColumn("k", F.row_number().over(Window.partitionBy("table_index").orderBy("first"))).where("k <= 3")
    some = rows.join(first.select("table_index", "values", "k", "c"), ["table_index", "values"])
    some = some.withColumn("j", F.row_number().over(Window.partitionBy("table_index", "k").orderBy("row_i"))).where(F.col("j") <= EXAMPLES)
    # A list that is full takes one row of each pattern that follows.
    before = F.coalesce(F.sum(F.when(F.col("j") == 1, F.least("c", F.lit(EXAMPLES)))).over(Window.partitionBy("table_index").orderBy("k").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("before", before).where((F.col("j") == 1) | (F.col("before") + F.col("j") <= EXAMPLES)).join(hits.select("table_index"), "table_index", "left_semi")
    example = _struct(EXAMPLE, row_index=F.col("row_no"), values=F.slice("values", 1, 12))
    none = F.lit(-1)
    return hits, some.select("table_index", F.lit("duplicate_rows").alias("method"), none.alias("col_i"), none.alias("col_b"), (F.col("k") * 100 + F.col("j")).cast("long").alias("pos"), "row_i", none.alias("focus"), example.alias("example"))


def _clones(cells: DataFrame, least: int = 5, most: int = 200) -> Parts:
    """A7: two columns of a table with equal values in equal order, blanks left out: a join on the vector, not on all pairs."""
    numeric = numeric_cells(cells)
    # Sizes first: only short columns become vectors.
    sizes = numeric.groupBy(*COLUMN).agg(F.count("*").alias("k")).where(F.col("k").between(least, most)).drop("k")
    at = F.struct("row_i", (F.round("val", 8) + 0.0).alias("v"), "row_no", "cell", "raw")
    vectors = numeric.join(sizes, COLUMN, "left_semi").groupBy(*COLUMN_KEY).agg(F.array_sort(F.collect_list(at)).alias("cells"))
    vectors = vectors.withColumn("vector", F.transform("cells", lambda x: x["v"])).where(F.size(F.array_distinct("vector")) > 1).withColumn("cells", F.slice("cells", 1, 4))
    right = vectors.select("table_index", "vector", F.col("col_i").alias("col_b"), F.col("column").alias("column_b"), F.col("cells").alias("cells_b"))
    pairs = stored(vectors.join(right, ["table_index", "vector"]).where("col_i < col_b").withColumn("m", F.size("vector")).drop("vector"), "pairs")
    hit = _hit(
        "clone_vector", "duplication", F.lit(95.0), F.col("m"), F.format_string("%s and %s hold the same %d values", "column", "column_b", "m"), F.concat_ws(" <> ", "column", "column_b"), "High", F.col("col_i"), F.col("col_b"),
        columns=F.array("column", "column_b"), clone_type=F.lit("exact_vector"),
    )
    side = lambda cells, column, focus, j: F.transform(cells, lambda x, i: F.struct((i * 2 + j).cast("long").alias("pos"), x["row_i"].alias("row_i"), focus.alias("focus"), _struct(EXAMPLE, row_index=x["row_no"], cell=x["cell"], column=column, value=x["raw"]).alias("example")))
    both = F.concat(side(F.col("cells"), F.col("column"), F.col("col_i"), 0), side(F.col("cells_b"), F.col("column_b"), F.col("col_b"), 1))
    rows = pairs.select("table_index", F.lit("clone_vector").alias("method"), "col_i", "col_b", F.explode(both).alias("x"))
    return pairs.select(*TABLE_KEY, hit.alias("hit")).select(*TABLE_KEY, "hit.*"), rows.select(*HIT, "x.*")


#: The columns that a check is made of, the first that fits each pattern; the last one is what is checked.
CHECKS = {
    "formula_mismatch": {"a": r"\blength", "b": r"\bwidth", "x": r"\bvolume"},
    "summary_math_inconsistency": {"a": r"^n$|sample\s*n", "b": r"\bsd\b|std", "x": r"\bsem\b|se\b"},
}
FORMULAS = {"formula_mismatch": "length * width^2 / 2", "summary_math_inconsistency": "SEM = SD / sqrt(n)"}


def _loose_number(text: Column) -> Column:
    """What a plain conversion takes once commas are out: no per cent sign, but infinities."""
    text = F.regexp_replace(T.stripped(F.coalesce(text, F.lit(""))), ",", "")
    number = F.when(text.rlike(r"(?i)^[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[-+]?\d+)?$"), text.try_cast("double"))
    infinite = F.when(text.rlike(r"(?i)^\+?inf(inity)?$"), float("inf")).when(text.rlike(r"(?i)^-inf(inity)?$"), float("-inf"))
    return F.coalesce(number, infinite)


def _checks(cells: DataFrame, methods: tuple[str, ...] = tuple(CHECKS)) -> Parts:
    """A8: volume against length * width**2 / 2. A9: SEM against SD / sqrt(n)."""
    names = cells.select(*TABLE_KEY, "col_i", "column").distinct()
    first = lambda p: F.min(F.when(F.col("column").rlike("(?i)" + p), F.struct("col_i", "column")))
    chosen = names.groupBy(*TABLE_KEY).agg(*[F.struct(*[first(p).alias(n) for n, p in CHECKS[m].items()]).alias(m) for m in methods])
    chosen = chosen.select(*TABLE_KEY, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("of")) for m in methods])).alias("c")).select(*TABLE_KEY, "c.method", "c.of.*").dropna()
    at = stored(chosen.select("table_index", "method", *[F.col(f"{n}.col_i").alias(f"_{n}") for n in "abx"]), "checks")
    some = cells.join(at, "table_index").where("col_i = _a or col_i = _b or col_i = _x")
    # Numbers alone are gathered by row, in parts of bounded size however large the table is; texts are looked up for the rows shown.
    parts = max(1, math.ceil(some.count() / CHECKED))
    # A bit for each of the three that a column is.
    which = sum((F.when(F.col("col_i") == F.col(f"_{n}"), 1 << i).otherwise(0) for i, n in enumerate("abx")), F.lit(0))
    some = some.select("table_index", (F.col("method") == "formula_mismatch").alias("formula"), "row_i", which.cast("tinyint").alias("which"), _loose_number(F.col("raw")).alias("number"))
    rows = some.repartition(parts, "table_index", "formula", "row_i").groupBy("table_index", "formula", "row_i").agg(*[F.max(F.when(F.col("which").bitwiseAND(F.lit(1 << i).cast("tinyint")) != 0, F.col("number"))).alias(n) for i, n in enumerate("abx")])
    rows = rows.withColumn("method", F.when(F.col("formula"), "formula_mismatch").otherwise("summary_math_inconsistency")).drop("formula")
    formula = F.col("method") == "formula_mismatch"
    rows = rows.withColumn("expected", F.when(formula, F.col("a") * F.col("b") * F.col("b") / 2).when(F.col("a") > 1, F.col("b") / F.sqrt("a")))
    tolerance = F.when(formula, F.greatest(F.lit(0.02), F.abs("expected") * 0.02)).otherwise(F.greatest(F.lit(0.001), F.abs("expected") * 0.03))
    off = F.abs(F.col("x") - F.col("expected"))
    wrong = F.coalesce((off > tolerance) & ~F.isnan(off), F.lit(False))
    stats = rows.groupBy("table_index", "method").agg(F.count("*").alias("m"), F.count_if(wrong).alias("k")).where((F.col("k") >= 2) | (~formula & (F.col("k") >= 1)))
    stats = stats.join(chosen, ["table_index", "method"])
    said, column, x_at = F.format_string("%d rows differ from what their other columns give", "k"), F.col("x.column"), F.col("x.col_i")
    details = lambda m: {"formula": F.lit(FORMULAS[m]), "mismatch_count": F.col("k")}
    hit = F.when(formula, _hit("formula_mismatch", "internal_consistency", 50.0 + 5.0 * F.col("k"), F.col("m"), said, column, None, x_at, **details("formula_mismatch"))).otherwise(
        _hit("summary_math_inconsistency", "internal_consistency", 70.0 + 5.0 * F.col("k"), F.col("m"), said, column, "High", x_at, **details("summary_math_inconsistency"))
    )
    hits = stored(stats.select(*TABLE_KEY, hit.alias("hit")).select(*TABLE_KEY, "hit.*"), "hits")
    shown = rows.where(wrong).withColumn("pos", F.row_number().over(Window.partitionBy("table_index", "method").orderBy("row_i"))).where(F.col("pos") <= MISMATCHES)
    shown = stored(shown.select("table_index", "method", "row_i", "a", "b", "expected", "pos"), "shown")
    texts = cells.join(at.select("table_index", "method", F.col("_x").alias("col_i")), ["table_index", "col_i"]).join(shown.select("table_index", "method", "row_i"), ["table_index", "method", "row_i"], "left_semi")
    texts = texts.groupBy("table_index", "method", "row_i").agg(F.max("row_no").alias("row_no"), F.max("cell").alias("cell"), F.max("raw").alias("raw"))
    shown = shown.join(texts, ["table_index", "method", "row_i"]).join(hits.select("table_index", "method", "col_i", "col_b", "column"), ["table_index", "method"])
    summary = lambda c: F.when(~formula, c)
    example = _struct(
        EXAMPLE, row_index=F.col("row_no"), cell=F.col("cell"), column=F.col("column"), value=F.col("raw"), expected_from_formula=F.when(formula, F.round("expected", 6)), formula=F.when(formula, FORMULAS["formula_mismatch"]),
        expected_sem=summary(F.round("expected", 6)), sd=summary(F.col("b")), n=summary(F.col("a")),
    )
    return hits, shown.select(*HIT, F.col("pos").cast("long").alias("pos"), "row_i", F.col("col_i").alias("focus"), example.alias("example"))


def _labelled(rows: DataFrame, cells: DataFrame | None) -> DataFrame:
    """The rows behind hits with the texts beside them: of the first columns of the row, those that aren't numbers."""
    if cells is None:
        return rows.withColumn("labels", F.lit(None).cast("map<string,string>"))
    text = T.stripped(F.coalesce("raw", F.lit("")))
    number = F.regexp_replace(text, ",", "").rlike(T.NUMBER)
    asked = rows.where("focus >= 0").select("table_index", "row_i").distinct()
    beside = cells.where((F.col("col_i") < LABELLED) & (text != "") & ~number).select("table_index", "row_i", "col_i", "column", F.substring(text, 1, 80).alias("text")).join(asked, ["table_index", "row_i"], "left_semi")
    beside = beside.groupBy("table_index", "row_i").agg(F.array_sort(F.collect_list(F.struct("col_i", "column", "text"))).alias("beside"))
    others = F.filter("beside", lambda x: x["col_i"] != F.col("focus"))
    last = F.filter(others, lambda x: ~F.exists(others, lambda y: (y["column"] == x["column"]) & (y["col_i"] > x["col_i"])))
    labels = F.when(F.col("focus") >= 0, F.coalesce(F.map_from_entries(F.transform(last, lambda x: F.struct(x["column"], x["text"]))), F.create_map().cast("map<string,string>")))
    return rows.join(beside, ["table_index", "row_i"], "left").withColumn("labels", labels).drop("beside")


def _findings(parts: list[Parts], cells: DataFrame | None = None) -> DataFrame:
    hits, rows = (reduce(DataFrame.unionByName, some) for some in zip(*parts, strict=True))
    shown = F.struct("pos", F.col("example").withField("nearby_labels", F.col("labels")).alias("e"))
    in_order = lambda a, b: (a["pos"] - b["pos"]).cast("int")
    examples = _labelled(rows, cells).groupBy(*HIT).agg(F.transform(F.array_sort(F.collect_list(shown), in_order), lambda x: x["e"]).alias("examples"))  # ten at most
    out = hits.join(examples, HIT, "left")
    graded = F.coalesce("fixed", severity(F.col("score"), F.col("n"), F.col("source_confidence")))
    details = F.to_json(F.col("details").withField("evidence_examples", F.coalesce("examples", F.array())))
    return out.select(
        "table_index", F.when(F.col("col_i") >= 0, F.col("col_i")).alias("col_i"), "source_path", "source_kind", "source_confidence", "table_name", "column", "method", F.col("family").alias("anomaly_family"),
        graded.alias("severity"), F.round("score", 3).alias("score"), "n", "summary", details.alias("details"),
    )


def last_digit_distribution(cells: DataFrame) -> DataFrame:
    """A1: last printed digits against the uniform distribution."""
    return _findings([_columns(cells, ("last_digit_distribution",))])


def decimal_tail_regularity(cells: DataFrame) -> DataFrame:
    """A2: repeated or tidy decimals, and a single precision."""
    return _findings([_columns(cells, ("decimal_tail_regularity",))])


def duplicate_values(cells: DataFrame) -> DataFrame:
    """A3: groups of equal values (to 10 decimals)."""
    return _findings([_columns(cells, ("duplicate_values",))])


def arithmetic_sequence(cells: DataFrame) -> DataFrame:
    """A4: one step, or hardly varying steps, from row to row; rows without a change don't count."""
    return _findings([_columns(cells, ("arithmetic_or_over_smooth_sequence",))])


def benford_first_digit(cells: DataFrame) -> DataFrame:
    """A5: first digits against Benford's law, for values that span two orders of magnitude."""
    return _findings([_columns(cells, ("benford_first_digit",))])


def column_screens(cells: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A1 to A5 at once. texts: what ``counted`` made of the cells, if it is there."""
    return _findings([_columns(cells, texts=texts)])


def duplicate_rows(cells: DataFrame) -> DataFrame:
    """A6: identical rows of a table."""
    return _findings([_rows(cells)])


def clone_vector(cells: DataFrame, least: int = 5, most: int = 200) -> DataFrame:
    """A7: two columns of a table with equal values in equal order."""
    return _findings([_clones(cells, least, most)])


def formula_mismatch(cells: DataFrame) -> DataFrame:
    """A8: volume against length * width**2 / 2."""
    return _findings([_checks(cells, ("formula_mismatch",))])


def summary_math(cells: DataFrame) -> DataFrame:
    """A9: SEM against SD / sqrt(n)."""
    return _findings([_checks(cells, ("summary_math_inconsistency",))])


def audit(cells: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All nine screens over all tables: findings, with the texts beside each example. texts: what ``counted`` made of the cells, if it is there."""
    return _findings([_rows(cells), _columns(cells, texts=texts), _clones(cells), _checks(cells)], cells)
