"""Quality rules: base statistics of every text, and a decision list learned from labelled ones.

The statistics are column expressions. The list is learned by sequential covering
(as in RIPPER; Cohen 1995): a rule is a conjunction of thresholds on statistics, grown
one condition at a time by FOIL's information gain on two thirds of the
labelled rows, then pruned from its end on the other third; the rows it covers go,
and the next rule is grown, until one is no longer accurate. Of conditions on one side of one statistic the
tightest is kept. A rule rejects; what no rule
covers is kept. The list becomes one ordered ``CASE`` expression. It is learned on labelled rows that pass the base rules, which are all that it decides.

It is fitted on at most ``rows`` labelled rows (the smallest hashes of the id), whose
statistics, a few numbers each, come to the driver. The statistics and the verdict
cover every row.

Only built-in column functions are used. A null or empty text has statistics of 0 and
fails the base rules. Of labels that disagree the bad one counts, of texts of one labelled id the one of the smallest statistics is learned from. Labels that are null, or of ids that aren't there, have no
effect; without labels there are no learned rules. Repeated rows give equal rows. Other
columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROWS = 20_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.array_remove(F.split(text, _SPACE), "").alias("w"))
    count = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]+", "")).cast("long")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        count("A-Z").alias("n_upper"),
        count("!?").alias("n_marks"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    last = F.size("h") - WINDOW
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(WINDOW)])))
    rows = rows.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), grams.alias("g")).drop("lines", "h")
    # Most texts repeat no window; only the others are sorted to find which.
    placed = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.select("*", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed).alias("s")).drop("g")
    same = lambda a, b: F.coalesce(F.get("s", a)["x"] == b["x"], F.lit(False))
    again = F.filter("s", lambda x, k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), x)) | same(k + 1, x))
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.when(F.col("s").isNotNull(), covered), F.lit(0).cast("long")).alias("n_repeat_words"), "n_upper", "n_marks"
    )


#: Statistics that rules are made of: by name, the SQL of each.
FEATURES = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "n_words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    over: bool  # at least the threshold, or below it
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.over else x[self.feature] < self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.over else '<'} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def tightened(rule: Rule) -> Rule:
    """The rule with one condition, the tightest, for each side of a statistic, in the order of the first ones."""
    kept: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        before = kept.get((c.feature, c.over))
        if before is None or (c.threshold > before.threshold) == c.over:
            kept[c.feature, c.over] = c
    return tuple(kept.values())


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, most: int, thresholds: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and not bad[inside].all() and bad[inside].any():
        p0, n0 = int(bad[inside].sum()), int(inside.sum())
        best, gain_best = None, 1e-9
        for name, values in x.items():
            have = np.sort(values[inside])
            cuts = np.unique(have[np.linspace(0, len(have) - 1, thresholds).astype(int)])
            bad_values, all_values = np.sort(values[inside & bad]), have
            for over in (True, False):
                p = np.searchsorted(bad_values, cuts)
                n = np.searchsorted(all_values, cuts)
                if over:
                    p, n = p0 - p, n0 - n
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - math.log2(p0 / n0)), 0.0)
                i = int(gain.argmax())
                if gain[i] > gain_best:
                    best, gain_best = Condition(name, over, float(cuts[i])), float(gain[i])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, thresholds: int = 200, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """An ordered list of rules that cover bad rows. Every third row prunes, the others grow."""
    rules: list[Rule] = []
    prunes = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most_rules and bad[left].sum() >= least:
        grow, prune = left & ~prunes, left & prunes
        rule = _grown({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions, thresholds)

        def worth(r: Rule, rows: np.ndarray = prune) -> tuple[float, int]:
            c = covers(r, x) & rows
            p = int(bad[c].sum())
            return (2 * p - int(c.sum())) / max(1, int(c.sum())), p

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        hit = covers(rule, x) & left if rule else np.zeros(len(bad), dtype=bool)
        if hit.sum() < least or bad[hit].mean() < precision or worth(rule)[0] < 2 * precision - 1:
            break
        rules.append(tightened(rule))
        left &= ~hit
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that rejects the row; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = F.expr(" and ".join(c.sql() for c in rule))
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The statistics of every row, base_failed, kept, and the rule that rejects it."""
    stats = stored(statistics(docs, id_col, text_col), "statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    marked = labels.select(F.col(id_col), F.col(label_col).alias("_label")).dropna().groupBy(id_col).agg(F.min("_label").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    sample = stats.where(~failed).join(marked, id_col).groupBy(id_col).agg(F.min(F.struct(*[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()], "_label")).alias("x"))
    sample = sample.orderBy(F.xxhash64(id_col), id_col).select("x.*").collect()  # rows at most
    x = {n: np.array([r[n] for r in sample]) for n in FEATURES}
    bad = np.array([r["_label"] != 1 for r in sample], dtype=bool)
    rules = learn(x, bad) if len(sample) else []
    return (
        stats.withColumn("base_failed", failed)
        .withColumn("rule", rule_number(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    )
