import re

import numpy as np
from cases import documents, empty, texts
from pyspark.sql import functions as F

from plumbline.llm import quality_rules as Q

#: Words of marks that repeat none of one another.
MARKS = "".join(f" #{k}$$&&" for k in range(20))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places: dict[tuple, list] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    found = texts() + ["a b c d e f g h " * 30, "x\n x\nx\n\n\n", "# | <> ñ漢字 $$ a\x0bb", "a " * 9, "a b c d e f g h a b c d e f g h", "\U0001f600\U0001f600 x"]
    got = {r.doc_id: tuple(r[1:6]) for r in Q.statistics(documents(spark, found)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(found)}


def test_learned_rules_separate_what_a_conjunction_can():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] >= 0.8) & (x["b"] < 0.5) | (x["c"] >= 0.95)
    verdict = np.zeros(3000, dtype=bool)
    for rule in Q.learn(x, bad):
        verdict |= Q.covers(rule, x)
    assert (verdict & ~bad).sum() <= 30 and (verdict & bad).sum() >= 0.9 * bad.sum()
    assert Q.learn(x, rng.random(3000) < 0.1) == []


def test_one_condition_for_each_side_of_a_statistic():
    c = Q.Condition
    rule = (c("a", True, 0.2), c("b", False, 5.0), c("a", True, 0.9), c("a", False, 3.0), c("b", False, 7.0))
    assert Q.tightened(rule) == (c("a", True, 0.9), c("b", False, 5.0), c("a", False, 3.0))


def test_rules_are_learned_on_what_passes_the_base(spark):
    """Bad rows that fail the base rules, or good ones, neither teach a rule nor hide one."""
    clean = "the quick river flows over many different stones while amber clouds drift along the valley towards evening and nobody minds it at all"
    rows = [(i, f"{clean} {i} {i * 7}" + (MARKS if i % 4 == 0 else "")) for i in range(200)]
    short = [(i, "### && $$ " * (i % 3)) for i in range(1000, 1400)]
    labels = [(i, int(i % 4 != 0)) for i in range(200)]
    docs, schema = "doc_id long, text string", "doc_id long, quality int"
    want = {r.doc_id: (r.kept, r.rule) for r in Q.judged(spark.createDataFrame(rows, docs), spark.createDataFrame(labels, schema)).collect()}
    for good in (0, 1):
        got = {r.doc_id: (r.kept, r.rule) for r in Q.judged(spark.createDataFrame(rows + short, docs), spark.createDataFrame(labels + [(i, good) for i, _ in short], schema)).collect()}
        assert {i: got[i] for i in want} == want


def test_judged(spark):
    clean = "the quick river flows over many different stones while amber clouds drift along the valley towards evening and nobody minds it at all"
    rows = [(i, f"{clean} {i} {i * 7}" + (MARKS if i % 4 == 0 else "")) for i in range(200)] + [(900, None), (901, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(5, 1, 0), (None, 0, 0), (7000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.judged(docs, labels).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(200)) and got[900].base_failed and got[901].base_failed and not got[900].kept
    assert got[0].rule > 0 and got[1].rule == 0


def test_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judged(empty(spark), labels).collect() == []
    assert all(r.kept != r.base_failed for r in Q.judged(documents(spark, texts()), labels).collect())


def test_disagreeing_labels_and_repeated_ids(spark):
    clean = "the quick river flows over many different stones while amber clouds drift along the valley towards evening and nobody minds it at all"
    rows = [(i, f"{clean} {i} {i * 7}" + (MARKS if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 4 != 0)) for i in range(200)]
    schema = "doc_id long, quality int"
    more = labels + [(i, 1) for i in range(0, 200, 8)]
    want = {r.doc_id: (r.kept, r.rule) for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, schema)).collect()}
    again = spark.createDataFrame(rows + rows[:50] * 3, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.kept, r.rule) for r in Q.judged(again, spark.createDataFrame(more, schema).repartition(5)).collect()}
    assert got == want


def test_rules_read_as_sql_agree_with_their_arrays(spark):
    """The ordered CASE gives each row the number of the first rule that covers it in Python."""
    found = texts() + [f"w{i} " * 30 + "### " * (i % 9) + "A!" * (i % 5) for i in range(60)]
    rules = [(Q.Condition("symbols_per_char", True, 0.05), Q.Condition("n_words", True, 30.0)), (Q.Condition("upper_per_char", True, 0.02),), (Q.Condition("repeat_share", True, 0.5), Q.Condition("dup_lines", False, 1.0))]
    stats = Q.statistics(documents(spark, found))
    got = stats.select("*", *[F.expr(e).cast("double").alias(n) for n, e in Q.FEATURES.items() if n != "n_words"], Q.rule_number(rules).alias("rule")).collect()
    x = {n: np.array([float(r[n]) for r in got]) for n in Q.FEATURES if n != "dup_lines"} | {"dup_lines": np.array([float(r["n_dup_lines"]) for r in got])}
    want = np.zeros(len(got), dtype=int)
    for i, rule in reversed(list(enumerate(rules, 1))):
        want[Q.covers(rule, x)] = i
    assert [r["rule"] for r in got] == want.tolist() and set(want.tolist()) >= {0, 1, 2}
