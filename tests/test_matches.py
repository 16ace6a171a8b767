"""Items of an oracle against findings: the automaton against ``in`` over all pairs."""

import random

import pytest

from plumbline.operators import evaluate

FINDING = "normalized_rank bigint, source_path string, column string, details string, error_type string, table_name string, disposition string, summary string, item string, pattern string"


def made(rng, findings, items):
    word = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, n)))
    f = [(i, word(9), rng.choice([None, word(8)]), rng.choice([None, word(60)]), f"k{rng.randrange(3)}", f"t{rng.randrange(2)}", rng.choice(["weak_anomaly", "not_applicable"]), "s", "x", "y") for i in range(findings)]
    o = [(f"o{i}", f"k{rng.randrange(3)}", rng.choice(["", None, word(4)]), rng.choice(["", "t0"]), rng.choice([[], None, [word(7), word(9)], [""], ["", word(5)]] + [[word(8)]] * 6), "weak_anomaly") for i in range(items)]
    return f, o


def brute(findings, items):
    out = set()
    for rank, source, column, details, kind, table, tier, *_ in findings:
        blob = " ".join(x for x in (column, details) if x is not None)
        for name, of_kind, part, of_table, columns, _ in items:
            if tier != "not_applicable" and kind == of_kind and (part or "") in source and (not of_table or of_table == table) and (not columns or any(c in blob for c in columns)):
                out.add((name, rank))
    return out


@pytest.mark.parametrize("shared", [1 << 23, 20_000])
def test_ten_thousand_items(spark, monkeypatch, shared):
    monkeypatch.setattr(evaluate, "SHARED_BYTES", shared * 10)
    findings, items = made(random.Random(shared), 150, 10_000)
    got = evaluate.matches(spark.createDataFrame(findings, FINDING), spark.createDataFrame(items, evaluate.ORACLE)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(findings, items)


def test_nothing_asked_or_found(spark):
    findings, items = made(random.Random(1), 5, 5)
    none = spark.createDataFrame([], FINDING), spark.createDataFrame([], evaluate.ORACLE)
    assert evaluate.matches(none[0], spark.createDataFrame(items, evaluate.ORACLE)).collect() == []
    assert evaluate.matches(spark.createDataFrame(findings, FINDING), none[1]).collect() == []
    assert {r.status for r in evaluate.score_oracle(none[0], spark.createDataFrame(items, evaluate.ORACLE)).collect()} == {"miss"}
