import re

import pytest
from cases import documents, empty, texts

from plumbline.llm.line_dedup import dedup_lines


def brute(rows, least):
    """Lines to delete: those of stretches, of enough words, that equal a stretch that begins earlier; by comparing all pairs of places."""
    units = {d: [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for d, t in rows}
    gone = {d: set() for d, _ in rows}
    for d in units:
        for e in units:
            if e > d:
                continue
            for shift in range(-len(units[e]), len(units[d])):
                if d == e and shift <= 0:
                    continue
                run = []
                for k in range(len(units[d]) + 1):
                    j = k - shift
                    if k < len(units[d]) and 0 <= j < len(units[e]) and units[d][k][1] == units[e][j][1]:
                        run.append(units[d][k])
                    else:
                        if sum(u[2] for u in run) >= least:
                            gone[d] |= {u[0] for u in run}
                        run = []
    return gone


def test_all_that_is_deleted_repeats_and_all_lines_stay_somewhere(spark):
    found = texts(n=40)
    got = {r.doc_id: r for r in dedup_lines(documents(spark, found), 20).collect()}
    want = brute(list(enumerate(found)), 20)
    for i, text in enumerate(found):
        assert set(got[i].deleted) == want[i], i
        if text is None:
            assert got[i].text is None and got[i].n_lines == 0
        else:
            assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])
    left = {x for r in got.values() for x in (r.text or "").split("\n")}
    assert {x for t in found for x in (t or "").split("\n") if x.strip()} <= left


def test_runs_of_several_lines_and_repeats_within_a_text(spark):
    run = "a b c d\ne f g\n\nh i j k"
    rows = [(5, run + "\nend"), (7, "start\n" + run), (8, "a b c d\nx\nh i j k"), (9, f"{run}\nmid\n{run}"), (None, "p q r s t u v w x y z\nonly"), (4, None), (3, "")]
    got = {r.doc_id: r.deleted for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    assert got == {5: [], 7: [1, 2, 4], 8: [], 9: [0, 1, 3, 5, 6, 8], None: [], 4: [], 3: []}


def test_repeated_rows_and_nothing(spark):
    assert dedup_lines(empty(spark)).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e\nf")] * 2 + [(2, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_deleted) for r in dedup_lines(docs, 5).collect()) == [(1, 0), (1, 0), (2, 1)]


def test_a_stock_line_hides_no_run(spark):
    """Every line of the runs is in document 0 in other surroundings: whichever is a window's minimum, its first place isn't the runs'."""
    run = [f"line {x} of the passage" for x in "abcdefg"]
    rows = [(0, "\n".join(f"{x}\nother {i}" for i, x in enumerate(run)))]
    rows += [(7, "\n".join(["start"] + run)), (8, "\n".join(run + ["end"]))]
    rows += [(9, "\n".join(run[:2] + ["mid"] + run[2:] + ["mid"] + run))]
    got = {r.doc_id: r.deleted for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert got == {0: [], 7: [], 8: list(range(7)), 9: [3, 4, 5, 6, 7, *range(9, 16)]}


def test_a_run_goes_to_its_end_though_its_first_window_is_older_and_ends_sooner(spark):
    rows = [(0, "a b c d e\nx"), (7, "q\na b c d e\nf"), (8, "r\na b c d e\nf"), (9, "f\na b c d e\ns")]
    got = {r.doc_id: r.deleted for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {0: [], 7: [1], 8: [1, 2], 9: [1]}


@pytest.mark.parametrize("few", [0, 2, 4, 1000])
def test_texts_of_few_different_lines(spark, few):
    """Where no fingerprint is joined with all its positions, or all are, or some."""
    import random

    for seed in range(2):
        rng = random.Random(seed)
        stock = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(6)] + ["", " \t"]
        found = ["\n".join(rng.choice(stock) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
        got = {r.doc_id: set(r.deleted) for r in dedup_lines(documents(spark, found), 12, few=few).collect()}
        assert got == brute(list(enumerate(found)), 12), seed


def test_a_first_place_elsewhere_hides_no_copy(spark):
    """Documents 2 and 3 share a run; an earlier one has its lines one by one, in other surroundings."""
    run = [" ".join(f"r{i}w{j}" for j in range(10)) for i in range(6)]
    other = lambda name: "\n".join(f"{name} other words {i}\n{line}" for i, line in enumerate(run))
    found = [(1, other("a")), (2, "\n".join(["before two", *run, "after two"])), (3, "\n".join(["before three", *run, "after three"])), (4, other("b"))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(found, "doc_id long, text string")).collect()}
    assert [got[i].n_deleted for i in (1, 2, 3, 4)] == [0, 0, 6, 0] and got[3].text == "before three\nafter three"


def test_very_many_equal_lines(spark):
    got = dedup_lines(spark.createDataFrame([(1, "the same line\n" * 100_000), (2, "x")], "doc_id long, text string")).where("doc_id = 1").first()
    assert (got.n_lines, got.n_deleted, got.text) == (100_001, 99_999, "the same line\n")


def test_long_shared_stretches_of_short_lines(spark):
    """Longer than a match is extended at once, with lines of one word, in few copies and in many."""
    import random

    rng = random.Random(6)
    long = [f"w{rng.randrange(1000)}" if i % 3 else f"u{i} v{i}" for i in range(150)]
    found = ["\n".join([f"start {i}", *long[i % 5 * 7 : 150 - i % 3 * 11], f"end {i}"]) for i in range(7)] + ["\n".join(long[40:90]), "\n".join(long[60:70])]
    for few in (1, 4, 100):
        got = {r.doc_id: set(r.deleted) for r in dedup_lines(documents(spark, found), 12, few=few).collect()}
        assert got == brute(list(enumerate(found)), 12), few


def test_fingerprints_are_few(spark, monkeypatch):
    """Each is posted once. Windows of these documents are of one or two lines, so that well over a third of all lines are minima of some."""
    from plumbline.llm import line_dedup as L

    sizes = {}
    keep = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: sizes.setdefault(name, keep(df, name)))
    monkeypatch.setattr(L, "discard", lambda *_: None)
    L.repeated_runs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    units = sizes["units"].selectExpr("sum(size(units))").first()[0]
    prints = sizes["windows"].where("i >= 0").select("d", "t", "i").distinct().count()
    assert prints == sizes["windows"].where("i >= 0").select("d", "t", "h", "i").distinct().count() < 0.6 * units
