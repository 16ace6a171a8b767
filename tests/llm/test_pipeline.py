import random
import re

import corpus_pipeline as P
import pytest

from plumbline.llm.importance_resampling import resampled

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for name, stage in P.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name.replace(" ", "_")))
        docs = spark.read.parquet(str(folder / name.replace(" ", "_")))
        kept.append(docs)
    return kept


def test_stages_return_documents(stages):
    for docs in stages[:-1]:
        assert docs.columns == P.COLUMNS and docs.count() == docs.select("doc_id").distinct().count()
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_decisions_take_effect(spark, stages):
    from test_jaccard_join import brute

    texts = [(r.doc_id, r.text) for r in stages[2].orderBy("doc_id").collect()]
    roots = {texts[i][0] for i, _, root, _ in brute([t for _, t in texts], 5, 80) if root == i}
    assert {r.doc_id for r in stages[3].collect()} == roots
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    leaky = {r.doc_id for r in stages[3].collect() if any(tuple(w[i : i + 8]) in windows for w in [words(r.text)] for i in range(len(w) - 7))}
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()} - leaky
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_run(spark, stages):
    assert P.run(spark, DATA).count() == stages[-1].count()


def test_null_and_repeated_ids_stage_by_stage(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 5) for _ in range(n))
    item, base, other = words(12), words(60), words(60)
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    told = [
        (None, base), (3, base + " end"), (4, base), (4, base), (4, other), (4, other),  # one of base, a null id's, and one of other
        (5, None), (None, None), (6, words(40)), (None, words(40)), (7, words(9) + " " + item), (None, words(9) + " " + item + " z"), (7, words(50)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in told], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert rows(P.quality_classifier(spark, docs, str(tmp_path))) == sorted(told, key=repr)  # no label: all are selected
    got = rows(P.near_duplicates(spark, docs, str(tmp_path)))
    assert got == sorted([told[0], told[4], *told[6:]], key=repr)
    assert rows(P.benchmark_decontamination(spark, docs, str(tmp_path))) == sorted([x for x in told if item not in (x[1] or "")], key=repr)


def test_quality_is_decided_by_row(spark, tmp_path):
    good, bad = "clear words of a good text " * 40, "junk ### $$$ junk " * 40
    rows = [(i, f"{good if i % 2 else bad} {i}", "en", "s", 1) for i in range(40)] + [(i, f"{bad if i % 2 else good} again {i}", "en", "s", 1) for i in range(40)] + [(None, bad, "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 12, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = sorted(((r.doc_id, r.text) for r in resampled(docs, labels, carry=["text"]).where("selected").collect()), key=repr)
    assert 0 < len(want) < len(rows)
    assert sorted(((r.doc_id, r.text) for r in P.quality_classifier(spark, docs, str(tmp_path)).collect()), key=repr) == want


def test_short_items_of_the_benchmark_count(spark, tmp_path):
    items = [("a", "five words are not many"), ("b", "this one has seven words in all")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["so: Five words, are not many!", "and this one has seven words in all of it", "five words are not quite many", "words in all", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.benchmark_decontamination(spark, docs, str(tmp_path)).collect()) == [2, 3, 4, 5]
