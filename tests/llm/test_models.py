import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty, sentence, texts
from pyspark.sql import functions as F

from plumbline.llm.classifier_chain import _features, fit, scored, trained
from plumbline.llm.importance_resampling import BUCKETS, PRIOR, resampled
from plumbline.llm.textkernel import Words, alphanumeric, words_and_marks


def categories():
    return {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def corpus(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        poor, toxic = i % 5 == 0, i % 7 == 0
        text = sentence(rng, 60)
        if poor:
            text = " ".join(w + "&&&" for w in text.split())
        if toxic:
            text += " " + " ".join(rng.choice(["grobik", "snarfel", "vlaxo"]) + rng.choice(["", "en", "us"]) for _ in range(4))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not poor), int(toxic)))
    labels += [(None, 1, 1), (2, 1, None), (10_000, 0, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_unlabelled_rows(spark):
    rows, docs, labels = corpus(spark)
    got = {r.doc_id: r for r in scored(docs, labels, categories()).collect()}
    held = [i for i, _ in rows if i % 2]
    assert np.mean([got[i].toxic == (i % 7 == 0) for i in held]) > 0.97
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_poor <= 1 for r in got.values())


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    before = rng.normal(size=(500, 1))
    truth = before[:, 0] > 0.3
    model = fit(np.empty(0, dtype=int), np.empty(0, dtype=int), before, truth, 1)
    logit = model.logit(np.empty(0, dtype=int), np.empty(0, dtype=int), 500, before)
    assert model.before[0] > 0.5 and ((logit > 0) == truth).mean() > 0.8


def test_chain_edges(spark):
    _, _, labels = corpus(spark)
    assert scored(empty(spark), labels, categories()).collect() == []
    none = labels.limit(0)
    got = scored(documents(spark, texts()), none, categories()).collect()
    assert len(got) == len(texts()) and not any(r.toxic for r in got)
    odd = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert len(scored(odd, labels, categories()).collect()) == 3


def test_resampling_keeps_good_and_rejects_poor(spark):
    rows, docs, labels = corpus(spark)
    got = {r.doc_id: r for r in resampled(docs, labels).collect()}
    poor = [i for i, _ in rows if i % 5 == 0]
    good = [i for i, _ in rows if i % 5]
    assert np.mean([got[i].selected for i in poor]) < 0.1 and np.mean([got[i].selected for i in good]) > 0.8


def test_disagreeing_labels_and_repeated_ids(spark):
    """The positive label counts; of an id's texts the smallest; the order of rows doesn't matter."""
    rows, docs, labels = corpus(spark)
    more = labels.unionByName(labels.where("doc_id < 40").withColumn("toxic", F.lit(0)))
    again = docs.unionByName(docs.where("doc_id < 40").withColumn("text", F.concat(F.lit("zzz "), "text")))
    want = {r.doc_id: r.p_toxic for r in scored(docs, labels, categories()).collect()}
    got = scored(again.repartition(5), more.repartition(3), categories()).collect()
    assert {r.doc_id: r.p_toxic for r in got if r.doc_id >= 40} == {i: p for i, p in want.items() if i >= 40}


def test_scores_of_the_chain_one_text_at_a_time(spark):
    """Brute force: each text's features looked up in the trained weights, category by category."""
    rows, docs, labels = corpus(spark)
    rows += [(900, None), (901, ""), (902, "vlaxo " * 5_000)]
    chain = trained(docs, labels, categories())
    got = {r.doc_id: (r.p_poor, r.p_toxic) for r in scored(spark.createDataFrame(rows, "doc_id long, text string"), labels, categories()).collect()}
    for i, text in rows:
        before, p = [], []
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        _, bucket = _features(Words(raw, np.array([0, len(raw)]), alphanumeric()))
        found = [int(chain.number[b]) for b in bucket if chain.number[b] >= 0]
        for model in chain.models:
            logit = model.bias + sum(model.weights[f] for f in found) + sum(w * x for w, x in zip(model.before, before))
            before.append(min(8, max(-8, logit)))
            p.append(1 / (1 + math.exp(-logit)))
        assert got[i] == pytest.approx(p), i


def test_importance_is_the_ratio_of_the_two_models(spark):
    """Brute force: n-grams counted in Python give each document's weight, and k."""
    rows, docs, labels = corpus(spark, 120)
    rows = rows + [(300, None), (301, ""), (302, "one"), (303, "a, b! " * 3_000), (7, rows[7][1])]
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    grams = {}
    for n, (i, text) in enumerate(rows):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        words = Words(raw, np.array([0, len(raw)]), words_and_marks(), lower=False)
        tokens = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^\s0-9A-Za-z_\x80-\U0010ffff]+", text or "")
        assert len(words.hash) == len(tokens)
        assert len({*words.hash.tolist()}) == len(set(tokens))
        pairs = [int(x) for x in words.grams(2)[: max(0, len(tokens) - 1)]]
        grams[n] = [int(h) % BUCKETS for h in [*words.hash.tolist(), *pairs]]
    raw, target = Counter(), Counter()
    for n, (i, _) in enumerate(rows):
        raw.update(grams[n])
        if i in good:
            target.update(grams[n])
    share = sum(target.values()) / sum(raw.values())
    weight = [sum(math.log((target[g] + PRIOR) / (raw[g] * share + PRIOR)) for g in grams[n]) for n in range(len(rows))]
    got = resampled(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert sorted(r.log_weight for r in got) == pytest.approx(sorted(weight))
    k = round(sum(min(1.0, math.exp(w)) for w in weight))
    cut = sorted((r.gumbel_key for r in got), reverse=True)[k - 1]
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in got if r.gumbel_key >= cut}


def test_resampling_takes_the_k_largest_keys(spark):
    _, docs, labels = corpus(spark)
    got = resampled(docs, labels, k=37).collect()
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert {r.gumbel_key for r in got if r.selected} == set(keys[:37])


def test_resampling_edges(spark):
    _, _, labels = corpus(spark)
    assert resampled(empty(spark), labels).collect() == []
    assert all(r.selected for r in resampled(documents(spark, texts()), labels.limit(0)).collect())
    odd = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = resampled(odd, labels).collect()
    assert len(got) == 3 and len({r.gumbel_key for r in got if r.doc_id == 1}) == 1
