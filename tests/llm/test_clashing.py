"""Columns whose names the operators use inside change nothing: each result is that of the bare documents."""

import pytest
from cases import texts
from pyspark.sql import functions as F

from plumbline.llm.classifier_chain import scored
from plumbline.llm.conversation_trie import prefix_trie, sequences
from plumbline.llm.decontamination import decontaminate
from plumbline.llm.importance_resampling import resampled
from plumbline.llm.jaccard_join import jaccard_join
from plumbline.llm.kd_sharding import kd_shards
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.packing import pack
from plumbline.llm.periodic_runs import periodic_runs, with_repeats
from plumbline.llm.quality_rules import judged
from plumbline.llm.secret_scan import scanned
from plumbline.llm.token_counts import counted

NAMES = "row node d t h i q b e w n s id key item spans items part level top cut class digest content n_tokens block chunks text0 length start words_h words_n order place".split()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def both(spark):
    found = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts(n=40))]
    bare = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long")
    return bare, bare.select("*", *[F.lit(f"{n} {k}").alias(n) if k % 2 else F.lit(k).alias(n) for k, n in enumerate(NAMES)])


OPERATORS = {
    "chain": lambda d, more: scored(d, more["labels"], {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}),
    "jaccard": lambda d, more: jaccard_join(d, 3, 80),
    "packing": lambda d, more: pack(d, capacity=64).groupBy("doc_id", "piece", "start", "length", "ids_crc32").agg(F.count("*").alias("same")),
    "decontamination": lambda d, more: decontaminate(d, more["items"]),
    "resampling": lambda d, more: resampled(d, more["labels"]),
    "rules": lambda d, more: judged(d, more["labels"]),
    "shards": lambda d, more: kd_shards(d, 4, ["n_chars", "doc_id"], ["lang", "source"]).select("doc_id", "shard"),
    "lines": lambda d, more: dedup_lines(d, 10),
    "secrets": lambda d, more: scanned(d),
    "tokens": lambda d, more: counted(d, f"{more['folder']}/{len(d.columns)}"),
    "runs": lambda d, more: periodic_runs(with_repeats(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_change_nothing(spark, tmp_path, name):
    bare, full = both(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "of the")], "item_id long, text string")
    more = {"labels": labels, "items": items, "folder": f"file://{tmp_path}"}
    assert rows(OPERATORS[name](bare, more)) == rows(OPERATORS[name](full, more))


def test_conversations(spark):
    found = [(c, t, "user", f"turn {t} {c % 3}") for c in range(12) for t in range(c % 4)]
    bare = spark.createDataFrame(found, "conv_id long, turn long, role string, text string")
    full = bare.select("*", *[F.lit(k).alias(n) for k, n in enumerate([*NAMES, "digests", "sizes", "turns", "least", "ends", "parent"])])
    assert rows(prefix_trie(sequences(bare), 3, 10)) == rows(prefix_trie(sequences(full), 3, 10))
