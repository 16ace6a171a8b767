"""Counts against the libraries themselves on whole texts; what the cache is asked for and what it keeps."""

import public_tokenizers
import pytest

from plumbline.llm import token_counts as K
from plumbline.llm.queries import op11_digest_cache
from tests.llm import cases


def direct(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        return [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    if name.endswith(".model"):
        import sentencepiece

        return [len(e) for e in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(encoding.encode_ordinary(t)) for t in texts]


HARD = [
    "a  b\n\n  c \t d ", " lead", "trail ", "   ", "it's we'll 'S x'", " nbsp  wide　x", "\x1c a\x1d b\x85c", "one<|endoftext|>two <|endoftext|> <|endoftext|>",
    "<|ENDOFTEXT|> <|startoftext|>", "日本語のテキスト 中文", "ﬁ é Ａ", "x" * 5_000, "a b " * 20_000, "​ zero​width", "tab\tnew\r\nline\x0bv\x0cf", "...!!! ??? #$%",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_counts_are_the_library_s(name):
    texts = HARD + [t or "" for t in cases.texts()]
    counter = K.Counter(public_tokenizers.path(name))
    assert counter(texts) == direct(name, texts)
    assert [counter([t])[0] for t in texts] == direct(name, texts)
    assert counter.apart == (name == "byte_bpe_50k.json")


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 5)
    counter = K.Counter(K.default_tokenizer())
    texts = [t or "" for t in cases.texts()] * 3
    assert counter(texts) == direct("byte_bpe_50k.json", texts)
    assert [counter([t])[0] for t in texts] == direct("byte_bpe_50k.json", texts)


def collected(df):
    return sorted(map(tuple, df.collect()))


def expected(rows, name="byte_bpe_50k.json"):
    texts = [r[1] or "" for r in rows]
    return sorted((r[0], len(t.encode()), n, n > 1024) for r, t, n in zip(rows, texts, direct(name, texts), strict=True))


@pytest.mark.parametrize("few", [0, 1_000])
def test_only_misses_are_tokenized(spark, tmp_path, few):
    rows = cases.rows(HARD + cases.texts())
    rows += rows[:5]
    cache = f"file://{tmp_path}/cache"
    old = spark.createDataFrame(rows[:30], cases.SCHEMA)
    assert collected(K.counted(old, cache, few=few)) == expected(rows[:30])
    folder = f"{cache}/tokenizer={K.version(K.default_tokenizer())}"
    kept = lambda: spark.read.schema(K.CACHE).parquet(folder)
    before = kept().count()
    assert before == len({r[1] or "" for r in rows[:30]})
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    assert collected(K.counted(docs, cache, few=few)) == expected(rows)
    assert kept().count() == kept().select("digest").distinct().count() == len({r[1] or "" for r in rows})
    # Stored counts are believed: nothing is tokenized again, and nothing is appended.
    false = f"file://{tmp_path}/false"
    kept().selectExpr("digest", "n_tokens + 5000 as n_tokens").union(kept().selectExpr("digest", "n_tokens + 5000 as n_tokens")).write.parquet(f"{false}/tokenizer={K.version(K.default_tokenizer())}")
    assert collected(K.counted(docs, false, few=few)) == sorted((i, b, n + 5000, True) for i, b, n, _ in expected(rows))
    assert spark.read.parquet(false).count() == 2 * kept().count()


def test_versions_and_normalising(spark, tmp_path):
    name = "word_bpe_49k.json"
    rows = cases.rows(HARD + cases.texts() + ["Some  Text\n", "some text", " SOME TEXT"])
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    cache = f"file://{tmp_path}/cache"
    K.counted(docs, cache)
    assert collected(K.counted(docs, cache, public_tokenizers.path(name), normalise=K.folded)) == expected(rows, name)
    sizes = {r["tokenizer"]: r["count"] for r in spark.read.option("basePath", cache).parquet(cache).groupBy("tokenizer").count().collect()}
    assert len(sizes) == 2 and sizes[K.version(public_tokenizers.path(name))] < sizes[K.version(K.default_tokenizer())]


def test_query_on_whole_table(spark):
    place = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()
    assert collected(op11_digest_cache(spark, place)) == expected([tuple(r) for r in texts])


def test_null_ids_and_empty_table(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    assert K.counted(cases.empty(spark), cache).collect() == [] and not (tmp_path / "cache").exists()
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in K.counted(docs, cache).collect()) == [0, 2, 2]
