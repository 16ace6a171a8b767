"""Token counts from a cache of digests: only content that no run has seen is tokenized.

The cache is a folder of Parquet files: digest of the content, number of tokens; one
subfolder for each tokenizer version, which is itself a digest: of the vocabulary file, the library's name and its version.

1.  Each document's content is normalised and digested (SHA-256), natively. Normalising must not change a count: by default it only makes
    null empty; ``folded`` is for tokenizers that fold case and white space themselves.
2.  The distinct digests are joined to the cache. What it lacks are the misses.
3.  One content of each missing digest is tokenized. If the misses are few (counted, at most ``FEW``), they are broadcast so that only their
    contents are shuffled; otherwise contents are first combined by digest where they are read, so
    that copies, however many, travel as few rows.
4.  New counts are appended to the cache by one committed write: a lost executor repeats its tasks, a lost job
    leaves the cache as it was. Two jobs may append the same digest; readers take one.
5.  Documents are joined to the counts of their digests.

Defined results: a null or empty text has 0 bytes and 0 tokens; ids may be null or repeated, each row is counted; texts are never
cut short; an empty table leaves the cache alone; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from importlib import metadata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import stored

#: Misses up to which their digests (32 bytes each) are broadcast.
FEW = 200_000
#: Pieces of texts whose counts a worker remembers; bytes of texts that are tokenized at once.
REMEMBERED, TOGETHER = 400_000, 1 << 20
CACHE = "digest binary, n_tokens long"
_LIBRARIES = {".json": "tokenizers", ".model": "sentencepiece", ".tiktoken": "tiktoken"}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def version(path: str) -> str:
    """The digest of a tokenizer version: its file, and the library that reads it."""
    library = _LIBRARIES[os.path.splitext(path)[1]]
    state = hashlib.sha256(f"{library} {metadata.version(library)}\n".encode())
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            state.update(block)
    return state.hexdigest()


def folded(text: Column) -> Column:
    """A text in small letters (A-Z only) with single spaces, for tokenizers that drop case and white space. With a sign of special tokens it stays as it is."""
    low = F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t\\n\\r]+", " "))
    return F.when(F.contains(text, F.lit("<|")), text).otherwise(low)


class Counter:
    """Counts of tokens as the library gives them: no begin, end or padding, special tokens' strings in texts as its default treats them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.apart = False
        kind = os.path.splitext(path)[1]
        if kind == ".json":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.counts = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.apart = self._apart(json.loads(tokenizer.to_str()))
        elif kind == ".model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding("counted", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.counts = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        self.known: dict[str, int] = {}

    @staticmethod
    def _apart(told: dict) -> bool:
        """Whether tokens never go on from another character into white space, and a piece that begins there stands for itself.

        So it is for byte-level pairs by the usual pattern, without a
        normalizer, an added first space, or special tokens that hold or take white space.
        """
        first = told["pre_tokenizer"] or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in told["added_tokens"])
        return first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and told["normalizer"] is None and plain

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set(pieces).difference(self.known))
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            self.known.update(zip(some, self.counts(some), strict=True))

    def _count(self, text: str) -> int:
        pieces = re.findall(r"\s*\S+|\s+", text)
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            return sum(map(self.known.__getitem__, pieces))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return self.counts(texts)
        if sum(map(len, texts)) > 100_000:
            return [self._count(t) for t in texts]
        every = [re.findall(r"\s*\S+|\s+", t) for t in texts]
        missing = [p for ps in every for p in ps if p not in self.known]
        if missing:
            self._learn(missing if len(self.known) <= REMEMBERED else [p for ps in every for p in ps])
        return [sum(map(self.known.__getitem__, ps)) for ps in every]


_counters: dict[str, Counter] = {}


def _tokenized(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or default_tokenizer()
        if place not in _counters:
            _counters[place] = Counter(place)
        counter = _counters[place]
        for batch in batches:
            size = np.array([len(t) for t in batch.column(1).to_pylist()]) if batch.num_rows else np.empty(0, dtype=np.int64)
            part = (np.cumsum(size) - size) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            found: list[int] = []
            for a, b in zip(edges, edges[1:], strict=False):
                found += counter(batch.column(1).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def counted(
    docs: DataFrame,
    cache: str,
    tokenizer: str | None = None,
    limit: int = 1024,
    normalise: Callable[[Column], Column] = lambda text: text,
    few: int = FEW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; the cache's folder gets the counts that it lacked."""
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/tokenizer={version(tokenizer or default_tokenizer())}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), normalise(text).alias("content"))
    digest = F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("digest")
    told = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    contents = texts.select(digest, "content")
    hits = None
    if _exists(spark, folder):
        kept = spark.read.schema(CACHE).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        looked_up = stored(told.select("digest").distinct().join(kept, "digest", "left"), "looked-up")
        hits, misses = looked_up.where("n_tokens is not null"), looked_up.where("n_tokens is null").select("digest")
        n = misses.count()
        if n <= few:
            contents = contents.join(F.broadcast(misses), "digest", "left_semi")
    once = contents.groupBy("digest").agg(F.first("content").alias("content"))
    if hits is not None and n > few:
        # An outer join, which stays above the grouping: its rows are combined before they travel.
        once = once.join(hits.select("digest", F.lit(True).alias("held")), "digest", "left").where("held is null").select("digest", "content")
    counts = stored(once.mapInArrow(_tokenized(tokenizer), CACHE), "new-counts")
    if not counts.isEmpty():
        counts.write.mode("append").parquet(folder)
    if hits is not None:
        counts = hits.unionByName(counts)
    return told.join(counts.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
