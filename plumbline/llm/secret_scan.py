"""Secret scans: three base patterns, and character Markov models for other random strings.

Base spans are the leftmost non-overlapping matches of each pattern, less those
whose value is too short. The Markov method adds spans: a token of at least
``MIN_TOKEN`` characters, of letters or digits, away from base spans, is a secret if a
first-order Markov model of random strings gives it a likelihood that exceeds an
ordinary model's by ``threshold`` nats a character.

Both models are trained from samples that the base patterns label: values of
base spans are random strings (mixed with a uniform share, so that strings from
other alphabets aren't punished); tokens outside base spans that aren't themselves in question are ordinary
identifiers. A sample is a share of all documents, of any length, told by a hash: that share for which about
``MARKED_ROWS`` (for base spans) or ``rows`` (for ordinary words) are expected. Nothing is sorted. Scanning covers all of every text.

Positions come from built-in functions alone: ``split`` and ``regexp_extract_all`` walk the
same matches, so lengths of gaps and matches add up to places. They are added up within blocks of matches and then
over blocks, so that the work doesn't grow with the square of a text's matches; a token's characters are split once. Lengths are in code points. Nothing is
shuffled but the training counts.

Null and empty texts have no spans. Every row gives a row, repeated ones too; a
null id stays null. Other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tokens import let

#: The base patterns, and the least characters of their values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"
#: Characters that the models know; others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Documents that ordinary words are learned from, and that base spans are looked for in to train on: about so many.
ROWS = 2_000
MARKED_ROWS = 50_000
UNIFORM = 0.3
THRESHOLD = 1.0
#: Pairs that the single characters' distribution counts for.
BACKOFF = 2.0

#: Matches whose lengths are added up one by one.
BLOCK = 64

_SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def _found(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, kind, end, value) of the pattern's matches in a column; empty where there is none."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")
    )
    hits = F.filter(pieces, lambda x: x["hit"].isNotNull())
    none = F.expr(f"cast(array() as {_SPANS})")

    def placed(block: Column) -> Column:
        """(end of the block, its spans), counted from its begin."""
        start = lambda acc, x: acc["at"] + F.length(x["gap"])
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (start(acc, x) + F.length(x["hit"])).alias("at"),
                F.array_append(acc["out"], F.struct(start(acc, x).alias("s"), F.lit(kind).alias("k"), (start(acc, x) + F.length(x["hit"])).alias("e"), x["value"].alias("v"))).alias("out"),
            ),
        )

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda x: F.struct((x["s"] + by).alias("s"), x["k"].alias("k"), (x["e"] + by).alias("e"), x["v"].alias("v")))

    def of_blocks(all_hits: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_hits) - 1) / BLOCK).cast("int")), lambda b: placed(F.slice(all_hits, b * BLOCK + 1, BLOCK)))
        begins = lambda parts: F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["at"]))
        return F.flatten(let(F.struct(blocks.alias("p")), lambda x: let(F.struct(x["p"].alias("p"), begins(x["p"]).alias("b")), lambda y: F.transform(y["p"], lambda p, i: moved(p["out"], F.get(y["b"], i))))))

    spans = let(hits, lambda h: F.when(F.size(h) <= BLOCK, placed(h)["out"]).otherwise(of_blocks(h)))
    if least:
        spans = F.filter(spans, lambda x: F.length(x["v"]) >= least)
    return F.when(F.col(text).rlike(pattern), spans).otherwise(none)


def with_base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: bool = True) -> DataFrame:
    """(id, text, base, tokens): base spans, and spans of other tokens that the models are asked about (none unless tokens)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.concat(_found("text", ASSIGN, 0, 2, ASSIGN_LEAST), _found("text", ACCESS, 1), _found("text", HEX, 2)).alias("base"), (_found("text", TOKEN, 3) if tokens else F.expr(f"cast(array() as {_SPANS})")).alias("tokens"))
    apart = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return rows.select("id", "text", "base", apart.alias("tokens"))


#: Numbers of the characters in the alphabet, from 1, by their code; 0 for others.
_NUMBERS = [ALPHABET.find(chr(i)) + 1 for i in range(128)]


def _chars(word: Column) -> Column:
    """Numbers of a word's characters."""
    return F.transform(F.split(word, ""), lambda c: F.coalesce(F.get(F.lit(_NUMBERS), F.ascii(c)), F.lit(0)))


def _share(docs: DataFrame, rows: int, of: int, id_col: str, text_col: str) -> DataFrame:
    """About ``rows`` of ``of`` documents: those with small hashes."""
    if rows >= of:
        return docs
    return docs.where(F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1) < F.lit(int((1 << 63) * (rows / of))))


def trained(docs: DataFrame, rows: int = ROWS, marked_rows: int = MARKED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratio, random to ordinary, of each pair of characters: at 63 * first + second."""
    n = len(ALPHABET) + 1
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = some.count()
    marked = _share(some, marked_rows, total, "id", "text").where(F.col("text").rlike(f"{HEX}|{ACCESS}|{ASSIGN}"))
    values = with_base_spans(marked, "id", "text", tokens=False).select(F.lit(1).alias("random"), F.explode(F.transform("base", lambda b: b["v"])).alias("v"))
    words = F.regexp_extract_all(F.regexp_replace("text", f"{TOKEN}|{HEX}|{ACCESS}|{ASSIGN}", " "), F.lit("[A-Za-z0-9_]{3,}"), F.lit(0))
    ordinary = _share(some, rows, total, "id", "text").select(F.lit(0).alias("random"), F.explode(words).alias("v"))
    # A word that occurs often is counted once, with its number.
    both = values.unionByName(ordinary).where(F.length("v") > 1).groupBy("random", "v").agg(F.count("*").alias("times"))
    chars = both.select("random", "times", _chars(F.col("v")).alias("c"))
    pairs = chars.select("random", "times", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    pairs = pairs.groupBy("random", "p.a", "p.b").agg(F.sum("times").alias("n"))
    counts = {0: [[0.0] * n for _ in range(n)], 1: [[0.0] * n for _ in range(n)]}
    for r in pairs.collect():  # 2 * 63 * 63 rows at most
        counts[r["random"]][r["a"]][r["b"]] = r["n"]
    out = []
    # Backed off to single characters: one that a class hardly has is unlikely after any other.
    total = {k: sum(map(sum, c)) for k, c in counts.items()}
    single = {k: [(sum(row[b] for row in c) + 0.5) / (total[k] + 0.5 * n) for b in range(n)] for k, c in counts.items()}
    for a in range(n):
        of = {k: sum(counts[k][a]) for k in counts}
        for b in range(n):
            p = {k: (counts[k][a][b] + BACKOFF * single[k][b]) / (of[k] + BACKOFF) for k in counts}
            out.append(math.log(((1 - UNIFORM) * p[1] + UNIFORM / n) / p[0]))
    return out


def scanned(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of every row."""
    n = len(ALPHABET) + 1
    ratio = F.lit(trained(docs, rows, id_col=id_col, text_col=text_col))

    def score(word: Column) -> Column:
        """The mean over the word's pairs."""
        total = F.aggregate(
            _chars(word),
            F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(ratio, acc["last"] * n + c))).alias("sum")),
            lambda acc: acc["sum"],
        )
        return total / (F.length(word) - 1)

    spans = with_base_spans(docs, id_col, text_col).select("id", "base", F.filter("tokens", lambda x: score(x["v"]) >= threshold).alias("added"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = lambda spans: F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )
    many = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return spans.select(
        F.col("id").alias(id_col),
        many(0).alias("n_assign"),
        many(1).alias("n_access"),
        many(2).alias("n_hex"),
        F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        named(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )
