import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from cases import documents, empty, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import WordIds, best_two_fit, default_tokenizer, pack


def placed(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    bins: dict[int, list] = {}
    taken = Counter()
    for length, first, n, sequence, times, offset in best_two_fit(counts, capacity):
        assert first == taken[length]
        taken[length] += n
        for i in range(n):
            bins.setdefault(sequence + i % times, []).append((offset + length * (i // times), length))
    assert taken == Counter(lengths)
    return bins


def one_by_one(lengths, capacity):
    """The heuristic as it is stated, bin by bin."""
    left = Counter(lengths)
    bins = []
    while left:
        gap, got = capacity, []
        while (fits := [x for x in left if x <= gap]) and (x := max(fits)):
            got.append(x)
            gap -= x
            left[x] -= 1
            left += Counter()
        if gap:
            small = got[-1]
            pairs = [(a + b, a) for a in left for b in left if b <= a and a + b <= gap + small and (a != b or left[a] > 1)]
            if pairs and max(pairs)[0] > small:
                total, _ = max(pairs)
                a = min(a for t, a in pairs if t == total)
                got[-1:] = [a, total - a]
                left.subtract([a, total - a])
                left[small] += 1
                left += Counter()
        bins.append(sum(got))
    return bins


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_sequences_are_gapless_and_as_many_as_the_heuristic_makes(lengths):
    bins = placed(lengths, 20)
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 20
    assert sorted(sum(x for _, x in p) for p in bins.values()) == sorted(one_by_one(lengths, 20))


def test_ids_are_the_tokenizers(spark):
    found = [t or "" for t in texts()] + ["It's 12.5%...  NBSP \x1c ctĺ <|ENDOFTEXT|> <|endoftext|> Ünïted, ſs' 'S ’s 中文字 a.b, ..", "wow!!! ok.,", "'", "ab²! x²,, é$$$ a'! don't. a_b_ 7,, —, été—!", "İstanbul ΑΣ Σ."]
    plain = Tokenizer.from_file(default_tokenizer())
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in found]
    assert list(WordIds(default_tokenizer())(found)) == want


def test_slices_of_a_batch():
    found = [f"Ünï {'é' * i} CAPS wörd{i}!! \n" * 3 for i in range(50)]
    ids = WordIds(default_tokenizer())
    want = list(ids(found))
    every = pa.array(found)
    for a in range(0, 50, 7):
        got, at = ids.of_texts(every.slice(a, 7))
        assert [got[x:y].tobytes() for x, y in zip(at[:-1], at[1:])] == want[a : a + 7]


def test_words_that_never_came_again_are_forgotten():
    plain = Tokenizer.from_file(default_tokenizer())
    ids = WordIds(default_tokenizer(), remembered=8)
    for found in (["one two", "three"], ["one four,", "five"], ["one six seven!!", "eight nine ten"], ["one two three"]):
        assert list(ids(found)) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in found]


def test_pack(spark):
    found = texts() + ["long text " * 9000]
    got = pack(documents(spark, found), with_ids=True).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(found)}
    sequences: dict[int, list] = {}
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert bytes(r.ids) == part and zlib.crc32(part) == r.ids_crc32 and r.start == 4096 * r.piece
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096


def test_empty_and_null(spark):
    assert pack(empty(spark)).collect() == []
    got = pack(spark.createDataFrame([(None, None), (3, None), (3, None)], "doc_id long, text string")).collect()
    assert [r.length for r in got] == [1, 1, 1] and sorted(r.offset for r in got) == [0, 1, 2] and len({r.sequence_id for r in got}) == 1
