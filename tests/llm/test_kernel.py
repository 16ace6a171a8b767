import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import textkernel as T


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


TEXT = st.text(alphabet=st.sampled_from(list("abAB 12\n\t-_,.é漢#")), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for pattern, classes in ((r"[^\x20\x09-\x0D]+", T.space_separated()), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", T.alphanumeric())):
        hashes: dict[str, int] = {}
        for j, data, offsets in T.runs(pa.array(texts, pa.string()), run_bytes=25):
            words = T.Words(data, offsets, classes)
            for k in range(len(offsets) - 1):
                want = re.findall(pattern, lower(texts[j + k] or ""))
                have = words.hash[words.first[k] : words.first[k + 1]].tolist()
                assert len(have) == len(want)
                for w, h in zip(want, have, strict=True):
                    assert hashes.setdefault(w, h) == h
        assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_shingle_sets(texts):
    seen: dict[tuple, int] = {}
    for text, found in zip(texts, T.shingle_sets(pa.array(texts, pa.string()), 3, T.space_separated()), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        want = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())
        assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()
        if len(want) == 1:
            assert seen.setdefault(next(iter(want)), int(found[0])) == int(found[0])


def test_one_text_longer_than_a_run():
    text = "word " * 600_000
    (found,) = T.shingle_sets(pa.array([text]), 3, T.space_separated())
    assert len(found) == 1


def thue_morse(n):
    """Two words of 2**n letters on which any polynomial hash modulo 2**64 with an odd base agrees, from n = 10 or 11 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_crafted_words_do_not_collide():
    for n in range(3, 17):
        pair = thue_morse(n)
        for lower in (True, False):
            (_, data, offsets), *_ = T.runs(pa.array([" ".join(pair)]), run_bytes=1 << 30)
            words = T.Words(data, offsets, T.space_separated(), lower=lower)
            assert len(words.hash) == 2 and words.hash[0] != words.hash[1]
            assert words.prefix(1 << n)[0] == words.hash[0] and words.prefix(3)[0] != words.prefix(3)[1]
    # as words of a gram
    a, b = (" ".join(x) for x in thue_morse(12))
    assert len({int(s[0]) for s in T.shingle_sets(pa.array([a, b]), 5_000, T.space_separated())}) == 2


def test_hashes_are_of_the_word_alone():
    """Words of all lengths about a lane's, with bytes of zero, at any place."""
    found = [c * n + tail for n in range(0, 20) for c in ("a", "b", "\0", "é") for tail in ("", "x", "\0", "\0\0")]
    found = list(dict.fromkeys(w for w in found if w))
    seen: dict[str, int] = {}
    for pad in range(9):
        text = " " * pad + " ".join(found)
        (_, data, offsets), *_ = T.runs(pa.array([text]))
        words = T.Words(data, offsets, T.space_separated())
        for w, h in zip(found, words.hash.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(found)
