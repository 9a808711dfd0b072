import random

import numpy as np
import public_tokenizers
import pytest
import regex

from relscope.llm import pretoken

PATTERN = regex.compile(public_tokenizers.PATTERN)
ALPHABET = "ab'stredmvl  \n\t  09½٣.,!'é漢字　\x1f\x85\U0010ffff😀"


def test_random_texts_match_the_regex():
    rng = random.Random(3)
    for _ in range(400):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        pieces, counts = pretoken.split_batch(texts)
        want = [PATTERN.findall(t) for t in texts]
        assert pieces == [p for w in want for p in w], texts
        assert list(counts) == [len(w) for w in want]
        for t, w in zip(texts, want, strict=True):
            assert list(pretoken.boundaries(t)) == list(np.cumsum([0] + [len(p) for p in w])[: len(w)])


@pytest.mark.parametrize("library", ["tiktoken", "tokenizers"])
def test_every_code_point_has_the_class_that_the_library_gives_it(library):
    points = np.concatenate([np.arange(33, 0xD800), np.arange(0xE000, 0x110000)])
    found, table = pretoken.asked_classes(points, library), pretoken.class_table(library)
    assert points[found != table[points]].tolist() == []
    assert table[ord("a")] == pretoken.LETTER and table[ord("7")] == pretoken.NUMBER and table[0x2003] == pretoken.WHITE and table[ord("!")] == pretoken.OTHER


def test_cuts_keep_pretokens_and_text():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices(ALPHABET, k=200))
        parts = list(pretoken.cuts(text, 17))
        assert "".join(parts) == text
        assert [p for x in parts for p in PATTERN.findall(x)] == PATTERN.findall(text)


def test_empty_and_one_long_run():
    assert pretoken.split_batch([""])[0] == []
    assert pretoken.split_batch(["", "a" * 100_000, ""])[1].tolist() == [0, 1, 0]
