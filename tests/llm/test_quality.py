"""Perplexities against a Kneser-Ney model in plain Python."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest

from relscope.llm import quality

GOOD = ["the cat sat on the mat.", "a dog and a cat ran home.", "on the mat the dog sat.", "home is where the cat is."] * 6
ROWS = [(i, t, "en", "x") for i, t in enumerate(GOOD)] + [(100, "%%% $$$ @@@ ###", "en", "x"), (101, None, "en", "x"), (102, "", None, "x"), (103, "the mat and the cat", None, "x"), (104, "zq" * 300, "fr", "x"), (None, "the dog sat", "en", "x"), (0, GOOD[0], "en", "x")]
SCHEMA = "doc_id long, text string, lang string, gram string"


def grams(text):
    s = "\n\n" + text + "\n"
    return [s[k : k + 3] for k in range(len(s) - 2)]


def model(texts):
    levels = {3: Counter(g for t in texts for g in grams(t))}
    for n in (2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    prob = {}

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5] * 3
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 1) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]

    for n, counts in levels.items():
        d, total, mass = discounts(counts), defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3) - 1]
        prob[n] = (counts, d, total, mass)

    def p(g):
        if not g:
            return 1 / 65536
        counts, d, total, mass = prob[len(g)]
        h, low = g[:-1], p(g[1:])
        if h not in total:
            return low
        c = counts.get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total[h] + mass[h] / total[h] * low

    return p


def test_perplexities_and_thresholds(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(3, 1, 0), (100, 0, 0), (None, 1, 0), (50, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(docs, labels, 0.9).collect()
    assert len(got) == len(ROWS)
    trusted = [t for i, t, *_ in ROWS if i is not None and i < 20]
    p = model(trusted)
    want = {}
    for i, t, *_ in ROWS:
        if t:
            want[i] = math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t)))
    by = {r.doc_id: r for r in got}
    for i, x in want.items():
        assert by[i].perplexity == pytest.approx(x, rel=1e-9)
    steps = sorted(math.ceil(math.log(want[i]) / quality.STEP) for i in [*range(20), 0])
    limit = math.exp(steps[math.ceil(0.9 * len(steps)) - 1] * quality.STEP)
    assert by[7].threshold == pytest.approx(limit) and by[104].threshold == pytest.approx(limit)
    assert by[100].rejected and by[104].rejected and not by[101].rejected and not by[102].rejected
    assert by[101].perplexity is None


def test_probabilities_sum_to_one():
    p = model(GOOD)
    letters = {c for t in GOOD for c in "\n" + t}
    seen = sum(p("th" + c) for c in letters)
    assert 0.99 < seen < 1.0001


def test_without_labels_nothing_goes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert not any(r.rejected for r in quality.classified(docs, labels).collect())
    assert quality.accepted(docs, labels).count() == len(ROWS)
    assert quality.classified(docs.limit(0), labels).collect() == []


def test_runs_of_a_word_or_line_are_junk(spark):
    rng = random.Random(6)
    words = ["the", "cat", "dog", "house", "runs", "over", "green", "hill", "small", "river", "and", "tree"]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    rows = [(i, prose(80), "en") for i in range(200)] + [(200, "Xq!", "en")]
    junk = [(300, "the " * 200, "en"), (301, "the\n" * 200, "en"), (302, "cat runs\n" * 200, "en"), (303, prose(20) + " house" * 300, None)]
    got = quality.classified(spark.createDataFrame(rows + junk + [(400, prose(70), "en")], "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(201)], "doc_id long, quality int"))
    rejected = {r.doc_id for r in got.collect() if r.rejected}
    assert {300, 301, 302, 303} <= rejected and 400 not in rejected and len(rejected) <= 6


def test_marks():
    assert quality.marked("a a  a\na b b. b.") == "a" + quality.AGAIN * 3 + " b b." + quality.AGAIN
    assert quality.marked("a b\na b\na b c") == "a b" + quality.AGAIN + "\na b c"


def test_counts_of_parts_are_those_of_the_text(monkeypatch):
    whole = lambda text: {sum(ord(c) << 16 * k for k, c in enumerate(reversed(g))): n for g, n in Counter(grams(text)).items()}
    texts = ["the cat sat on the mat", "a", "abababababab", "x" * 20]
    for size in (1, 2, 7, 500_000):
        monkeypatch.setattr(quality, "PART_CHARS", size)
        for text in texts:
            keys, n = quality.gram_counts(text)
            assert keys.tolist() == sorted(keys.tolist()) and dict(zip(keys.tolist(), n.tolist(), strict=True)) == whole(text)
        (block,) = quality._extract((k, "en", 0, t) for k, t in enumerate(["", *texts]))
        assert len(block.ids) == 5 and block.extra == [0, *map(len, texts)]
        got = {(int(o), int(block.keys[c])): int(f) for o, c, f in zip(block.owner, block.code, block.freq, strict=True)}
        assert got == {(k + 1, g): n for k, t in enumerate(texts) for g, n in whole(t).items()}


def test_blocks_take_memory_for_distinct_grams_only():
    rng = random.Random(9)
    text = lambda first, letters, n: "".join(map(chr, rng.choices(range(first, first + letters), k=n)))
    rows = [(k, "en", 0, text(97, 8, 3300)) for k in range(800)] + [(800 + k, "en", 0, text(200, 60, 3300)) for k in range(10)]
    for rows, most in ((rows, 100e6), ([(0, "en", 0, text(97, 20, 4_000_000))], 100e6)):
        tracemalloc.start()
        (block,) = quality._extract(iter(rows))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert block.freq.sum() == sum(len(t) + 1 for *_, t in rows)
        assert peak < most
