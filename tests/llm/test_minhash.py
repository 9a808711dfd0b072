"""Components against all pairs compared with plain sets."""

import random
import re

import pytest

from relscope.llm import graphs, minhash, shingles

SCHEMA = "doc_id long, text string, component_id string, rep string"


def words_of(text):
    return re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text, n):
    w = words_of(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [set_of(t, n) for _, t in rows]
    own = {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and None not in (rows[a][0], rows[b][0]):
                x, y = own[rows[a][0]], own[rows[b][0]]
                own = {i: min(x, y) if c in (x, y) else c for i, c in own.items()}
    return [(i, len(s), own[i], None if i is None else own[i] == i) for (i, _), s in zip(rows, sets, strict=True)]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "ONE  Two"), (5, "one two three"), (None, "one two"), (None, None)]
    passage = rng.choices(words, k=60)
    bases = [rng.choices(words, k=rng.randint(3, 150)) for _ in range(12)]
    for i in range(10, 130):
        text = list(rng.choice(bases)) + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, "  ".join(text) + rng.choice(["", "\n"])))
    rows += [rows[20], (21, rows[60][1]), (21, "a text of its own under a used id")]
    return rows


@pytest.mark.parametrize("seed,tile", [(1, 256), (2, 3)])
def test_components(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "WIDTH", 50)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in minhash.near_duplicates(docs, 4).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 4, 80), key=str)


def test_hot_keys_and_shuffled_texts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "CELL", 2)
    monkeypatch.setattr(graphs.parts, "__defaults__", (3,))
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = [tuple(r) for r in minhash.near_duplicates(docs, 5).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 5, 80), key=str)


def test_other_similarities(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = [tuple(r) for r in minhash.near_duplicates(docs, 3, 60).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 3, 60), key=str)


def test_least_shared_values():
    assert minhash.least(32, 80)[32] == 14 and minhash.least(32, 60)[32] < 14 and minhash.least(32, 80)[1] == 1


def test_documents_that_share_a_passage_are_no_family(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " end") for i in range(0, 300, 3)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = [tuple(r) for r in minhash.near_duplicates(docs, 4).collect()]
    assert sorted(got) == sorted(brute(rows, 4, 80))


def test_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sets_have_the_sizes_of_plain_sets():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abAB é\t\n\x0b漢", k=rng.randint(0, 60))) for _ in range(300)]
    for n in (1, 4):
        for t, s in zip(texts, shingles.shingle_sets([t.encode() for t in texts], n), strict=True):
            assert len(s) == len(set_of(t, n))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
