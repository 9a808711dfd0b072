"""Hard negatives against all pairs scored."""

import numpy as np
import pytest

from relscope.llm import hard_negatives

SCHEMA = "vec_id long, label int, x array<long>, score string, anchor_id long"


def plain(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """All scores of every anchor, in whole numbers."""
    out = []
    order = lambda scored: sorted(scored, key=lambda s: (-s[0], s[1]))
    for a, label, x in rows:
        if not anchors(a):
            continue
        others = [(sum(p * q for p, q in zip(x, y, strict=True)), b, own) for b, own, y in rows if b != a]
        for score, positive, _ in order(o for o in others if o[2] == label)[:positives]:
            hard = order(o for o in others if o[2] != label and low * score <= 100 * o[0] <= high * score) if score >= 0 else []
            out += [(a, positive, rank, b, score, s) for rank, (s, b, _) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, parts=3, **kind):
    table = [(i, label, x, "", -i if i is not None else None) for i, label, x in rows]
    found = hard_negatives.mine(spark.createDataFrame(table, SCHEMA).repartition(parts), "vec_id % 10 = 0", **kind)
    return sorted(map(tuple, found.collect()))


def cones(seed, n=240, dim=8, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, dim))
    x = base[rng.integers(0, 6, n)] + rng.choice([0.02, 0.3, 1.0], (n, 1)) * rng.standard_normal((n, dim))
    x[30:110] = x[30]  # a third of all rows are equal
    label = np.where(rng.random(n) < 0.4, 0, rng.integers(0, labels, n))
    return [(i, int(c), np.floor(v * 256).astype(int).tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))]


@pytest.mark.parametrize("shard", [10_000, 30])
def test_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    monkeypatch.setattr(hard_negatives, "BATCH", 5)
    rows = cones(shard)
    want = plain(rows, lambda a: a % 10 == 0)
    assert want and mined(spark, rows) == want


def test_other_shares(spark):
    rows = cones(5, n=120)
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=95) == plain(rows, lambda a: a % 10 == 0, 2, 3, 50, 95)
    with pytest.raises(ValueError):
        mined(spark, rows, low=90, high=80)


def test_whole_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [int(v) for v in rng.integers(-(1 << 30), 1 << 30, 4)]) for i in range(40)]
    got = mined(spark, rows, low=0)
    assert got and got == plain(rows, lambda a: a % 10 == 0, low=0)


def test_odd_rows_take_no_part(spark):
    rows = cones(7, n=60)
    odd = [(None, 0, [1] * 8), (900, None, [1] * 8), (910, 0, None), (920, 0, [None] + [1] * 7), (930, 0, []), (940, 0, [1, 2])]
    assert mined(spark, rows + odd) == plain(rows, lambda a: a % 10 == 0)
    # Of rows of one vec_id the smallest counts; equal ones are one.
    label, x = rows[20][1:]
    assert mined(spark, [*rows, rows[3], rows[10], (20, label, [v + 1 for v in x]), (20, label + 1, x)]) == plain(rows, lambda a: a % 10 == 0)
    assert mined(spark, [(0, 1, [0] * 3), (1, 1, [0] * 3), (2, 2, [0] * 3)]) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(0, 1, [1]), (1, 1, [1])]) == [] and mined(spark, [(0, 1, [1])]) == []
    assert mined(spark, []) == []


def test_brackets_hold():
    rng = np.random.default_rng(11)
    rows, anchors = rng.integers(-300, 300, (200, 6)), rng.integers(-300, 300, (20, 6))
    most = float(np.square(rows).sum(axis=1).max())
    lifted = np.hstack([rows, np.sqrt(most - np.square(rows).sum(axis=1, keepdims=True))])
    space = hard_negatives.Space(hard_negatives.farthest_first(lifted, 12), most, True)
    d = space.distances(rows).astype(np.float32)
    least, largest = space.scores(*hard_negatives._bounds(space.distances(anchors, anchors=True), d, d), np.square(anchors).sum(axis=1))
    score = anchors @ rows.T
    assert (least <= score).all() and (score <= largest).all()
    assert (largest - least).mean() < 1.5 * (score.max() - score.min())
