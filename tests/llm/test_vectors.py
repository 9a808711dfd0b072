"""Vector searches and near-duplicates against all pairs compared."""

import numpy as np
import pytest

from relscope.llm import embedding_dedup, knn, runtime

SCHEMA = "vec_id long, embedding array<float>, label int, score string"
ODD = [(900, None, 0, ""), (901, [0.0] * 8, 0, ""), (902, [float("nan")] + [1.0] * 7, 0, ""), (903, [None] + [1.0] * 7, 0, ""), (904, [float("inf")] + [1.0] * 7, 0, ""), (905, [], 0, ""), (906, [1.0, 2.0], 0, ""), (None, [1.0] * 8, 0, "")]


def near_copies(seed, n=300):
    rng = np.random.default_rng(seed)
    bases = rng.standard_normal((40, 8))
    rows = bases[rng.integers(0, 40, n)] + rng.choice([0, 0.05, 0.3], (n, 1)) * rng.standard_normal((n, 8))
    rows[10:60] = rows[10]
    return rows.astype(np.float32)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    rows = near_copies(1)
    table = [(i, r.tolist(), 0, "") for i, r in enumerate(rows)] + ODD
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(table, SCHEMA).repartition(3)).collect() if r.vec_id is not None}
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    own = np.arange(len(rows))
    for _ in range(len(rows)):
        own = np.array([own[near[i]].min() for i in range(len(rows))])
    for i in range(len(rows)):
        assert got[i].n_links == near[i].sum() - 1
        assert got[i].component_id == own[i] and got[i].kept == (own[i] == i)
    for i in range(900, 907):
        assert tuple(got[i]) == (i, 0, i, True)
    assert len(got) == len(table) - 1


@pytest.mark.parametrize("run, miss", [(8, 1e-12), (400, 1e-4)])
def test_windows_and_long_runs_find_all_links(spark, run, miss):
    """Small windows over many strips, partly shorter than their runs; and one window for all."""
    rows = near_copies(7, 400)
    vecs = spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vecs, run=run, miss=miss).collect()}
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    own = np.arange(len(rows))
    for _ in range(len(rows)):
        own = np.array([own[near[i]].min() for i in range(len(rows))])
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id) == (near[i].sum() - 1, own[i])


def test_places_follow_the_order_of_each_pass(spark):
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 40, (500, 3))
    keyed = spark.createDataFrame([(i, i % 2, k.tolist()) for i, k in enumerate(keys)], "rep long, own long, keys array<long>").repartition(3)
    got = embedding_dedup.ordered(keyed, 500).collect()
    assert len(got) == 1500
    for number in range(3):
        own = sorted((r for r in got if r["pass"] == number), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(500))
        assert [(r.key, r.rep) for r in own] == sorted((int(k), i) for i, k in enumerate(keys[:, number]))


def test_different_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (2, [1.0, 0.1], 0, ""), (3, [0.1, 1.0], 0, ""), (4, [-1.0, 0.0], 0, "")]
    got = {(r.vec_id, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(empty).collect() == []
    assert knn.search(empty, empty).collect() == []


def test_windows_meet_across_partitions(spark):
    rows = near_copies(2, 200)
    many = spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)], SCHEMA)
    before = runtime.shards(spark)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        one = sorted(map(tuple, embedding_dedup.near_duplicates(many).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == sorted(map(tuple, embedding_dedup.near_duplicates(many).collect()))


@pytest.mark.parametrize("scale", [False, True])
def test_search_has_recall(spark, monkeypatch, scale):
    monkeypatch.setattr(knn, "SHARD", 700)
    monkeypatch.setattr(knn, "BLOCK", 20)
    monkeypatch.setattr(knn, "SHARING", 5)
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((1500, 8)).astype(np.float32)
    if scale:
        rows *= rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    rows[100:140] = rows[100]
    vecs = spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)] + ODD, SCHEMA).repartition(3)
    got = knn.search(vecs, vecs.where("vec_id % 20 = 0"), 20, 32, 6, 12).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, own in found.items():
        own.sort()
        score = rows.astype(float) @ rows[q].astype(float)
        want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:20]
        assert [r for r, *_ in own] == list(range(1, 21))
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i in want} & {i for _, i, _ in own})
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("n, dim, spread", [(6000, 64, 0.25), (6000, 64, 1.0), (3000, 384, 0.0), (3000, 384, 0.5)])
def test_recall_of_other_norms_and_dimensions(spark, monkeypatch, n, dim, spread):
    monkeypatch.setattr(knn, "SHARD", 2500)
    rng = np.random.default_rng(n + dim)
    rows = rng.standard_normal((n, dim))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows = (rows * np.exp(spread * rng.standard_normal((n, 1)))).astype(np.float32)
    vecs = spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    found = {}
    for r in knn.search(vecs, vecs.where("vec_id % 60 = 0"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    score = rows[::60].astype(float) @ rows.T.astype(float)
    score[np.arange(len(score)), np.arange(0, n, 60)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(found[60 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.9


def test_queries_pass_held_shards_in_one_block(spark, monkeypatch):
    rows = near_copies(6, 400)
    vecs = spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    monkeypatch.setattr(knn, "SHARD", 50)
    one = sorted(map(tuple, knn.search(vecs, vecs, 5, first=1000).collect()))
    monkeypatch.setattr(knn, "SHARD", 1000)
    monkeypatch.setattr(knn, "BLOCK", 30)
    assert one == sorted(map(tuple, knn.search(vecs, vecs, 5, first=1000).collect()))


def test_equal_vectors_score_alike(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 300)
    rows = np.random.default_rng(4).standard_normal((800, 384)).astype(np.float32)
    rows[100:300] = rows[100]
    vecs = spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)] + [(7, rows[7].tolist(), 0, "")], SCHEMA).repartition(3)
    found = {}
    for r in knn.search(vecs, vecs.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(120, 300, 20):
        own = sorted(found[q])
        assert [i for _, i, _ in own] == [i for i in range(100, 121) if i != q][:20] and len({s for *_, s in own}) == 1


def test_fewer_candidates_than_asked(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [0.5, 0.0], 0, ""), (20, [0.5, 0.0], 0, "")], SCHEMA)
    got = sorted(tuple(r) for r in knn.search(vecs, vecs.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.25)]


@pytest.mark.parametrize("sizes", [{}, {"run": 150}])
def test_dense_group_hides_no_links(spark, sizes):
    rng = np.random.default_rng(5)
    spread = lambda n: (x := rng.standard_normal((n, 64))) / np.linalg.norm(x, axis=1, keepdims=True)
    cone = np.sqrt(0.8) * spread(1) + np.sqrt(0.2) * spread(3000)
    bases = np.vstack([cone[:300], spread(300)])
    bases /= np.linalg.norm(bases, axis=1, keepdims=True)
    aside = spread(600)
    aside -= (aside * bases).sum(axis=1, keepdims=True) * bases
    others = 0.901 * bases + 0.433 * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    rows = np.vstack([cone, bases[300:], others]).astype(np.float32)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)], SCHEMA), **sizes).collect()
    assert links.sum() > 400 and all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * links.sum()


def test_passes_follow_the_rows():
    assert embedding_dedup.plan(2048, 0.9, 2048, 1e-4) == (0, 1)
    before = 0
    for n in (5_000, 50_000, 500_000, 2_000_000):
        bits, passes = embedding_dedup.plan(n, 0.9, 2048, 1e-4)
        assert n / 2**bits <= 2048 and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes <= 1e-4 and passes > before
        before = passes


def test_search_has_recall_beside_a_dense_group(spark):
    rng = np.random.default_rng(1)
    spread = lambda n: (x := rng.standard_normal((n, 64))) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = np.vstack([np.sqrt(0.97) * spread(1) + np.sqrt(0.03) * spread(666), spread(1334)]).astype(np.float32)
    vecs = spark.createDataFrame([(i, r.tolist(), 0, "") for i, r in enumerate(rows)], SCHEMA)
    found = {}
    for r in knn.search(vecs, vecs.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = {}
    for q, own in found.items():
        score = rows.astype(float) @ rows[q].astype(float)
        score[q] = -np.inf
        hits.setdefault(q < 666, []).append(len(own & set(np.argsort(-score)[:20].tolist())) / 20)
    assert len(found) == 100 and np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9
