"""Repeated rows, very long texts, empty tables and columns of clashing names."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from relscope.llm import embedding_dedup, knn, minhash, pii, url_filters, warc

VECTORS = "vec_id long, embedding array<float>, label int"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_vectors(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (7, [1.0, 0.0], 1), (9, [0.0, 1.0], 0), (9, [0.0, 1.0], 2), (None, [1.0, 0.0], 0)]
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == {(5, 2, 5, True): 2, (7, 2, 5, False): 1, (9, 1, 9, True): 2, (None, 0, None, None): 1}
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (20, [2.0, 0.0], 0), (20, [2.0, 0.0], 0), (20, [3.0, 0.0], 0), (21, [3.0, 0.0], 0)]
    vecs = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in knn.search(vecs, vecs.where("vec_id = 0")).collect())
    assert got == [(0, 1, 20, 3.0), (0, 2, 21, 3.0)]


def test_repeated_pages(spark, tmp_path):
    link = '<a href="http://bad.net/">'
    rows = [(1, "http://a.edu/", link)] * 3 + [(2, "http://a.edu/", link), (3, "http://bad.net/es/", ""), (4, "http://b.org/", "x"), (4, "http://b.org/", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.op3_warc(spark, str(tmp_path)).collect()]
    assert Counter(got)[1, "revisit", 2] == 3 and Counter(got)[2, "response", None] == 1
    assert len([g for g in got if g[0] == 4]) == 2 and any(g[1] == "response" for g in got if g[0] == 4)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    own = url_filters.op6_url_filters(spark, str(tmp_path))
    want = Counter(db.execute(f"SELECT {', '.join(own.columns)} FROM ({url_filters.oracle()})").fetchall())
    assert Counter(tuple(r) for r in own.collect()) == want and want[1, "a.edu", "/", None, "block"] == 3


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    near = [w if k % 1000 else "other" for k, w in enumerate(words)]
    far = [f"v{rng.randrange(50_000)}" for _ in range(150_000)]
    docs = spark.createDataFrame([(3, " ".join(words)), (4, " ".join(near)), (5, " ".join(far)), (6, "x" * 2_000_000), (7, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=4).collect()}
    assert got == {3: (3, True), 4: (3, False), 5: (5, True), 6: (6, True), 7: (6, False)}
    found = pii.personal_data(spark.createDataFrame([(1, "x " * 200_000 + "a@b.org")] * 2 + [(2, "7" * 300_000)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_email) for r in found) == [(1, 1), (1, 1), (2, 0)] and len({r.spans for r in found if r.doc_id == 1}) == 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    names = ["ids", "gram", "set_id", "spans", "component_id", "rep", "kept", "n", "_gone", "_row", "quality", "verdict", "key", "part"]
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "cat", "runs", "over", "a", "hill", "and", "back"], k=40)), "en", "s", 0) for i in range(30)]
    rows += [(50, rows[3][1], "en", "s", 0), (51, "write to x@y.org " + rows[4][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit(f"own {c}") for c in names})
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns, kept = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == columns
    rows = kept.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in names)
    assert 50 not in {r.doc_id for r in rows} and all("x@y.org" not in r.text for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in rows}
