"""The pipeline over a small corpus: what stays, what is masked, what is packed."""

import random

import corpus_pipeline
from relscope.llm import minhash


def corpus():
    rng = random.Random(4)
    words = ["the", "cat", "dog", "house", "runs", "over", "green", "hill", "small", "river", "and", "tree"]
    rows = [(i, " ".join(rng.choices(words, k=60)) + ".", "en", "s") for i in range(60)]
    rows[30] = (30, rows[30][1] + " mail a.b@c.org", "en", "s")
    rows += [(100, rows[5][1], "en", "s"), (101, rows[6][1][:-1] + " hill.", "en", "s"), (102, "%%% $$$ ### @@@ !!! %%% $$$", "en", "s"), (104, None, None, None), (105, "", "en", "s")]
    rows += [(None, rows[9][1], "en", "s"), rows[8]]
    return [(*r, len(r[1] or "")) for r in rows]


def test_pipeline(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    ids = sorted((r.doc_id for r in good.select("doc_id").collect()), key=str)
    assert 102 not in ids and {30, 100, 101, 104, 105, None} <= set(ids) and ids.count(8) == 2
    single = corpus_pipeline.STAGES[1][1](spark, good, str(tmp_path))
    assert single.columns == docs.columns
    ids = sorted((r.doc_id for r in single.select("doc_id").collect()), key=str)
    assert ids.count(8) == 1 and not {100, 101} & set(ids) and {104, 105, None} <= set(ids)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(ids)
    assert sum(r.length for r in out) == sum(len(bytes(r.ids)) // 4 for r in out)
    assert all(r.offset + r.length <= 2048 for r in out)


def test_two_texts_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (2, "g h i j k l", "x")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in minhash.deduplicated(docs).collect()] == [1]
