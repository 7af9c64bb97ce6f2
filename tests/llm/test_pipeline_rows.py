"""The pipeline's filtering stages tell rows by all their columns, not by their ids."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key__x int, score double, spans string"


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def table(spark, tmp_path, rows, benchmark):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, "z") for i, t in rows], SCHEMA)
    spark.createDataFrame(benchmark, "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return frame


def texts(frame):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in frame.collect())


def test_repeated_and_null_ids_lose_no_text(spark, tmp_path):
    a, b, c = words(1), words(2), words(3)
    near = a.split()
    near[5] = "other"
    rows = [(1, a), (1, b), (2, " ".join(near)), (3, c), (3, c), (None, words(4)), (None, words(5)), (None, b), (None, None), (None, None), (7, "")]
    docs = table(spark, tmp_path, rows, [(1, c), (2, words(4))])
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert texts(kept) == sorted([(1, a), (1, b), (3, c), (-1, words(4)), (-1, words(5)), (-1, ""), (-1, ""), (7, "")])
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert texts(clean) == sorted((i if i is not None else -1, t or "") for i, t in rows if t not in (c, words(4)))


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = table(spark, tmp_path, [(1, "a")], [(1, "b")]).limit(0)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_secret_removal_without_n_chars_and_with_nulls(spark, tmp_path):
    docs = table(spark, tmp_path, [(1, None), (2, "password = abcdefgh"), (3, "plain")], [])
    got = {r["doc_id"]: r for r in corpus_pipeline.secret_removal(spark, docs, str(tmp_path)).collect()}
    assert got[1]["text"] is None and got[1]["n_chars"] == 0 and got[2]["text"] == "<secret>" and got[2]["n_chars"] == 8 and got[3]["spans"] == "z"
    assert corpus_pipeline.secret_removal(spark, docs.drop("n_chars"), str(tmp_path)).columns == docs.drop("n_chars").columns
