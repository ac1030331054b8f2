"""Line dedup and near-dedup, one after the other."""

import random


def test_recurring_lines_keep_a_copy(spark):
    import corpus_pipeline

    rng = random.Random(3)

    def text(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))

    line, body = "This passage recurs over many documents.", text(300)
    docs = [(1, f"{line}\n{text(200)}"), (2, f"{text(200)}\n{line}"), (3, body), (4, f"{line}\n{body}"), (5, text(200)), (5, text(250)), (None, text(50))]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    lined = corpus_pipeline.distinct_lines(spark, df, "")
    left = corpus_pipeline.distinct_documents(spark, lined, "").collect()
    assert sum(line in r["text"] for r in left) == 1
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [1, 2, 4, 5] and sum(r["doc_id"] is None for r in left) == 1
    assert [r["n_chars"] for r in left if r["doc_id"] == 5] == [len(docs[5][1])]


def test_clashing_columns(spark):
    import corpus_pipeline

    rows = [(1, "one text here", 13, "a", 1, 2), (1, "one text here longer", 20, "b", 3, 4), (2, None, None, "c", 5, 6), (None, "no id", 5, "d", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _copy string, _rank0 int, _again int")
    left = corpus_pipeline.distinct_documents(spark, df, "")
    assert left.columns == df.columns and sorted(r["_copy"] for r in left.collect()) == ["b", "c", "d"]


def test_columns_named_like_counts_pass(spark):
    import corpus_pipeline

    line = "This passage recurs over many documents."
    df = spark.createDataFrame([(i, f"own {i}\n{line}", 9, 70 + i, "x", 80 + i) for i in range(4)], "doc_id long, text string, n_chars long, n_lines int, lang string, n_dropped int")
    got = corpus_pipeline.distinct_lines(spark, df, "")
    assert got.columns == df.columns and sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"].count(line)) for r in got.collect()) == [(i, 70 + i, 80 + i, int(i == 3)) for i in range(4)]


def test_quality_takes_any_columns(spark):
    from rastermill.llm import quality

    rows = [(i, "some plain words in a row " * (i % 5 + 1), 1, 2, "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, known int, _known int, id string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels, threshold=-1.0)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(rows)


def test_few_rows_to_calibrate_on(spark):
    """Below the bound all labelled rows calibrate: the curve has as many rows as there are labels."""
    import numpy as np

    from rastermill.llm import quality

    texts = [(i, ("words " * 20 if i % 2 else "%$# " * 20) + str(i)) for i in range(80)]
    stats = quality.text_statistics(spark.createDataFrame(texts, "doc_id long, text string"))
    usable = quality.usable_labels(spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int"))
    assert 0 < usable.where("checks").count() < quality.LEAST_CHECKS
    model = quality.fit_quality(stats, usable, n_features=40)
    got = {r["id"]: model.score(np.array([r["x"]]))[0] for r in stats.collect()}
    assert all((s > 0.7) == bool(i % 2) for i, s in got.items())
