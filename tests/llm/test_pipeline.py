"""The corpus pipeline as a whole, on a small corpus with rejects, an exact copy and a near copy, against plain Python."""

from collections import Counter

import numpy as np

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from gridloom.llm.mixing import mix, taken_words
    from gridloom.llm.sentencepiece_ops import vocabulary

    draw = np.random.default_rng(4)
    good = [" ".join(draw.choice(["the", "of", "river", "house", "small", "walks"], 80)) for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in draw.choice(["the", "of", "river", "house"], 80)) for _ in range(30)]
    text = dict(enumerate(good + bad))
    text[200], text[201] = text[10], text[20].rpartition(" ")[0] + " end"
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in text.items()]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("$" not in t), 0) for i, t in text.items()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids").collect()

    # Rejects go; of equal texts the largest doc_id stays, of near copies the smallest.
    left = (set(range(60)) - {10}) | {200}
    survivors = spark.createDataFrame([r for r in rows if r[0] in left], DOC)
    times = {r.doc_id: round(r.taken / r.size) for r in taken_words(mix(survivors)).collect()}
    assert set(times) == left
    assert Counter(r.doc_id for r in found) == {i: n for i, n in times.items() if n}
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    assert all(r.ids == library.encode(text[r.doc_id]) for r in found)
    print("copies by source", Counter("ab"[r.doc_id % 2] for r in found), "taken", sorted(Counter(times.values()).items()))


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " y", "en", "a", 1), (2, "another text of the same id", None, "a", None),
        (None, "a text without an id", "en", None, 1), (None, base + " z", "en", "b", 1), (3, None, "en", "b", 1), (4, "", "en", "b", 1), (5, "  ", "en", None, 1),
    ]
    for name, table in (("odd", rows), ("empty", [])):
        spark.createDataFrame(table, DOC).selectExpr("*", "1 AS _key", "'x' AS ids").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        # One of the near copies (1, 2, null) stays, whatever shares an id with them too.
        left = docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            left = stage(spark, left, f"{tmp_path}/{name}")
        texts = [(1, base), (2, "another text of the same id"), (None, "a text without an id"), (4, ""), (5, "  ")]
        found = [(r.doc_id, r.text) for r in left.collect()]
        assert left.columns == docs.columns and sorted(found, key=repr) == sorted(texts if table else [], key=repr)
        # The mixture takes some of them, none without words.
        ran = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()}
        assert ran <= {1, 2, None} and (1 in ran) == bool(table)
