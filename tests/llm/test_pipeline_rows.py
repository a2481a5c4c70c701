import random

import corpus_pipeline


def test_decisions_reach_rows_without_id_and_spare_others_of_an_id(spark, tmp_path):
    text = lambda n, seed: " ".join(f"w{random.Random(seed * 1000 + k).randrange(4000)}" for k in range(n))
    item, near, bad = text(20, 9077), text(100, 500), " idiot scum moron"
    rows = [(i, text(30, i) + (bad if i % 4 == 0 else "")) for i in range(120)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(120)]
    gone = [(None, text(30, 601) + bad), (None, "so " + item), (None, text(30, 1)), (None, near + " tail"), (301, text(30, 602) + bad), (302, text(30, 2).upper()), (303, item + " yes"), (None, text(30, 5)), (304, near + " end")]
    kept = [(200, near), (301, text(30, 701)), (302, text(30, 702)), (303, text(30, 703)), (304, text(30, 704)), (None, text(30, 705))]
    gone = [x for x in gone if x[0] != 302]  # of equal texts the largest id stays
    docs = [(i, t, "en", "s", n) for n, (i, t) in enumerate(rows + gone + kept + [(302, text(30, 702))])]
    random.Random(4).shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = sorted(str(x["doc_id"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == sorted([str(i) for i in range(120) if i % 4] + [str(i) for i, _ in kept])
