import random

import corpus_pipeline
from orbweave.llm import queries


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(3)
    text = lambda n, seed: " ".join(f"w{random.Random(seed * 1000 + k).randrange(4000)}" for k in range(n))
    item = text(20, 9077)
    rows, labels = [], []
    for i in range(120):
        toxic = i % 4 == 0
        rows.append((i, text(r.randrange(20, 60), i) + (" idiot scum moron" if toxic else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    near = text(100, 500)
    rows += [(200, text(50, 400)), (201, text(50, 400).upper()), (202, near), (203, near + " tail"), (204, "so " + item + " it goes"), (205, None), (206, "")]
    rows = [x if len(x) == 5 else (*x, "en", "s", 0) for x in rows]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {i for i in range(120) if i % 4} | {201, 202, 206}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "benchmark decontamination", "bpe"]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE) <= set(queries.QUERIES)
