import pytest

from orbweave.llm import decontaminate
from orbweave.llm.rows import KEY, keyed

REPEATED = [(1, "a b c"), (1, "x y"), (1, "x y"), (None, "x y z"), (None, "q"), (2, "a b x y")]


@pytest.mark.parametrize("stored", [False, True])
def test_decontamination_gives_a_row_each(table, spark, tmp_path, stored):
    docs = table(REPEATED)
    if stored:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        assert keyed(docs).select(KEY).distinct().count() == len(REPEATED) and keyed(docs).columns == [*docs.columns, KEY]
    items = spark.createDataFrame([(1, "a b"), (2, "x y"), (3, "b c")], "item_id long, text string")
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.digest(decontaminate.find_contamination(docs, items)).collect())
    assert out == [("1", 2, 2, 1), ("1", 2, 2, 1), ("1", 3, 3, 2), ("2", 4, 4, 2), ("None", 1, 0, 0), ("None", 3, 2, 1)]
