from pyspark.sql import functions as F

from orbweave.llm import language_id


def test_the_most_frequent_language_is_counted_over_all_training_rows(table):
    rows = [(i, "the thing", "en") for i in range(9)] + [(20 + i, "das ding", "de") for i in range(4)] + [(90, "ЖЖЖ", None)]
    docs = table(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), sample=3)
    assert model.languages == ["en", "de"]
    assert [tuple(r) for r in language_id.identify(docs.where("doc_id = 90"), model).collect()] == [(90, "en", 0.0)]
