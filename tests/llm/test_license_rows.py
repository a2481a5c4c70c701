from orbweave.llm import license_scan


def test_rows_of_one_id_are_judged_by_themselves(table):
    rows = [(None, "gnu general public"), (None, "gnu general public"), (7, "the mit"), (7, "the mit license"), (7, "gnu general public")]
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["base_labels"]) for r in license_scan.digest(license_scan.scan(table(rows))).collect())
    assert out == [("7", 2, 0, ""), ("7", 3, 0, ""), ("7", 3, 1, "mit"), ("None", 3, 0, ""), ("None", 3, 0, "")]
