from orbweave.llm import url_filter


def test_own_labels_go_through_the_filter(spark, table, monkeypatch):
    rows = [(1, "https://a.cheap-pills.org/x"), (2, "https://cheap-pills.example.com/en/7"), (3, "https://pillsbury.org/"), (4, "https://x.org/cheap-pills"), (5, None)]
    pages = table(rows, "page_id long, url string")
    judged = lambda: {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rules_frame(spark)).collect()}
    assert judged() == {1: (None, "block"), 2: ("example.com/en/7", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow")}
    # an empty filter lets nothing pass, own labels neither
    build = url_filter.build_filter
    monkeypatch.setattr(url_filter, "build_filter", lambda rules, blocks: build(rules, blocks).where("false"))
    assert set(judged().values()) == {(None, "allow")}
