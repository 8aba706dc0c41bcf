"""Documents that share a reference."""

from threadloom.operators import search


def test_last_of_one_reference_speaks(spark):
    rows = [(1, "a", "message", "user", "t1", "apple apple pie"), (2, "b", "message", "user", "t2", "apple tart"), (3, "a", "message", "tool", "t3", "plum apple")]
    docs = spark.createDataFrame(rows, "doc_ord long, ref string, kind string, role string, title string, text string")
    own = {r.doc_ord: r.score for r in search.substring(docs, "apple").collect()}
    got = {r.doc_ord: r for r in search.search(docs, "apple", "substring").collect()}
    tool = search.ROLE_WEIGHTS["tool"]
    assert {i: r.score for i, r in got.items()} == {1: own[1] * tool, 2: own[2] * search.ROLE_WEIGHTS["user"], 3: own[3] * tool}
    assert [got[1].role, got[1].title, got[1].text, got[1].preview] == [got[3].role, got[3].title, got[3].text, got[3].preview]
    assert got[1].text == "plum apple"
