from tidewater.llm.simhash import drop_near_copies


def test_other_texts_of_an_id_stay(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a text that has no copy at all"), (3, None), (4, ""), (None, "a b c d e f g"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in drop_near_copies(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)
