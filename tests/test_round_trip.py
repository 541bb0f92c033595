"""JSON lines bring back every row with its whole text."""

from placeloom.plans import reference


def test_whole_round_trip(spark):
    texts = ["plain", 'say "hi"\\n', "two\nlines\r\nand\ttabs", "é 漢 \u2028 \x07", "", None, "long " * 20_000]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    back = reference.whole_round_trip(spark, docs)
    assert back.columns == docs.columns and sorted(back.collect()) == sorted(docs.collect())
