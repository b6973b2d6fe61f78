"""Texts without a character beside enough others for a threshold of their language."""

from pitpanel.llm import lm


def test_empty_texts_of_a_language_with_a_threshold(spark):
    rows = [(i, f"plain words number {i} and so on", "en") for i in range(lm.LEAST_TEXTS)] + [(60, "", "en"), (61, None, "en"), (62, " \n", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    for limit in (lm.SHARD_ENTRIES, 60):
        got = {r["doc_id"]: r for r in lm.judged(docs, labels, shard_entries=limit).collect()}
        assert len(got) == len(rows)
        assert all(got[i]["threshold"] > 1 for i in range(lm.LEAST_TEXTS))
        assert all((got[i]["n_chars"], got[i]["perplexity"], got[i]["threshold"], got[i]["kept"]) == (0, None, None, False) for i in (60, 61, 62))
