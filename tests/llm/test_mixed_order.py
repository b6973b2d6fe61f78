"""The mixed order survives the files between the stages and reaches the result of the pipeline."""

import corpus_pipeline as P
from pitpanel.llm import mixing
from pitpanel.sources.workdir import materialise


def test_prefixes_of_the_encoded_rows_hold_the_target_weights(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * (i * 7 % 300), "abbcccc"[i % 7]) for i in range(7000)], "doc_id long, text string, source string")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    mixed = P.mix_sources(spark, docs, None)
    want = [r["doc_id"] for r in mixing.mixed(docs).orderBy("slot", "place").select("doc_id").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    written = materialise(mixed, "mix_sources")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for rows in (written, mixed):
        out = P.encode(spark, rows, None)
        got = [(r["position"], r["doc_id"]) for r in out.select("position", "doc_id").collect()]
        assert got == list(enumerate(want))
    assert len(written.inputFiles()) > 1
    total = {s: n ** 0.7 for s, n in (("a", 1000), ("b", 2000), ("c", 4000))}
    for n in range(320, 3200, 320):  # before the smallest source runs out
        first = [source[i] for _, i in got[:n]]
        for s, w in total.items():
            assert abs(first.count(s) - n * w / sum(total.values())) < 2 * mixing.BLOCK_ROWS
    assert P.encode(spark, docs.limit(0), None).count() == 0
