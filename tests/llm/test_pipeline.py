"""The whole pipeline against a brute-force version, and its stages on an awkward table."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from pitpanel.llm import toxicity
from tests.llm.test_nearcopy import brute_kept
from tests.llm.test_operators import ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


def brute(rows, toxic):
    """(doc_id, text) of the documents that the filtering stages keep."""
    civil = [(i, t or "") for i, t in rows if i not in toxic]
    last = {}
    for i, t in civil:
        last[t] = max(i, last.get(t, i))
    distinct = sorted((i, t) for t, i in last.items())
    kept = brute_kept(distinct)
    return [row for row in distinct if row[0] in kept]


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.scored(docs, labels).filter("predicted = 1").collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], toxic)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert sorted(got) == [i for i, _ in want] and len(want) < docs.count()
    for i, t in want:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_take_awkward_rows_and_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], len(r[1] or ""), *r[4:]) for r in ROWS], SCHEMA.replace("source string,", "source string, n_chars int,"))
    for rows in (docs, docs.filter(F.lit(False))):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == rows.columns
            assert out.count() <= rows.count()
            rows = out
        assert P.STAGES[-1][1](spark, rows, SF).count() == rows.count()
