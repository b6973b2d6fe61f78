"""Registered queries of the corpus operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.llm import audit, bpe, exact, fertility, licenses, lm, mixing, negatives, pieces, pii, simhash, toxicity, warc
from pitpanel.llm.common import documents


def op1_toxicity(spark, sf_dir):
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_bpe(spark, sf_dir):
    return bpe.encoded(documents(spark, sf_dir))


def op3_licenses(spark, sf_dir):
    return licenses.scanned(documents(spark, sf_dir))


def op4_pii(spark, sf_dir):
    return pii.found(documents(spark, sf_dir))


def op5_warc(spark, sf_dir):
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_fertility(spark, sf_dir):
    return fertility.judged(documents(spark, sf_dir))


def op7_simhash(spark, sf_dir):
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark, sf_dir):
    return mixing.mixed(documents(spark, sf_dir).select("doc_id", "source")).drop("row")


def op9_exact_dedup(spark, sf_dir):
    return exact.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_perplexity(spark, sf_dir):
    return lm.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_hard_negatives(spark, sf_dir):
    rows = negatives.relabelled(negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return negatives.mined(rows, F.col("vec_id") % 100 == 0)


def op12_sentencepiece(spark, sf_dir):
    return pieces.encoded(documents(spark, sf_dir))


def op13_filter_audit(spark, sf_dir):
    return audit.audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_licenses, op4_pii, op5_warc, op6_fertility, op7_simhash, op8_mixing, op9_exact_dedup, op10_perplexity,
                                op11_hard_negatives, op12_sentencepiece, op13_filter_audit)}

SQL = {
    "op5_warc": """
SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha1(p) AS payload_digest,
       CASE WHEN octet_length(encode(p)) >= 1000 AND page_id <> max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(p)) >= 1000 AND page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS p FROM pages) WINDOW g AS (PARTITION BY p)""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0e0 * cast(x AS double))) AS q
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, cast(list_inner_product(a.q, b.q) AS bigint) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS int) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (
 SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
m AS (SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM d LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY 1, 2),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (SELECT '' AS o, 0 AS used UNION ALL SELECT o || letter, used + bit FROM p JOIN f ON used & bit = 0),
s AS (SELECT o AS filter_order, cast(step AS int) AS step, f.letter, f.bit, (SELECT coalesce(sum(g.bit), 0)::int FROM f g WHERE instr(o, g.letter) < step) AS before
 FROM (SELECT o, unnest(range(1, 6)) AS step FROM p WHERE length(o) = 5) JOIN f ON f.letter = substring(o, step, 1)),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::bigint AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::bigint AS removed,
 coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::bigint AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::bigint AS unique_fails,
 coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::bigint AS good_lost, coalesce(sum(bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::bigint AS toxic_lost
 FROM s CROSS JOIN c GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) OVER (PARTITION BY part, letter) AS bigint) AS shapley FROM r""",
}
