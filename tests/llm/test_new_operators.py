"""Hard negatives, SentencePiece and the filter audit against brute-force versions on awkward tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.llm import audit, negatives, pieces
from tests.llm.test_operators import ROWS, SCHEMA, TEXTS

MODEL = "piece_bpe_32k.model"


# hard negatives

def exact(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b))


@pytest.mark.parametrize("high", [1, 3, 160, 30_000, 1 << 20, 1 << 26])
def test_packed_products_are_exact(high):
    rng = np.random.default_rng(high)
    for _ in range(6):
        n, m, d = (int(x) for x in rng.integers(0, 40, 3))
        c, a = rng.integers(-high, high + 1, (n, d)), rng.integers(-high, high + 1, (m, d))
        want = np.array([[exact(x, y) for y in c] for x in a], np.int64).reshape(m, n)
        assert (negatives.scores(a, c) == want).all()
    ends = np.array([[high] * 8, [-high] * 8])
    assert negatives.scores(ends, ends).tolist() == [[8 * high * high, -8 * high * high], [-8 * high * high, 8 * high * high]]


def brute_mined(rows, every, k=5):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
            ok[i] = (label, [max(-2 ** 26, min(2 ** 26, math.floor(256 * x))) for x in v])
    out = []
    for a in (i for i in ok if i % every == 0):
        s = sorted(((-exact(ok[a][1], v), i, label) for i, (label, v) in ok.items() if i != a))
        for p, i, label in [x for x in s if x[2] == ok[a][0]][:k]:
            hard = [(n, j) for n, j, other in s if other != ok[a][0] and 80 * -p <= 100 * -n <= 100 * -p][:k]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(hard)]
    return sorted(out)


def vectors(rng, n):
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 0.2) for _ in range(6)]
        if i % 9 == 0:
            v = [0.1, 0.2, 0.3, 0.2, 0.1, 0.0]  # very many equal vectors
        rows.append((i, v, rng.randrange(10)))
    rows += [(n, None, 1), (n + 1, [0.1, None, 0.2], 1), (n + 2, [float("nan")] * 6, 2), (n + 3, [float("inf")] * 6, 2), (n + 4, [0.5] * 6, None), (None, [0.5] * 6, 3),
             (n + 5, [], 4), (n + 6, [0.5, 0.25], 5), (n + 7, [1e6, -1e6, 3.0, 0.0, 0.0, 0.1], 6), (-20, [0.3] * 6, 7), (-7, [0.3] * 6, -4)]
    return rows


@pytest.mark.parametrize("limits", [(2048, 512, 64 << 20), (16, 8, 256)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(negatives, "ROUND_BYTES", limits[2])  # the small one needs several rounds
    rows = vectors(random.Random(5), 300)
    df = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<double>, label int").withColumn("q", F.lit("clash")).withColumn("number", F.lit(1)).repartition(5)
    own = negatives.relabelled(negatives.quantised(df))
    got = negatives.mined(own, F.col("vec_id") % 20 == 0, candidates=limits[0], anchors=limits[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_mined(rows, 20)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mined(negatives.quantised(empty), F.col("vec_id") % 100 == 0).count() == 0
    lonely = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.mined(negatives.quantised(lonely), F.col("vec_id") % 100 == 0).count() == 0


# SentencePiece

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def test_random_strings_equal_the_library(library):
    import public_tokenizers
    p, rng = pieces.pieces(public_tokenizers.path(MODEL)), random.Random(2)
    letters = " ▁\t\n\x00ab cdetheingé漢🙂ﬁ　 ​AＡ.,12<s></s>́⁇"
    block = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(4000)] + ["a" * 300, "x y" * 400, "漢字" * 90, " " * 70]
    for text, ids in zip(block, p.encode_block(block)):
        want = library.encode(text, add_eos=True)
        assert ids.tolist() == want, text
        assert p.decode(ids) == library.decode(want), text
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randrange(0, 8))]
        assert p.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_blocks_are_cut_and_crossing_models_are_read_whole(library, monkeypatch):
    import public_tokenizers
    p = pieces.Pieces(public_tokenizers.path(MODEL))
    block = [t or "" for t in TEXTS]
    want = [library.encode(t, add_eos=True) for t in block]
    monkeypatch.setattr(pieces, "BLOCK_CHARACTERS", 50)
    assert [x.tolist() for x in p.encode_block(block)] == want
    p.crossing = True
    assert [x.tolist() for x in p.encode_block(block)] == want


def test_sentencepiece_rows(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in pieces.encoded(docs, with_tokens=True).collect()}
    want = set()
    for r in ROWS:
        ids = library.encode(r[1] or "", add_eos=True)
        want.add((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), tuple(ids)))
    assert got == want
    assert pieces.encoded(docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and pieces.encoded(docs).count() == len(ROWS)
    assert pieces.encoded(docs.filter(F.lit(False))).count() == 0


# filter audit

def fails(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    return {x for x, bad in (("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)),
                             ("D", bool(re.search("[#$%&*|]", text)))) if bad}


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        f = fails(t or "") | ({"E"} if i is not None and i > first[t or ""] else set())
        docs.append((lang or "", f, (i, "good") in labels, (i, "toxic") in labels))
    out, sums = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for k, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                earlier = sum(x in d[1] and bool(d[1] & set(order[:k - 1])) for d in own)
                out[part, order, k] = [len(left), len(gone), earlier, sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                sums[part, x] = sums.get((part, x), 0) + len(gone)
    return {key: (*v, sums[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


AUDIT_TEXTS = [None, "", "Same text", "Same text", "BIG WORDS", "some $ sign", "word " * 150, " ".join(f"w{i}" for i in range(120)), "\x0b\x0c\r\t\n ", "é漢🙂 ÀÉ", "a b" * 80, " ".join(f"W{i}" for i in range(120)),
               " ".join(f"w{i}" for i in range(120))]


@pytest.mark.parametrize("blocks", [2000, 1])
def test_audit_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(audit, "PARTS", blocks)
    rows = [(i, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(AUDIT_TEXTS * 2)] + [(None, "Same text", "en"), (None, None, "fr"), (2, "Same text", "en"), (6, "word " * 150, "de")]
    marks = [(2, 1, 0), (3, None, 1), (7, 1, 1), (20, 0, None), (None, 1, 1), (2, 0, 0), (99, 1, 1)]
    labels = {(i, "good") for i, q, _ in marks if q == 1 and i is not None} | {(i, "toxic") for i, _, t in marks if t == 1 and i is not None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "n": F.lit(9), "mask": F.lit(1), "h": F.lit(b"c")}).repartition(3)
    got = audit.audited(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = got.collect()
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in found} == brute_audit(rows, labels) and len(found) == 600 * 4


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audited(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
