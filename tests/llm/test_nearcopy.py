"""Near copies of the pipeline against all pairs by brute force."""

import random

import corpus_pipeline as P
from pitpanel.llm import nearcopy, simhash
from tests.llm.test_operators import ROWS, SCHEMA


def brute_shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Ids that name their component under similarity >= 0.8 on five words or 2 bits, all pairs compared."""
    sets, prints, parent = [brute_shingles(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) or (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {rows[k][0] for k in range(len(rows)) if find(k) == k}


def edited(rng):
    """Texts in groups of near copies; in a chain of edits the ends are less alike than the neighbours."""
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(rng.randrange(1, 6)):
            rows.append(" ".join(words))
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies_beyond_two_bits_leave_the_pipeline(spark):
    rows = edited(random.Random(3))
    want = brute_kept(rows)
    old = {r["doc_id"] for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {r["doc_id"] for r in P.keep_unlike(spark, spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    assert got == want and len(want) < len(old)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = nearcopy.one_per_group(docs)
    want = brute_kept(sorted((r[0], r[1] or "") for r in ROWS if r[0] is not None))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} - {None} == want
    assert any(r["doc_id"] is None for r in kept.collect())
    assert nearcopy.near_groups(docs.limit(0)).count() == 0


def crowd(rng, n):
    """One large group around a common text: some members are close to many others, some to none, many just below 0.8."""
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 4, 6, 8, 12))):
            words[at] = f"x{rng.randrange(10**6)}" if rng.random() < 0.9 else f"w{rng.randrange(3000)}"
        rows.append(" ".join(words[:rng.choice((150, 150, 140, 120))]))
    return rows


def test_a_crowd_of_varied_likeness_is_whole_and_makes_no_square(spark, monkeypatch):
    made = {}
    inner = nearcopy.met

    def counted(texts):
        pairs = nearcopy.materialise(inner(texts), "counted")
        made[len(made)] = (texts.count(), pairs.count())
        return pairs

    monkeypatch.setattr(nearcopy, "met", counted)
    for n in (150, 600):
        rows = list(enumerate(crowd(random.Random(n), n)))
        got = {r["doc_id"] for r in nearcopy.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_kept(rows) and 10 < len(got) < n
    (a, x), (b, y) = made[0], made[1]
    print(made)
    assert b > 2.5 * a and y < 5 * max(x, a)  # candidates grow with the crowd, not with its square


def test_pairs_meet_exactly_where_they_can_reach_the_bound(spark):
    """Every pair of 0.8 is met, and what is met is far from all pairs."""
    rows = crowd(random.Random(9), 120)
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "node long, root long, text string")
    got = {(r["u"], r["v"]) for r in nearcopy.met(df).collect()}
    sets = [brute_shingles(t) for t in rows]
    near = {(a, b) for a in range(len(rows)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert near <= got and len(near) > 50
    assert nearcopy.met(df.limit(0)).count() == 0
