"""Every corpus operator against a brute-force version on a small awkward table, and on an empty one."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.llm import bpe, exact, fertility, licenses, lm, mixing, pii, simhash, toxicity, warc

LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(20000))
SHARED = "the quick brown fox jumps over the lazy dog and runs through the dark forest to the river bank"
TEXTS = [
    None, "", " \n\t", "a", "Same text here", "Same text here", "same text here", "x" * 5000, LONG, LONG, "mail me at a.b@c.example.org or +1 (612) 555-4887, card 4111 1111 1111 1111, 10.0.0.1 not 10.0.0.999",
    SHARED, SHARED + ".", SHARED.upper(), "Released under the MIT License.\nother line", "é漢字🙂 naïve <|endoftext|> 'll   x", "line\nline\nline\n" * 30, "1" * 3000, "@" * 300, "Licensed under CC BY-NC 4.0.",
]
ROWS = [(i if i != 3 else None, t, "en" if i % 3 else None, None if i == 5 else f"s{i % 4}", 7, i, True, "c") for i, t in enumerate(TEXTS)] + [(4, "Same text here", "en", "s0", 7, 4, True, "c")]
SCHEMA = "doc_id long, text string, lang string, source string, row int, rank int, kept boolean, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((v is not None, v) for v in r)


def test_exact_dedup(spark, docs, empty):
    got = sorted((tuple(r) for r in exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=key)
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, *_ in ROWS:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=key)
    left = exact.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted(groups)
    assert exact.exact_groups(empty).count() == 0 and exact.dedup(empty).columns == docs.columns


def test_bloom_filter_finds_every_repeated_hash(spark):
    rows = spark.range(20000).select((F.col("id") % 15000).alias("k")).select(F.xxhash64("k").alias("h"), "k")
    for bits in (15, 19):  # a crowded and a roomy table
        flagged = exact.in_filter(rows, exact.repeated_cells(rows.select("h"), bits), bits, "maybe")
        by = {r["k"]: (r["n"], r["m"]) for r in flagged.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("maybe").cast("int")).alias("m")).collect()}
        assert len(by) == 15000 and all(m == n for n, m in by.values() if n > 1)
    assert sum(m for n, m in by.values() if n == 1) < 1500


def brute_fingerprint(text):
    import xxhash
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(x) for x in zip(w, w[1:], w[2:])] if len(w) > 2 else [" ".join(w)] if w else []
    votes = [0] * 64
    for h in (xxhash.xxh64_intdigest(x, 42) for x in s):
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(s))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(spark, docs, empty):
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_groups(docs).collect())
    prints = [brute_fingerprint(t or "") for _, t, *_ in ROWS]
    roots = brute_components(prints)
    least = {}
    for (i, *_), r in zip(ROWS, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == sorted((i is not None, i, p, least.get(r)) for (i, *_), p, r in zip(ROWS, prints, roots))
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | {c for *_, c in got if c is not None}


def test_pigeonring_links_every_close_pair(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(25):
            f = c
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                f ^= 1 << int(b)
            prints.add(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(prints)]
    types = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) % 2**64).count("1") <= 2}
    for segments in (8, 16):
        assert {tuple(r) for r in simhash.links(types, segments=segments).collect()} == want
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000 + i, 999) for i in range(1, 50)], "u long, v long")
    roots = dict(tuple(r) for r in simhash.stars(edges).collect())
    assert roots == {i: 0 for i in range(1, 201)} | {i: 999 for i in range(1001, 1050)}


def test_bpe_equals_the_library(spark, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in bpe.encoded(docs, with_tokens=True).collect()), key=key)
    want = []
    for i, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    assert got == sorted(want, key=key)
    assert bpe.encoded(empty).count() == 0
    v = bpe.vocabulary(bpe.vocabulary_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    letters = [*"abcTHE 's019\n\t\x1c\x85\xa0é漢🙂Ⅷ!?.", "<|endoftext|>", "'re", "  "]
    for _ in range(1500):
        x = "".join(rng.choice(letters, rng.integers(0, 30)))
        ids = t.encode(x, add_special_tokens=False).ids
        assert v.encode(x) == np.array(ids, "<u4").tobytes() and v.decode(v.encode(x)) == t.decode(ids, skip_special_tokens=False)


def test_mixing_keeps_every_prefix_near_its_target(spark, docs, empty):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("src"))
    weights = {"big": 0.5, "mid": 0.3, "small": 0.2}
    got = mixing.mixed(rows, weights=weights, block_rows=16, doc_id="id", source="src").orderBy("slot", "place").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6000))
    assert all(r["release_slot"] <= r["slot"] < r["due_slot"] for r in got)
    slots = sorted({(r["slot"], r["source"]) for r in got})
    assert [s for s, _ in slots] == list(range(len(slots)))
    taken = Counter()
    for s, name in slots:
        if all(r["phase"] == 0 for r in got if r["slot"] == s):
            taken[name] += 1
            assert all(abs(taken[n] - w * (s + 1)) < 1 for n, w in weights.items())
        else:
            break
    assert sum(taken.values()) > 50
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ROWS) and {r["source"] for r in got} == {"(none)", "s0", "s1", "s2", "s3"}
    assert mixing.in_order(docs).columns == docs.columns and mixing.mixed(empty).count() == 0


def test_edf_pattern_is_pfair():
    for parts in ({"a": 1}, {"a": 500, "b": 300, "c": 199, "d": 1}, {chr(97 + i): i + 1 for i in range(12)}):
        period, slots = sum(parts.values()), mixing.edf_pattern(parts)
        assert sorted(t for s in slots.values() for t in s) == list(range(period))
        for s, q in parts.items():
            assert len(slots[s]) == q and all(j * period // q <= t < -(-(j + 1) * period // q) for j, t in enumerate(slots[s]))
    assert sum(mixing.whole_parts({"a": 1e9, "b": 1, "c": 2}).values()) >= 1000


def toxic_tables(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"w{(i * 7 + k * 13) % 90}" for k in range(30)]
        if bad:
            words[5], words[20] = ("blarghest", "snorfling") if i % 8 else ("blarghest", "grumphed")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_held_out_rows_and_reads_context(spark, docs, empty):
    import zlib
    rows, labels = toxic_tables(spark)
    got = toxicity.scored(rows, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got) and any(r["held_out"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    kept = toxicity.clean(rows, labels)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < 0.5}
    out = toxicity.scored(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out) and sum(r["predicted"] for r in out) == 0
    assert toxicity.clean(docs, labels).columns == docs.columns
    assert toxicity.scored(empty, labels).count() == 0
    none = toxicity.scored(docs, labels.filter("false")).collect()
    assert {r["predicted"] for r in none} == {0}


def test_levenshtein_walk_equals_brute_force():
    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    def true_distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    terms = {"moron": 3.0, "idiot": 2.5, "worthless": 2.0, "scum": 4.0, "loser": 1.0, "losers": 1.5}
    trie = toxicity.Trie(terms)
    rng = np.random.default_rng(1)
    words = ["oron", "mmoron", "morno", "idi0t", "worthles", "orthless", "worthlesss", "scam", "loserss", "looser", "xloser", ""]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.integers(0, 3)):
                p = rng.integers(0, len(w) + 1)
                w[p:p + rng.integers(0, 2)] = list(rng.choice(list("abilmorst"), rng.integers(0, 2)))
            words.append("".join(w))
    for w in words:
        near = [(true_distance(w, t), -v, t) for t, v in terms.items() if true_distance(w, t) <= (len(t) >= toxicity.FUZZY_LENGTH)]
        assert trie.match(w) == ((min(near)[2], min(near)[0]) if near else None), w
    s = toxicity.Scorer(terms)
    assert s.features('he wrote "you moron" there')[0] < s.features("hello you moron there")[0]
    assert s.features("a m0ron there")[0] > 0 and s.features("nothing here") == (0.0, 0.0)


def test_licences(spark, docs, empty):
    extra = spark.createDataFrame([(100, "intro\nThis work is licensed under the GNU General Public License, version 3.\nmore", "en", "s", 1, 1, True, "x"),
                                   (101, "You need a driving licence to rent a car here.\nThe copyright office moved.", "en", "s", 1, 1, True, "x")], SCHEMA)
    got = {r["doc_id"]: r for r in licenses.scanned(docs.unionByName(extra)).collect()}
    assert got[14]["families"] == "mit" and got[19]["families"] == "cc-by-nc" and got[100]["families"] == "gpl" and got[100]["found"][0]["line"] == 1
    assert [got[i]["n_licenses"] for i in (0, 1, 8, 10, 101)] == [0] * 5
    assert got[1]["n_paragraphs"] == 0 and got[16]["n_paragraphs"] == 90
    assert licenses.scanned(docs).count() == len(ROWS) and licenses.scanned(empty).count() == 0


def brute_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            if k == 2:
                total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, docs, empty):
    got = sorted((tuple(r)[:6] for r in pii.found(docs).collect()), key=key)
    want = []
    for i, t, *_ in ROWS:
        spans = brute_spans(t or "")
        want.append((i, *[sum(k == n for _, k, _ in spans) for n in range(4)], hashlib.sha256(pii.joined(spans).encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert pii.found(empty).count() == 0
    rng = np.random.default_rng(4)
    letters = [*"ab.@-+ 01239()%_é\n", "4111 1111 1111 1111", "1.2.3.4", "+1 (612) 555-4887", "a@b.co"]
    for _ in range(3000):
        x = "".join(rng.choice(letters, rng.integers(0, 25)))
        assert pii.base_spans(x) == brute_spans(x), x


def test_skip_chain_carries_a_label_to_a_distant_repeat():
    texts = [f"write to user{i}@mail.example.com or call +1 (612) 555-{1000 + i} today and see page {i} of 12 in 2019" for i in range(60)]
    model = pii.pseudo_fit([(g := pii.Graph(t), g.labels(pii.base_spans(t))) for t in texts])
    text = "write to zed7@mail.example.com today, then a long way on the name zed7@mail appears"
    graph = pii.Graph(text)
    assert graph.skip  # the repeated local part shares a potential
    with_skip = pii.marginals(graph, model)
    without = pii.marginals(graph, model | {"skip": np.zeros_like(model["skip"])})
    node = max(b for _, b in graph.skip)
    assert with_skip[node, 1] > without[node, 1]
    assert all(k == 0 for _, k, _ in pii.added_spans(text, pii.base_spans(text), model))


def test_warc_round_trip(spark, empty, tmp_path):
    body = "<p>" + "long page " * 200
    rows = [(1, "http://a", body), (2, None, body), (3, "http://b\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", body + "\x1f\x8b\x08 WARC/1.1"), (None, "u", "z"), (7, "u", "é" * 5_000_00)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kept", F.lit(1)).repartition(2)
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages).collect()), key=key)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None))
    assert got == sorted(want, key=key)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    many = spark.range(300).select(F.concat(F.lit("urn:page:"), "id").alias("record_id"), F.lit("response").alias("record_type"), F.lit("u").alias("uri"),
                                   F.lit(None).cast("string").alias("refers_to_id"), F.md5(F.col("id").cast("string")).cast("binary").alias("payload")).repartition(3)
    manifest = warc.write_archives(many, str(tmp_path / "w"), file_bytes=20_000).cache()
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == 300
    for split in (333, 1000, 1 << 20):  # every record is read once wherever the ranges are cut
        ids = [r["record_id"] for r in warc.read_archives(manifest, split_bytes=split).select("record_id").collect()]
        assert len(ids) == 300 == len(set(ids))


def test_fertility_rules(spark, docs, empty):
    got = {}
    for r in fertility.judged(docs).collect():
        got[r["doc_id"]] = r
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        counts = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if counts[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (r["kept"] and r["base_failed"])
    assert fertility.judged(empty).count() == 0
    prose = [(i, " ".join(f"{a}{b}" for a, b in zip(["the", "river", "forest"] * 40, np.random.default_rng(i).choice(["s", "ing", "ed", ""], 120))), "en") for i in range(80)]
    odd = [(900, " ".join(chr(0x10300 + k % 30) * 3 for k in range(130)), "en")]
    judged = {r["doc_id"]: r["kept"] for r in fertility.judged(spark.createDataFrame(prose + odd, "doc_id long, text string, lang string")).collect()}
    fails = {r["doc_id"] for r in fertility.judged(spark.createDataFrame(prose, "doc_id long, text string, lang string")).filter("not kept and not base_failed").collect()}
    assert not fails and len(judged) == 81


def brute_model(texts):
    """Interpolated modified Kneser-Ney straight from the definition, on tuples."""
    counts = {lm.ORDER: Counter()}
    for t in texts:
        c = lm.codes(t).tolist()
        counts[lm.ORDER].update(tuple(c[i:i + lm.ORDER]) for i in range(len(c) - lm.ORDER + 1))
    for n in range(lm.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            off[n] = [min(max(d, 0.1), k - 0.05) for d, k in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (1, 2, 3))]
        else:
            off[n] = [0.5, 1.0, 1.5]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        own = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        cut = lambda v: off[n][min(v, 3) - 1]
        left = sum(map(cut, own.values())) / total
        c = own.get(gram, 0)
        return (c - cut(c)) / total * (c > 0) + left * p(gram[1:]) if c else left * p(gram[1:])

    return p


def test_perplexity_equals_definition_in_one_and_many_shards(spark, docs, empty):
    good = ["the cat sat on the mat and the dog sat on the log", "a cat and a dog sat here", "the mat is on the log"]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(10, "zq xx qqq", "en"), (11, "the dog is here", None), (12, "", "en"), (13, None, "en"), (11, "the dog is here", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(1))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0), (10, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    p = brute_model(good)
    for limit in (lm.SHARD_ENTRIES, 300):
        got = sorted((r["doc_id"], r["n_chars"], r["perplexity"], r["kept"]) for r in lm.judged(frame, labels, shard_entries=limit).collect() if r["perplexity"] is not None)
        assert len(got) == len(rows) - 2
        for i, n, value, kept in got:
            c = lm.codes(dict((a, b) for a, b, _ in rows)[i]).tolist()
            grams = [tuple(c[k:k + lm.ORDER]) for k in range(len(c) - lm.ORDER + 1)]
            assert n == len(grams) and kept and value == pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in grams])), rel=1e-9)
    out = lm.judged(docs, labels).collect()
    assert len(out) == len(ROWS) and not any(r["kept"] for r in out if not r["n_chars"])
    assert lm.judged(empty, labels).count() == 0
