"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Tokens that may carry personal data and their neighbours are the nodes of a document's graph.  Neighbouring nodes share
chain potentials; a token also shares a skip potential with its last equal or similar token, however far away, so that
loopy message passing settles repeated tokens on one entity label through the whole document.  The field is trained by
pseudo-likelihood on a bounded sample of documents whose labels are the base spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import arrow_map, text_of, texts
from pitpanel.sources.workdir import materialise

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_DOCS = 4_000  # most documents that the field is trained on, chosen by hash order
TRAIN_NODES = 64  # nodes of a training document that count, so that no long document rules the fit
ROUNDS = 12
SURE = 0.9  # least marginal probability of an added span
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
ACTIVE = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is never entered in its middle, which finds the same matches in linear time.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def local_start(text: str, done: int, at: int) -> int:
    """Start of the run of local-part characters before an @, not before the end of the last match."""
    i = at
    while i > done and text[i - 1].isascii() and (text[i - 1].isalnum() or text[i - 1] in "._%+-"):
        i -= 1
    return i


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost and non-overlapping in each kind; failing matches are dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = local_start(text, done, at)
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m[0]))
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Runs of letters, digits and signs as one sign each."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token)))[:12]


def node_features(tokens: list[str], i: int) -> list[str]:
    """Features of a node: shapes of itself and its neighbours, counts, checks; never whether a base pattern matched."""
    t = tokens[i].strip(EDGE)
    digits = "".join(DIGITS.findall(t))
    out = ["bias", "s=" + shape(t), f"d={min(len(digits), 20)}", f"p={t.count('.')}", f"len={min(len(t) // 4, 8)}"]
    if "@" in t:
        out.append("at" + str(min(2, t.count("@"))) + str("." in t.rpartition("@")[2]))
    if digits and digits == t:
        out.append(f"number luhn={len(digits) > 11 and luhn(digits)}")
    out += [f"plus={t.startswith('+')}", f"paren={'(' in t}"]
    out.append("-1=" + (shape(tokens[i - 1].strip(EDGE)) if i else "^"))
    out.append("+1=" + (shape(tokens[i + 1].strip(EDGE)) if i + 1 < len(tokens) else "$"))
    return out


class Graph:
    """Active tokens of a text and their neighbours, with chain and skip edges."""

    def __init__(self, text: str):
        spans = [m.span() for m in TOKEN.finditer(text)]
        self.tokens = [text[a:b] for a, b in spans]
        active = [i for i, t in enumerate(self.tokens) if ACTIVE.search(t)]
        self.nodes = sorted({j for i in active for j in (i - 1, i, i + 1) if 0 <= j < len(spans)})
        self.spans = [spans[i] for i in self.nodes]
        self.chain = [(k - 1, k) for k in range(1, len(self.nodes)) if self.nodes[k] == self.nodes[k - 1] + 1]
        last: dict[str, int] = {}
        self.skip = []
        for k, i in enumerate(self.nodes):
            token = self.tokens[i].strip(EDGE)
            if not ACTIVE.search(token):
                continue
            digits = "".join(DIGITS.findall(token))
            for key in {token.lower(), token.lower().partition("@")[0] + "@" if "@" in token else "", digits if len(digits) > 6 else ""} - {""}:
                if key in last and last[key] != k - 1:
                    self.skip.append((last[key], k))
                last[key] = k

    def labels(self, base: list[tuple[int, int, int]]) -> np.ndarray:
        out, j = np.zeros(len(self.nodes), np.int64), 0
        ends = sorted(base)
        for k, (a, b) in enumerate(self.spans):
            while j < len(ends) and ends[j][2] <= a:
                j += 1
            hit = [kind for s, kind, e in ends[j:j + 8] if s < b and e > a]
            out[k] = 1 + hit[0] if hit else 0
        return out


def pseudo_fit(graphs: list[tuple[Graph, np.ndarray]], steps: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> dict:
    """Weights of node features, chain and skip potentials by full-batch Adam on the pseudo-likelihood."""
    names: dict[str, int] = {}
    index, owner, y, near = [], [], [], []
    n = 0
    for g, labels in graphs:
        size = min(len(g.nodes), TRAIN_NODES)
        around = np.zeros((size, 3, len(LABELS)))
        for kind, edges in ((0, g.chain), (2, g.skip)):
            for a, b in edges:
                if b < size:
                    around[b, kind, labels[a]] += 1
                    around[a, 1 if kind == 0 else 2, labels[b]] += 1
        for k in range(size):
            for f in node_features(g.tokens, g.nodes[k]):
                index.append(names.setdefault(f, len(names)))
                owner.append(n)
            n += 1
        y.append(labels[:size])
        near.append(around)
    if not n:
        return {"names": {}, "node": np.zeros((0, len(LABELS))), "chain": np.zeros((len(LABELS),) * 2), "skip": np.zeros((len(LABELS),) * 2)}
    index, owner, y, near = np.array(index), np.array(owner), np.concatenate(y), np.concatenate(near)
    size = len(LABELS)
    weights = [np.zeros((len(names), size)), np.zeros((size, size)), np.zeros((size, size))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    target = np.eye(size)[y]
    for step in range(1, steps + 1):
        score = np.add.reduceat(weights[0][index], starts, axis=0) + near[:, 0] @ weights[1] + near[:, 1] @ weights[1].T + near[:, 2] @ (weights[2] + weights[2].T) / 2
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = target - p / p.sum(axis=1, keepdims=True)
        node = np.zeros_like(weights[0])
        np.add.at(node, index, error[owner])
        skip = near[:, 2].T @ error
        grads = [node, near[:, 0].T @ error + error.T @ near[:, 1], (skip + skip.T) / 2]
        for k, grad in enumerate(grads):
            grad = grad / n - ridge * weights[k]
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            weights[k] = weights[k] + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return {"names": names, "node": weights[0], "chain": weights[1], "skip": (weights[2] + weights[2].T) / 2}


def marginals(g: Graph, model: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of the nodes by loopy sum-product messages over chain and skip edges."""
    names, size = model["names"], len(LABELS)
    potential = np.zeros((len(g.nodes), size))
    for k, i in enumerate(g.nodes):
        known = [names[f] for f in node_features(g.tokens, i) if f in names]
        if known:
            potential[k] = model["node"][known].sum(axis=0)
    edges = [(a, b, model["chain"]) for a, b in g.chain] + [(a, b, model["skip"]) for a, b in g.skip]
    if edges:
        a = np.array([e[0] for e in edges] + [e[1] for e in edges])
        b = np.array([e[1] for e in edges] + [e[0] for e in edges])
        w = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.r_[len(edges):2 * len(edges), 0:len(edges)]
        messages = np.zeros((2 * len(edges), size))
        for _ in range(rounds):
            belief = potential.copy()
            np.add.at(belief, b, messages)
            out = (belief[a] - messages[back])[:, :, None] + w
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            done, messages = np.abs(new - messages).max() < 1e-3, 0.5 * messages + 0.5 * new
            if done:
                break
        np.add.at(potential, b, messages)
    p = np.exp(potential - potential.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: dict) -> list[tuple[int, int, int]]:
    """Spans of nodes that the field is sure of and that no base span touches; neighbours of one kind become one span."""
    g = Graph(text)
    if not g.nodes or not model["names"]:
        return []
    taken = g.labels(base) > 0
    if all(taken[k] or not ACTIVE.search(g.tokens[i]) for k, i in enumerate(g.nodes)):
        return []
    p = marginals(g, model)
    out: list[tuple[int, int, int]] = []
    previous = None
    for k, i in enumerate(g.nodes):
        label = int(p[k].argmax())
        token = g.tokens[i]
        core = token.strip(EDGE)
        if not label or p[k, label] < SURE or taken[k] or not ACTIVE.search(core):
            previous = None
            continue
        start = g.spans[k][0] + token.index(core)
        if previous == (i - 1, label) and label in (3, 4):
            out[-1] = (out[-1][0], label - 1, start + len(core))
        else:
            out.append((start, label - 1, start + len(core)))
        previous = (i, label)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> dict:
    """Field weights from at most ``limit`` documents that hold a digit or an @ (a bounded sample, fitted on the driver)."""
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    chosen = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy("h").limit(limit).select(F.col("h").alias("_h"))  # at most `limit` hashes

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in texts(batch):
                g = Graph(t)
                y = g.labels(base_spans(t))[:TRAIN_NODES]
                out.append((" ".join(t[a:b] for a, b in g.spans[:TRAIN_NODES]), y.tolist()))
            return pa.RecordBatch.from_pydict({"text": pa.array([x[0] for x in out], pa.string()), "labels": pa.array([x[1] for x in out], pa.list_(pa.int64()))})
        return apply

    sample = rows.join(F.broadcast(chosen), F.col("h") == F.col("_h")).dropDuplicates(["h"]).orderBy("h").select("text")
    graphs = []
    for r in arrow_map(sample, make, "text string, labels array<long>").collect():  # TRAIN_DOCS x TRAIN_NODES tokens at most
        g = Graph(r["text"])
        if len(g.nodes) == len(r["labels"]):
            graphs.append((g, np.array(r["labels"], np.int64)))
    return pseudo_fit(graphs)


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Null and empty texts have no spans.  Positions are code points, the end is exclusive; spans are ordered by start and
    then kind.  Texts of any length are read whole.  Rows are independent, so ties and repeated rows repeat; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    model = train(rows)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans, added = [], [], [], []
            for t in texts(batch):
                base = base_spans(t) if ACTIVE.search(t) else []
                more = added_spans(t, base, model) if ACTIVE.search(t) else []
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
                added.append(len(more))
            n = np.array(counts, np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in n.T], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                                              names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
        return apply

    return arrow_map(rows, make, schema)
