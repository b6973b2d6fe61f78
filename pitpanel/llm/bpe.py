"""Byte-level BPE from a public vocabulary file: encoding by a priority queue over a linked symbol list, decoding by joining vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import arrow_map, text_of, texts

CACHE_WORDS = 400_000  # pieces remembered in a task (about 100 MB); a full cache is emptied
SPACE, REST = r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]"
#: Fixed: the split that the vocabulary was made with.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{REST}+|{SPACE}+(?!{SPACE.replace('p', 'P', 1)})|{SPACE}+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself where printable, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.bytes = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: (left id, right id) as one number -> rank and merged id as one number
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece: lowest rank first, leftmost on ties; entries whose pair has changed are stale and skipped."""
        ids = [self.first[b] for b in data]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        following, previous = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m >> 20) << 32 | i for i in range(n - 1) if (m := merges.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            left = ids[i]
            if left < 0 or (j := following[i]) < 0 or (m := merges.get(left << 20 | ids[j])) is None or m >> 20 != entry >> 32:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            k = following[i] = following[j]
            if k >= 0:
                previous[k] = i
                if (m := merges.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(queue, (m >> 20) << 32 | i)
            if (p := previous[i]) >= 0 and (m := merges.get(ids[p] << 20 | ids[i])) is not None:
                heapq.heappush(queue, (m >> 20) << 32 | p)
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) < 64:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special strings in the text are their ids."""
        known, make, out = self.known.get, self.piece, []
        for part in self.cut(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += [known(p) or make(p) for p in self.pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings of the ids, joined; broken UTF-8 becomes the replacement character."""
        strings = self.bytes
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that runs the task; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def encoded(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text", with_tokens: bool = False,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if ``with_tokens``; columns in ``keep`` come along.

    Whole texts of any length; null is empty (no tokens).  Rows are independent, so ties and repeated rows just repeat;
    an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"), *keep)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_tokens
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        v = vocabulary(vocabulary_path(vocabulary_file))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [v.encode(t) for t in texts(batch)]
            columns = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(v.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string())}
            if with_tokens:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            return pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in keep})
        return apply

    return arrow_map(rows, make, schema, rows=500)
