"""SentencePiece BPE from a public model file with a distinct-chunk table.

Normalised text marks spaces with U+2581.  Where no piece has a marker behind another character, a piece never crosses the
place before a run of markers, so a text is a sequence of marked words (markers, then other characters) that merge
independently.  For every block of texts the distinct marked words make a table; each of them is segmented once and the
ids go back to the texts by position.  Merging takes the pair with the best score, the leftmost on ties; characters
without a piece become their UTF-8 bytes.  Models whose pieces do cross markers are segmented text by text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.bpe import vocabulary_path
from pitpanel.llm.common import arrow_map, text_of, texts

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "  # fixed: what an unknown id decodes to
WIDTHS = (6, 9, 13, 20, 40)  # chunks of like length are merged together, those beyond one by one with a heap
TOGETHER = 20_000
BLOCK_CHARACTERS = 4_000_000  # of texts that share one chunk table; a longer text has its own
NO_MERGE, MERGED = 1 << 62, 0xFFFFFFFF
codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Pieces, scores and special ids of a model file; segmentation of one chunk and decoding of ids."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        control = {i for i in range(n) if model.is_control(i)}
        byte = {i: int(names[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
        self.eos, unknown = model.eos_id(), model.unk_id()
        plain = [i for i in range(n) if i not in control and i not in byte and i != unknown and not model.is_unused(i)]
        self.size, id_of = n, {names[i]: i for i in plain}
        self.symbol = {s: i for s, i in id_of.items() if len(s) == 1}
        rank = {x: k for k, x in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        #: (left symbol, right symbol) as one number -> rank and merged id as one number; equal scores have equal ranks
        self.merges = {}
        for s, i in id_of.items():
            for k in range(1, len(s)):
                a, b = (id_of.get(x, self.spare(x) if len(x) == 1 else None) for x in (s[:k], s[k:]))
                if a is not None and b is not None:
                    self.merges[a << 32 | b] = rank[model.get_score(i)] << 32 | i
        self.byte_id = {b: i for i, b in byte.items()}
        if len(self.byte_id) < 256 or any(model.is_unused(i) for i in range(n)) or model.normalize("ﬁ  Ａ") != MARK + "ﬁ" + MARK * 2 + "Ａ":
            raise ValueError("only models with byte fallback, identity normalisation, a leading marker and no unused pieces")
        self.bytes = [b"" if i in control else bytes([byte[i]]) if i in byte else UNKNOWN_TEXT.encode() if i == unknown
                      else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.marked = frozenset(i for i in plain if names[i][0] == MARK)
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain)
        self.numbers = [str(i) for i in range(n)]
        self.by_code = np.arange(0x110000, dtype=np.int64) + n
        for c, i in self.symbol.items():
            self.by_code[ord(c)] = i
        self.keys = np.array(sorted(self.merges), np.int64)
        made = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        self.ranks, self.results = made >> 32, made & MERGED

    def spare(self, char: str) -> int:
        """Symbol of a character that is no piece: beyond the ids of all pieces."""
        return self.symbol.get(char, self.size + ord(char))

    def in_bytes(self, ids: list[int]) -> list[int]:
        """Symbols without a piece as byte ids."""
        return [x for i in ids for x in ([i] if i < self.size else [self.byte_id[b] for b in chr(i - self.size).encode("utf-8", "surrogatepass")])]

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs of symbols; NO_MERGE where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_MERGE), self.results[at]

    def segmented(self, table: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every chunk of the table, and all ids in its order."""
        length = np.fromiter(map(len, table), np.int64, len(table))
        size, out, last = np.zeros(len(table), np.int64), [None] * len(table), 0
        for most in WIDTHS:
            rows = np.flatnonzero((length > last) & (length <= most))
            last = most
            for at in range(0, len(rows), TOGETHER):
                part = rows[at:at + TOGETHER]
                for r, ids in zip(part.tolist(), self.together([table[r] for r in part], length[part], most)):
                    out[r], size[r] = ids, len(ids)
        for r in np.flatnonzero(length > last).tolist():
            out[r] = self.in_bytes(self.merged([self.symbol.get(c) or self.spare(c) for c in table[r]]))
            size[r] = len(out[r])
        return size, np.fromiter(chain.from_iterable(out), np.int32, int(size.sum()))

    def together(self, chunks: list[str], length: np.ndarray, width: int) -> list[list[int]]:
        """Ids of many short chunks: every round makes the best (leftmost) merge of each chunk that still has one."""
        m = len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.full((m, width + 1), -1, np.int64)
        symbols[np.arange(width + 1) < length[:, None]] = self.by_code[codes]
        following = np.tile(np.arange(1, width + 2), (m, 1))
        previous = np.tile(np.arange(-1, width), (m, 1))
        rank = np.full((m, width + 1), NO_MERGE, np.int64)
        merged = np.zeros((m, width + 1), np.int64)
        rank[:, :-1], merged[:, :-1] = self.found(symbols[:, :-1], symbols[:, 1:])
        live = np.arange(m)
        while len(live):
            i = rank[live].argmin(axis=1)
            more = rank[live, i] < NO_MERGE
            live, i = live[more], i[more]
            j = following[live, i]
            symbols[live, i], symbols[live, j], rank[live, j] = merged[live, i], -1, NO_MERGE
            k = np.minimum(following[live, j], width)
            following[live, i], previous[live, k] = k, i
            rank[live, i], merged[live, i] = self.found(symbols[live, i], symbols[live, k])
            p = previous[live, i]
            rows, p, i = live[p >= 0], p[p >= 0], i[p >= 0]
            rank[rows, p], merged[rows, p] = self.found(symbols[rows, p], symbols[rows, i])
        flat, ends = symbols[symbols >= 0].tolist(), np.cumsum((symbols >= 0).sum(axis=1)).tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for r in np.flatnonzero((symbols >= self.size).any(axis=1)).tolist():
            ids[r] = self.in_bytes(ids[r])
        return ids

    def merged(self, ids: list[int]) -> list[int]:
        """Long chunks: a heap of ranks over a linked list; entries whose pair has changed are skipped."""
        n, merges = len(ids), self.merges
        following, previous = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m >> 32) << 32 | i for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & MERGED
            if ids[i] < 0 or (j := following[i]) < 0 or (m := merges.get(ids[i] << 32 | ids[j])) is None or m >> 32 != entry >> 32:
                continue
            ids[i], ids[j] = m & MERGED, -1
            k = following[i] = following[j]
            if k >= 0:
                previous[k] = i
                if (m := merges.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, (m >> 32) << 32 | i)
            if (p := previous[i]) >= 0 and (m := merges.get(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(queue, (m >> 32) << 32 | p)
        return [x for x in ids if x >= 0]

    def encode_block(self, block: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text of a block, the end id last; a block is cut so that its chunk table stays small."""
        at = 0
        while at < len(block):
            end, chars = at, 0
            while end < len(block) and (end == at or chars + len(block[end]) <= BLOCK_CHARACTERS):
                chars += len(block[end])
                end += 1
            yield from self.encode_together(block[at:end])
            at = end

    def encode_together(self, block: list[str]) -> list[np.ndarray]:
        flat, counts = [], []
        for text in block:
            marked = (MARK + text).replace(" ", MARK) if text else ""
            own = [marked] * bool(marked) if self.crossing else CHUNK.findall(marked)
            flat += own
            counts.append(len(own))
        numbers = defaultdict(count().__next__)
        place = np.fromiter((numbers[c] for c in flat), np.int64, len(flat))
        size, pool = self.segmented(list(numbers))
        # join by position: where the ids of each chunk start in the table, and where they go in the texts
        start, length = (np.cumsum(size) - size)[place], size[place]
        end = np.cumsum(length)
        ids = pool[np.repeat(start - end + length, length) + np.arange(int(length.sum()))]
        cuts = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])].tolist()
        tail = np.array([self.eos], np.int32)
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """Piece strings joined, markers as spaces without the leading one; every byte that is no UTF-8 is a replacement character."""
        strings = self.bytes
        text = b"".join([strings[i] for i in ids.tolist()]).decode("utf-8", "each-byte")
        return text[1:] if next((i for i in ids.tolist() if strings[i]), -1) in self.marked else text


#: a run of markers and what follows up to the next marker; the first chunk of a text may have no marker
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, model: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text", with_tokens: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens (end id included), ids_sha256, decoded_sha256, and the ids if ``with_tokens``.

    Whole texts of any length; null is empty and has the end id only.  A long word without spaces is one chunk.  Rows are independent, so ties and repeated rows just repeat; an empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_tokens

    def make():
        p = pieces(vocabulary_path(model))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = list(p.encode_block(texts(batch)))
            columns = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(" ".join([p.numbers[i] for i in x.tolist()]).encode()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(p.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string())}
            if with_tokens:
                columns["ids"] = pa.array([x for x in ids], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)
        return apply

    return arrow_map(rows, make, schema, rows=500)

