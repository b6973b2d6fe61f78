"""Quality rules from tokeniser fertility: how well public vocabularies fit a text, judged by bands of its language.

Measured per text: characters per token of a byte-level vocabulary, the share of bytes in characters that a piece
vocabulary only reaches by byte fallback, and the entropy of the tokens against its most at that length.  For every
language and length class the bands are quartiles of all texts widened by a multiple of their distance; a text outside
a band is rejected.  Where a class has few texts the bands are those of the language over all lengths, else of the main
script, else of all texts, with the entropy taken against its line over the logarithm of the length.
"""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.bpe import vocabulary_path
from pitpanel.llm.common import arrow_map, text_of, texts
from pitpanel.sources.workdir import materialise

MIN_WORDS = 50
REPEAT_PERCENT = 50
WIDEN = 6.0  # quartile distances that a band reaches beyond the quartiles
LEAST_SPREAD = {"chars_per_token": 0.03, "fallback_share": 0.005, "token_entropy": 0.01}  # smallest quartile distance that counts
LEAST_TEXTS = 30  # a group with fewer texts has no band of its own and takes that of the next wider one
LEVELS = (("lang", "length_class"), ("lang",), ("script",), ("every",))  # groups with bands, from narrow to wide
SYMBOLS = "#*$%&|<>"  # fixed
SPACE = re.compile(r"[\x20\x09-\x0D]")


@lru_cache(maxsize=1)
def vocabularies(ranks_file: str, piece_file: str):
    """Encoder of the byte-level vocabulary and the set of characters that the piece vocabulary has."""
    import public_tokenizers
    import sentencepiece
    import tiktoken
    with open(vocabulary_path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(piece_file))
    known = {c for i in range(pieces.vocab_size()) if not pieces.is_byte(i) and not pieces.is_control(i) for c in pieces.id_to_piece(i)}
    return encoding.encode_ordinary, frozenset(known) | set(" \t\n\r\v\f")


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    v = len(number)
    pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


def measures(text: str, encode, known: frozenset) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, chars_per_token, fallback_share, token_entropy)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    base = (len(words), len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words))
    if not words:
        return *base, 0, 0.0, 0.0, 0.0
    tokens = np.array(encode(text), np.int32)
    p = np.unique(tokens, return_counts=True)[1] / len(tokens)
    entropy = float(-(p * np.log(p)).sum()) / math.log(len(tokens)) if len(tokens) > 1 else 0.0
    fallback = sum(text.count(c) * len(c.encode("utf-8", "surrogatepass")) for c in set(text) - known)
    return *base, len(tokens), len(text) / len(tokens), fallback / len(raw), entropy


def main_script(text: str) -> int:
    """The most frequent block among the letters: 1 + the code over 256, with Latin blocks as 1 and ideographs as one; none: 0."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    block = 1 + (code >> 8).astype(np.int64)
    block = np.where((code < 0x250) | (block == 0x1F), 1, np.where((code >= 0x3400) & (code < 0xA000) | (code >= 0x20000), 0x4F, np.where((code >= 0xAC00) & (code < 0xD800), 0xAD, block)))
    letters = block[(code >= 0x80) | (code >= 65) & (code <= 90) | (code >= 97) & (code <= 122)]
    return int(np.bincount(letters).argmax()) if len(letters) else 0


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
RATES = ("chars_per_token", "fallback_share", "token_entropy")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", ranks_file: str = "byte_bpe_multi_50k.tiktoken",
             piece_file: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row with the id, the language (null: und), the main script and all measures."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, script int, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATES])

    def make():
        encode, known = vocabularies(ranks_file, piece_file)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = texts(batch)
            columns = [*zip(*[measures(t, encode, known) for t in own])] or [()] * 9
            script = pa.array([main_script(t) for t in own], pa.int32())
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATES)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), script, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "lang", "script", *COUNTS, *RATES])
        return apply

    return arrow_map(rows, make, schema)


def bands(rows: DataFrame, group: tuple[str, ...] = LEVELS[0], widen: float = WIDEN) -> DataFrame:
    """Rejection bands by ``group``, from all texts that pass the base rules; over all lengths the entropy is taken against a line."""
    rows, flat, least = rows.filter("not base_failed"), "length_class" in group, 1 if group == LEVELS[-1] else LEAST_TEXTS
    if flat:
        rows = rows.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    else:
        x = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))
        b = F.coalesce(F.regr_slope("token_entropy", x), F.lit(0.0))
        line = rows.groupBy(*group).agg(b.alias("b"), (F.avg("token_entropy") - b * F.avg(x)).alias("a"))
        rows = rows.join(F.broadcast(line), list(group))  # one row for each group, a short list
        rows = rows.withColumn("token_entropy", F.col("token_entropy") - F.col("a") - F.col("b") * x)
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 10000).alias(c) for c in RATES]
    stats = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("a"), F.max("b").alias("b"), *quartiles).filter(F.col("n") >= least)
    limits = []
    for c in RATES:
        reach = F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(LEAST_SPREAD[c])) * widen
        limits += [(F.col(c)[0] - reach).alias(f"{c}_low"), (F.col(c)[1] + reach).alias(f"{c}_high")]
    return stats.select(*group, F.struct("a", "b", *limits).alias("band"))


def judged(docs: DataFrame, widen: float = WIDEN, **columns) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the measures.

    Null and empty texts have no words and fail the base rules.  Every other text is judged by the narrowest of
    LEVELS that has a band for it.  Repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    rows = measured(docs, **columns)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = materialise(rows.withColumns({"base_failed": failed, "length_class": F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int"), "every": F.lit(0)}), "fertility")
    joined, found = rows, []
    for k, group in enumerate(LEVELS):  # one row for each group, short lists
        own = bands(rows, group, widen).withColumnRenamed("band", f"band{k}")
        joined = joined.join(F.broadcast(own), list(group), "left")
        found.append(f"band{k}")
    joined = joined.withColumn("band", F.coalesce(*found))
    x = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))
    value = {c: F.col(c) for c in RATES} | {"token_entropy": F.col("token_entropy") - F.col("band.a") - F.col("band.b") * x}
    outside = F.lit(False)
    for c, v in value.items():
        outside = outside | F.coalesce((v < F.col(f"band.{c}_low")) | (v > F.col(f"band.{c}_high")), F.lit(False))
    return joined.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & ~outside).alias("kept"), "lang", "n_tokens", *RATES)
