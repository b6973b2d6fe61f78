"""Helpers that the corpus operators share: packed rows, checked-size id filters, fast word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000  # rows of 8-byte ids that may be broadcast (under 64 MB); beyond it the ids are joined by a shuffle


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns plus the whole row as the struct ``row``, so extra columns can't clash with ours."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def with_ids(rows: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join with a distinct id list: map-side while the counted list is small, else by a shuffle of both."""
    ids = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    small = ids.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(ids) if small else ids, F.col(key).eqNullSafe(F.col("_id")), how)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with state made once per task; large batches are cut so that memory follows ``rows`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield apply(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
